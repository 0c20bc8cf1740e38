"""Joins and resampling in space: points in polygons, tiles of features, boxes, reprojection, mosaics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def _cells(box: Column, size: float) -> Column:
    """The grid cells (i, j) that a box touches."""
    i = F.sequence(F.floor(box["xmin"] / size), F.floor(box["xmax"] / size))
    j = F.sequence(F.floor(box["ymin"] / size), F.floor(box["ymax"] / size))
    return F.explode(F.flatten(F.transform(i, lambda a: F.transform(j, lambda b: F.struct(a.alias("i"), b.alias("j"))))))


def points_in_features(points: DataFrame, features: DataFrame, size: float, x: str = "x", y: str = "y", ring: str = "ring") -> DataFrame:
    """points joined with the features whose ring holds them.

    Features are dealt into the cells of ``size`` that they touch, places into their own: the exact test
    runs once a place and feature whose box holds it, not on all pairs of points and features. How many cells the features
    touch is not known before, so both joins are by sorting, not by a broadcast.
    """
    return points.join(_places_in_features(points, features, size, x, y, ring).hint("merge"), [x, y])


def _places_in_features(points: DataFrame, features: DataFrame, size: float, x: str, y: str, ring: str) -> DataFrame:
    """The distinct places of points joined with the features whose ring holds them."""
    f = features.withColumn("_box", geo.ring_extent(F.col(ring))).withColumn("_cell", _cells(F.col("_box"), size))
    places = points.select(x, y).distinct().withColumn("_cell", F.struct(F.floor(F.col(x) / size).alias("i"), F.floor(F.col(y) / size).alias("j")))
    near = F.col(x).between(F.col("_box.xmin"), F.col("_box.xmax")) & F.col(y).between(F.col("_box.ymin"), F.col("_box.ymax"))
    return places.join(f.hint("merge"), "_cell").where(near & geo.in_ring(F.col(x), F.col(y), F.col(ring))).drop("_cell", "_box")


def raster_mask(pixels: DataFrame, features: DataFrame, size: float, keys: list[str]) -> DataFrame:
    """The pixels (by their centres x, y) that lie in any feature; each once.

    Whether a place lies in any is settled on places and distinct rings, so that no pixel is repeated for each feature that holds it.
    """
    hits = _places_in_features(pixels, features.select("ring").distinct(), size, "x", "y", "ring").select("x", "y").distinct()
    return pixels.join(hits.hint("merge"), ["x", "y"], "left_semi").select(*keys).distinct()


def mask_of(pixels: DataFrame, features: DataFrame, size: float, ident: str, value, exclude: bool = False, keys: tuple[str, ...] = ("px", "py")) -> DataFrame:
    """The pixels in features whose ``ident`` is ``value`` (or is not, with ``exclude``)."""
    picked = features.where(F.col(ident) != value if exclude else F.col(ident) == value)
    return raster_mask(pixels, picked, size, list(keys))


def tiles_of_features(features: DataFrame, ring: str = "ring") -> DataFrame:
    """(rgiid, tile): 1 degree tiles that a feature touches: it has a corner inside, or an edge point, or it covers the tile's middle."""
    f = features.withColumn("_box", geo.ring_extent(F.col(ring))).withColumn("_c", _cells(F.col("_box"), 1.0))
    whole = F.lit(False)
    for dx, dy in ((0.5, 0.5), (0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)):
        whole = whole | geo.in_ring(F.col("_c.i") + dx, F.col("_c.j") + dy, F.col(ring))
    return f.where(whole | _edge_enters(F.col(ring))).select("rgiid", geo.tile_name(F.col("_c.j"), F.col("_c.i")).alias("tile")).distinct()


def _edge_enters(ring: Column) -> Column:
    """Whether an edge of the ring passes through the cell ``_c``: the part of it between the cell's sides is not empty."""

    def clipped(p, q):
        low, high = F.lit(0.0), F.lit(1.0)
        ok = F.lit(True)
        for axis, at in (("x", "i"), ("y", "j")):
            d, side = q[axis] - p[axis], F.col(f"_c.{at}")
            t0 = F.try_divide(side - p[axis], d)
            t1 = F.try_divide(side + 1 - p[axis], d)
            flat = d == 0
            ok = ok & (~flat | ((p[axis] >= side) & (p[axis] <= side + 1)))
            low = F.when(flat, low).otherwise(F.greatest(low, F.least(t0, t1)))
            high = F.when(flat, high).otherwise(F.least(high, F.greatest(t0, t1)))
        return ok & (low <= high)

    n = F.size(ring)
    return F.exists(F.sequence(F.lit(0), n - 1), lambda i: clipped(F.get(ring, i), F.get(ring, (i + 1) % n)))


def tile_mask(pixels: DataFrame, epsg: int, tile: str) -> DataFrame:
    """The pixels (centres x, y in ``epsg``) inside a 1 degree tile."""
    ll = geo.utm_inverse(F.col("x"), F.col("y"), F.lit(epsg))
    return pixels.withColumn("_ll", ll).where(geo.tile_name(F.col("_ll.lat"), F.col("_ll.lon")) == tile).drop("_ll")


def stack_tile(cells: DataFrame, epsg: int) -> DataFrame:
    """The name of the tile that holds the middle of a stack's extent."""
    box = cells.agg(((F.min("x") + F.max("x")) / 2).alias("x"), ((F.min("y") + F.max("y")) / 2).alias("y"))
    ll = box.select(geo.utm_inverse(F.col("x"), F.col("y"), F.lit(epsg)).alias("ll"))
    return ll.select(geo.tile_name(F.col("ll.lat"), F.col("ll.lon")).alias("tile"))


def shared_tile_sets(pairs: DataFrame) -> DataFrame:
    """(tiles, rgiids): features grouped by the set of tiles they lie on."""
    sets = pairs.groupBy("rgiid").agg(F.sort_array(F.collect_set("tile")).alias("tiles"))
    return sets.groupBy("tiles").agg(F.sort_array(F.collect_set("rgiid")).alias("rgiids"))


def boxes_overlapping(boxes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows (xmin, ymin, xmax, ymax) that overlap ``box``."""
    return boxes.where((F.col("xmin") <= box[2]) & (F.col("xmax") >= box[0]) & (F.col("ymin") <= box[3]) & (F.col("ymax") >= box[1]))


def common_box(boxes: DataFrame) -> DataFrame:
    return boxes.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def reference_tiles(tiles: DataFrame, box: tuple[float, float, float, float], least: float = 0.1) -> DataFrame:
    """Tiles with more than ``least`` of their area in ``box``, and that share."""
    own = tuple(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    share = geo.box_overlap(own, tuple(F.lit(float(v)) for v in box)) / ((own[2] - own[0]) * (own[3] - own[1]))
    return tiles.withColumn("share", share).where(F.col("share") > least)


def merge_stacks(stacks: DataFrame, keys: list[str], value: str = "z") -> DataFrame:
    """One value a key over overlapping stacks, the smallest; ``conflict`` tells where they disagree."""
    return stacks.groupBy(*keys).agg(F.min(value).alias(value), (F.count_distinct(value) > 1).alias("conflict"))


def majority_epsg(stacks: DataFrame) -> DataFrame:
    """The most frequent projection (the smallest code of equals)."""
    return stacks.groupBy("epsg").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "epsg").limit(1).select("epsg")


def resample(raster: DataFrame, target: DataFrame, res: float, method: str = "bilinear", value: str = "z", keys: tuple[str, ...] = ()) -> DataFrame:
    """``target`` (row id ``tid``, place x, y in the raster's projection) with the raster's value there.

    Raster cells (px, py) have their centres at multiples of ``res``. Bilinear takes four cells and is null
    if one is missing; nearest takes one.
    """
    gx, gy = F.col("x") / res, F.col("y") / res
    if method == "nearest":
        at = target.withColumn("px", F.floor(gx + 0.5).cast("int")).withColumn("py", F.floor(gy + 0.5).cast("int"))
        return at.join(raster.select(*keys, "px", "py", F.col(value)), [*keys, "px", "py"], "left").drop("px", "py")
    fx, fy = gx - F.floor(gx), gy - F.floor(gy)
    corners = [(0, 0, (1 - fx) * (1 - fy)), (1, 0, fx * (1 - fy)), (0, 1, (1 - fx) * fy), (1, 1, fx * fy)]
    four = F.explode(F.array(*[F.struct((F.floor(gx) + i).cast("int").alias("px"), (F.floor(gy) + j).cast("int").alias("py"), w.alias("w")) for i, j, w in corners]))
    part = target.select(*keys, "tid", four.alias("c")).select(*keys, "tid", "c.*").where("w > 0").join(raster.select(*keys, "px", "py", F.col(value)), [*keys, "px", "py"], "left")
    g = part.groupBy(*keys, "tid").agg(F.when(F.count(value) == F.count("*"), F.sum(F.col(value) * F.col("w"))).alias(value))
    return target.join(g, [*keys, "tid"])


def reproject(raster: DataFrame, epsg: int, target_epsg: int, grid: DataFrame, res: float, method: str = "bilinear", value: str = "z") -> DataFrame:
    """``grid`` (tid, x, y in ``target_epsg``) with the values of a raster in ``epsg``: places go back through latitude and longitude."""
    ll = geo.utm_inverse(F.col("x"), F.col("y"), F.lit(target_epsg))
    back = grid.withColumn("_ll", ll).withColumn("_xy", geo.utm_forward(F.col("_ll.lat"), F.col("_ll.lon"), F.lit(epsg)))
    moved = back.select("tid", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("_xy.x").alias("x"), F.col("_xy.y").alias("y"))
    out = resample(raster, moved, res, method, value)
    return out.select("tid", F.col("_x").alias("x"), F.col("_y").alias("y"), value)


def stack_extent(cells: DataFrame, res: float, digits: int = 1) -> DataFrame:
    """Rounded (half to even) extent of a grid's centres and the cell size, from its corners."""
    g = cells.agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"), F.count_distinct("x").alias("nx"))
    return g.select(*[F.bround(c, digits).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], F.when(F.col("nx") > 1, (F.col("xmax") - F.col("xmin")) / (F.col("nx") - 1)).otherwise(F.lit(float(res))).alias("dx"))


def coregistration_shift(df: DataFrame, keys: list[str], dh: str = "dh", slope: str = "slope", aspect: str = "aspect") -> DataFrame:
    """keys, dx, dy, dz: the shift that explains dh by slope and aspect, dh = tan(slope) (dx sin a + dy cos a) + dz, by least squares.

    The normal equations are sums, solved by Cramer's rule; apply the shift and repeat until it is small.
    """
    u = F.tan(F.radians(slope)) * F.sin(F.radians(aspect))
    v = F.tan(F.radians(slope)) * F.cos(F.radians(aspect))
    z = F.col(dh)
    names = {"n": F.lit(1.0), "u": u, "v": v, "uu": u * u, "vv": v * v, "uv": u * v, "z": z, "uz": u * z, "vz": v * z}
    s = df.where(F.col(dh).isNotNull() & F.col(slope).isNotNull() & F.col(aspect).isNotNull()).groupBy(*keys).agg(*[F.sum(c).alias(f"_{k}") for k, c in names.items()])
    c = {k: F.col(f"_{k}") for k in names}
    m = [[c["uu"], c["uv"], c["u"]], [c["uv"], c["vv"], c["v"]], [c["u"], c["v"], c["n"]]]
    rhs = [c["uz"], c["vz"], c["z"]]
    det = lambda a: a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
    swap = lambda j: [[rhs[i] if k == j else m[i][k] for k in range(3)] for i in range(3)]
    return s.select(*keys, *[F.try_divide(det(swap(j)), det(m)).alias(n) for j, n in enumerate(("dx", "dy", "dz"))])
