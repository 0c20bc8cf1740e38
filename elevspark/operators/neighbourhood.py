"""Raster neighbourhoods on long tables: disk extremes and percentiles, morphology, slope and curvature.

A raster is a table with integer ``px`` and ``py`` and the columns ``keys`` that name it (a tile).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def disk_rows(radius: int) -> list[tuple[int, int]]:
    """(dy, half width) of each row of a disk."""
    return [(dy, math.isqrt(radius * radius - dy * dy)) for dy in range(-radius, radius + 1)]


def disk_extremes(df: DataFrame, radius: int, value: str = "z", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, px, py, disk_min, disk_max of the values within ``radius`` pixels, for the pixels of ``df``.

    A disk is a stack of rows: a window over each row gives the extremes of every half width, and a
    pixel sends those to the 2 r + 1 rows it reaches: work grows with the radius, not the area.
    Cells without data are absent; nothing is assumed beyond the edge.
    """
    rows = disk_rows(radius)
    row = Window.partitionBy(*keys, "py").orderBy("px")
    wide = df.select(*keys, "px", "py", F.col(value).alias("_v"))
    sent = F.explode(F.array(*[F.struct((F.col("py") + dy).alias("py"), F.col(f"_lo{h}").alias("lo"), F.col(f"_hi{h}").alias("hi")) for dy, h in rows])).alias("s")
    # A target pixel may lack neighbours at its own px in another row, so rows are completed first.
    present = df.select(*keys, "px").distinct()
    grid = present.join(df.select(*keys, "py").distinct(), list(keys)) if keys else present.crossJoin(df.select("py").distinct())
    wide = grid.join(wide, [*keys, "px", "py"], "left")
    for half in sorted({h for _, h in rows}):
        w = row.rangeBetween(-half, half)
        wide = wide.withColumn(f"_lo{half}", F.min("_v").over(w)).withColumn(f"_hi{half}", F.max("_v").over(w))
    found = wide.select(*keys, "px", sent).select(*keys, "px", "s.py", "s.lo", "s.hi").groupBy(*keys, "px", "py").agg(F.min("lo").alias("disk_min"), F.max("hi").alias("disk_max"))
    return df.select(*keys, "px", "py").join(found, [*keys, "px", "py"])


def neighbours(df: DataFrame, offsets: list[tuple[int, int]], value: str = "z", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, px, py, dx, dy, value: for each pixel of ``df`` the values at the offsets, by an equi-join on the place."""
    moved = df.select(*keys, F.explode(F.array(*[F.struct((F.col("px") - dx).alias("px"), (F.col("py") - dy).alias("py"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.col(value).alias("value")) for dx, dy in offsets])).alias("s")).select(*keys, "s.*")
    return df.select(*keys, "px", "py").join(moved, [*keys, "px", "py"])


def disk(radius: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy, h in disk_rows(radius) for dx in range(-h, h + 1)]


def disk_percentiles(df: DataFrame, radius: int, shares: tuple[float, ...] = (0.2, 0.8), value: str = "z", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, px, py, p0, p1, ...: exact percentiles (linear between ranks) of the values in the disk."""
    near = neighbours(df, disk(radius), value, keys)
    return near.groupBy(*keys, "px", "py").agg(*[F.percentile("value", F.lit(s)).alias(f"p{i}") for i, s in enumerate(shares)])


def morphology(df: DataFrame, radius: int, flag: str, keys: tuple[str, ...] = (), dilate: bool = False) -> DataFrame:
    """keys, px, py, ``flag``: eroded (all of the disk that is present is set) or dilated (any is)."""
    near = disk_extremes(df.withColumn("_f", F.col(flag).cast("int")), radius, "_f", keys)
    return near.select(*keys, "px", "py", (F.col("disk_max" if dilate else "disk_min") > 0).alias(flag))


def opened(df: DataFrame, radius: int, flag: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Binary opening: erosion, then dilation."""
    return morphology(morphology(df, radius, flag, keys), radius, flag, keys, dilate=True)


def corr_filter(df: DataFrame, threshold: float = 80, radius: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """The cells of ``df`` (px, py, z, corr) that remain where low correlation, opened by a disk, is taken out."""
    good = opened(df.withColumn("good", F.col("corr") >= threshold), radius, "good", keys)
    return df.join(good.where("good"), [*keys, "px", "py"], "left_semi")


def _three(df: DataFrame, value: str, keys: tuple[str, ...]) -> tuple[DataFrame, dict[tuple[int, int], Column]]:
    around = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    near = neighbours(df, around, value, keys)
    at = {o: f"_z{i}" for i, o in enumerate(around)}
    g = near.groupBy(*keys, "px", "py").agg(*[F.max(F.when((F.col("dx") == o[0]) & (F.col("dy") == o[1]), F.col("value"))).alias(n) for o, n in at.items()])
    return g, {o: F.col(n) for o, n in at.items()}


def slope(df: DataFrame, res: float, value: str = "z", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, px, py, slope (degrees), aspect (degrees from north, clockwise, downhill) by Horn's weights.

    Null where one of the eight neighbours is missing.
    """
    g, z = _three(df, value, keys)
    gx = ((z[1, 1] + 2 * z[1, 0] + z[1, -1]) - (z[-1, 1] + 2 * z[-1, 0] + z[-1, -1])) / (8 * res)
    gy = ((z[-1, 1] + 2 * z[0, 1] + z[1, 1]) - (z[-1, -1] + 2 * z[0, -1] + z[1, -1])) / (8 * res)
    aspect = F.pmod(F.degrees(F.atan2(-gx, -gy)) + 360, F.lit(360.0))
    return g.select(*keys, "px", "py", F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))).alias("slope"), aspect.alias("aspect"))


def curvature(df: DataFrame, res: float, value: str = "z", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, px, py, curvature: the largest curvature of the quartic surface through a pixel and its neighbours."""
    g, z = _three(df, value, keys)
    d = ((z[-1, 0] + z[1, 0]) / 2 - z[0, 0]) / res**2
    e = ((z[0, -1] + z[0, 1]) / 2 - z[0, 0]) / res**2
    f = (-z[-1, 1] + z[1, 1] + z[-1, -1] - z[1, -1]) / (4 * res**2)
    return g.select(*keys, "px", "py", (-d - e + F.sqrt((d - e) * (d - e) + f * f)).alias("curvature"))
