"""Tiles, UTM zones, projections, distances and polygons as column expressions.

Longitudes and latitudes are degrees on WGS84; projected coordinates are metres. A ring is an
array of structs (x, y), closed or not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mean radius that distances use, and the WGS84 ellipsoid with the UTM scale.
EARTH_RADIUS = 6373000.0
SEMI_MAJOR, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
_N = FLATTENING / (2 - FLATTENING)
_A = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_INVERSE = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, and written once in the plan: formulas stay small when nested."""
    return F.transform(F.array(value), body)[0]


def _padded(x: Column, digits: int) -> Column:
    return F.lpad(F.abs(x).cast("int").cast("string"), digits, "0")


def tile_name(lat: Column, lon: Column) -> Column:
    """Name of the 1 degree tile that holds a point: its south-west corner."""
    la, lo = F.floor(lat), F.floor(lon)
    return F.concat(F.when(la >= 0, F.lit("N")).otherwise("S"), _padded(la, 2), F.when(lo >= 0, F.lit("E")).otherwise("W"), _padded(lo, 3))


def tile_corner(name: Column) -> Column:
    """struct(lat, lon) of a tile's south-west corner."""
    lat, lon = F.substring(name, 2, 2).cast("int"), F.substring(name, 5, 3).cast("int")
    return F.struct(F.when(F.substring(name, 1, 1) == "S", -lat).otherwise(lat).alias("lat"), F.when(F.substring(name, 4, 1) == "W", -lon).otherwise(lon).alias("lon"))


def tile_ring(lat: Column, lon: Column, epsg: Column, size: float = 1.0) -> Column:
    """The ring of a tile with its south-west corner at (lat, lon), in the UTM zone of ``epsg``."""
    return F.array(*[utm_forward(lat + a, lon + b, epsg) for a, b in ((0.0, 0.0), (0.0, size), (size, size), (size, 0.0))])


def utm_zone(lon: Column) -> Column:
    """Zone number by six-degree strips, without the exceptions of Norway and Svalbard; null at 180 degrees and beyond."""
    return F.when((lon >= -180) & (lon < 180), (F.floor((lon + 180) / 6) + 1).cast("int"))


def utm_epsg(lat: Column, lon: Column) -> Column:
    ok = (lat >= -90) & (lat < 90)
    return F.when(ok, F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon))


def utm_name(epsg: Column) -> Column:
    """Zone and hemisphere of an EPSG code, as in 33N."""
    return F.when(F.floor(epsg / 100).isin(326, 327), F.concat((epsg % 100).cast("int").cast("string"), F.when(F.floor(epsg / 100) == 326, F.lit("N")).otherwise("S")))


def epsg_of_name(name: Column) -> Column:
    zone = F.regexp_extract(name, r"^(\d+)[NS]$", 1)
    return F.when(zone != "", F.when(name.endswith("N"), F.lit(32600)).otherwise(F.lit(32700)) + zone.try_cast("int"))


def epsg_of_wkt(wkt: Column) -> Column:
    """The digits of the last word of a projection text."""
    return F.regexp_extract(F.element_at(F.split(wkt, " "), -1), r"(\d+)", 1).try_cast("int")


def utm_forward(lat: Column, lon: Column, epsg: Column) -> Column:
    """struct(x, y) in the UTM zone of ``epsg``, by Krueger's series to the third order (under a millimetre in a zone)."""
    north, zone = F.floor(epsg / 100) == 326, epsg % 100
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(_N) / (1 + _N)
    north_y = F.when(north, F.lit(0.0)).otherwise(F.lit(10000000.0))

    def plane(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        x, y = eta, xi
        for j, a in enumerate(_FORWARD, 1):
            x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return F.struct((500000 + SCALE * _A * x).alias("x"), (north_y + SCALE * _A * y).alias("y"))

    sphere = _let(F.struct(F.sin(phi).alias("s"), lam.alias("lam")), lambda p: F.struct(F.sinh(F.atanh(p["s"]) - e * F.atanh(e * p["s"])).alias("t"), p["lam"].alias("lam")))
    curves = _let(sphere, lambda p: F.struct(F.atan2(p["t"], F.cos(p["lam"])).alias("xi"), F.atanh(F.sin(p["lam"]) / F.sqrt(1 + p["t"] * p["t"])).alias("eta")))
    return _let(curves, plane)


def utm_inverse(x: Column, y: Column, epsg: Column) -> Column:
    """struct(lat, lon) of a point in the UTM zone of ``epsg``."""
    north, zone = F.floor(epsg / 100) == 326, epsg % 100
    xi = (y - F.when(north, F.lit(0.0)).otherwise(F.lit(10000000.0))) / (SCALE * _A)
    eta = (x - 500000) / (SCALE * _A)

    def conformal(p: Column) -> Column:
        xi_, eta_ = p["xi"], p["eta"]
        for j, b in enumerate(_INVERSE, 1):
            xi_ = xi_ - b * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
            eta_ = eta_ - b * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
        return F.struct(xi_.alias("xi"), eta_.alias("eta"))

    def sphere(p: Column) -> Column:
        return F.struct(F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])).alias("chi"), F.degrees(F.atan2(F.sinh(p["eta"]), F.cos(p["xi"]))).alias("lam"))

    def ellipsoid(p: Column) -> Column:
        phi = p["chi"]
        for j, d in enumerate(_LATITUDE, 1):
            phi = phi + d * F.sin(2 * j * p["chi"])
        return F.struct(F.degrees(phi).alias("lat"), (zone * 6 - 183 + p["lam"]).alias("lon"))

    return _let(_let(_let(F.struct(xi.alias("xi"), eta.alias("eta")), conformal), sphere), ellipsoid)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres, with signed coordinates."""
    a, b = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return EARTH_RADIUS * 2 * F.atan2(F.sqrt(s), F.sqrt(1 - s))


def snapped_extent(xmin: Column, ymin: Column, xmax: Column, ymax: Column, gsd: float, margin: int = 3) -> Column:
    """The extent on multiples of ``gsd``, ``margin`` cells wider on each side."""
    down = lambda v: v - F.pmod(v, F.lit(float(gsd)))
    pad = margin * gsd
    return F.struct((down(xmin) - pad).alias("xmin"), (down(ymin) - pad).alias("ymin"), (down(xmax) + pad).alias("xmax"), (down(ymax) + pad).alias("ymax"))


def box_overlap(a: tuple, b: tuple) -> Column:
    """Area shared by two boxes (xmin, ymin, xmax, ymax)."""
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def ring_of_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(xmin, ymin), corner(xmax, ymin), corner(xmax, ymax), corner(xmin, ymax))


def ring_extent(ring: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax)."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def _edges(ring: Column, start, merge) -> Column:
    """Fold ``merge(acc, p, q)`` over the edges; the last point joins the first."""
    n = F.size(ring)
    return F.aggregate(F.sequence(F.lit(0), n - 1), start, lambda acc, i: merge(acc, F.get(ring, i), F.get(ring, (i + 1) % n)))


def ring_area(ring: Column) -> Column:
    return F.abs(_edges(ring, F.lit(0.0), lambda acc, p, q: acc + (p["x"] * q["y"] - q["x"] * p["y"]))) / 2


def ring_perimeter(ring: Column) -> Column:
    return _edges(ring, F.lit(0.0), lambda acc, p, q: acc + F.sqrt(F.pow(q["x"] - p["x"], F.lit(2.0)) + F.pow(q["y"] - p["y"], F.lit(2.0))))


def ring_centroid(ring: Column) -> Column:
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    twice = _edges(ring, F.lit(0.0), lambda acc, p, q: acc + cross(p, q))
    x = _edges(ring, F.lit(0.0), lambda acc, p, q: acc + (p["x"] + q["x"]) * cross(p, q))
    y = _edges(ring, F.lit(0.0), lambda acc, p, q: acc + (p["y"] + q["y"]) * cross(p, q))
    return F.struct((x / (3 * twice)).alias("x"), (y / (3 * twice)).alias("y"))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside (even-odd rule; a point on a lower or left edge counts as inside).

    The point and the ring reach the edges as one value: a lambda that named columns itself could lose them in a join's
    condition, as Spark 4.1 numbers lambda variables anew from 0 there and takes a column of the same number for one of them.
    """

    def inside(s: Column) -> Column:
        def crosses(acc, p, q):
            spans = (p["y"] > s["y"]) != (q["y"] > s["y"])
            at = p["x"] + (s["y"] - p["y"]) / F.when(q["y"] == p["y"], F.lit(None)).otherwise(q["y"] - p["y"]) * (q["x"] - p["x"])
            return F.when(spans & (s["x"] < at), ~acc).otherwise(acc)

        return _edges(s["ring"], F.lit(False), crosses)

    return _let(F.struct(x.alias("x"), y.alias("y"), ring.alias("ring")), inside)


def buffered_area_ratio(ring: Column, distance: float) -> Column:
    """Percent by which a buffer enlarges a ring: exact for convex rings, too large for others."""
    area = ring_area(ring)
    return (ring_perimeter(ring) * distance + math.pi * distance**2) / area * 100


def split_at_dateline(lons: Column) -> Column:
    """Whether a ring's longitudes pass the date line (some below -160 and some above 160)."""
    return (F.array_min(lons) < -160) & (F.array_max(lons) > 160)
