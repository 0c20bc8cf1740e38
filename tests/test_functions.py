import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from elevspark.functions import geo, models, student
from elevspark.functions.dates import scene_date, year_fraction


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def integral(f, a, b):
    x, w = np.polynomial.legendre.leggauss(400)
    return (b - a) / 2 * sum(w * f((b - a) / 2 * x + (a + b) / 2))


def cov(h, a, m, c):
    if m == "Sph":
        return np.where(h < a, c * (1 - 1.5 * h / a + 0.5 * (h / a) ** 3), 0)
    if m == "Exc":
        return c * np.exp(-np.sqrt(h / a))
    return c * np.exp(-h / a)


@pytest.mark.parametrize("p,df,want", [(0.975, 10, 2.228139), (0.995, 5, 4.032143), (0.84, 1, math.tan(math.pi * 0.34)), (0.975, 200, 1.971896)])
def test_student(p, df, want):
    assert student.quantile(p, df) == pytest.approx(want, abs=1e-6)


def test_student_expression_meets_its_table(spark):
    rows = spark.range(0, 403).select("id", student.t_two_sided(F.col("id"), 0.95).alias("t")).collect()
    assert rows[0].t is None
    assert all(r.t == pytest.approx(student.quantile(0.975, r.id), abs=1e-8) for r in rows[1:])


@pytest.mark.parametrize("m", ["Sph", "Exp", "Exc"])
@pytest.mark.parametrize("area", [2e4, 5e6])
def test_effective_samples_match_quadrature(spark, m, area):
    r = one(spark, c=models.neff_circ(area, [(300.0, m, 2.0), (900.0, "Exp", 0.5)]), r=models.neff_rect(area, 60.0, [(300.0, m, 2.0)]))
    f = lambda h: h * (cov(h, 300, m, 2.0) + cov(h, 900, "Exp", 0.5))
    top = math.sqrt(area / math.pi)
    parts = sum(integral(f, lo, hi) for lo, hi in zip([0, min(300, top)], [min(300, top), top], strict=True))
    assert r.c == pytest.approx(2.5 * area / (2 * math.pi * parts), rel=1e-8)
    w = min(60.0, area / 60.0)
    edges = np.linspace(w / 2, area / w, 100)
    g = lambda lo, hi: sum(integral(lambda h: h * cov(h, 300, m, 2.0), a, b) for a, b in ((min(lo, 300), min(hi, 300)), (max(lo, 300), max(hi, 300))) if b > a)
    total = g(0, w / 2) + sum(g(a, b) * 2 / math.pi * math.atan(w / (a + b)) for a, b in zip(edges, edges[1:], strict=False))
    assert r.r == pytest.approx(2 * area / (2 * math.pi * total), rel=1e-6)


def test_utm_known_point_and_round_trip(spark):
    r = one(spark, a=geo.utm_forward(F.lit(0.0), F.lit(3.0), F.lit(32631)), b=geo.utm_forward(F.lit(45.0), F.lit(3.0), F.lit(32631)), c=geo.utm_forward(F.lit(-33.0), F.lit(151.5), F.lit(32756)))
    assert (r.a.x, r.a.y) == pytest.approx((500000, 0), abs=1e-6)
    assert r.b.y == pytest.approx(4982950.400, abs=2e-3)  # 0.9996 of the meridian's length to 45 degrees
    back = one(spark, p=geo.utm_inverse(F.lit(r.c.x), F.lit(r.c.y), F.lit(32756))).p
    assert (back.lat, back.lon) == pytest.approx((-33.0, 151.5), abs=1e-8)


def test_tiles_zones_and_edges(spark):
    names = [one(spark, n=geo.tile_name(F.lit(a), F.lit(b))).n for a, b in ((0.5, 0.5), (-0.5, -0.5), (-1.0, -180.0), (89.9, 179.9))]
    assert names == ["N00E000", "S01W001", "S01W180", "N89E179"]
    assert [one(spark, z=geo.utm_zone(F.lit(x))).z for x in (-180.0, 0.0, 179.9, 180.0)] == [1, 31, 60, None]
    assert one(spark, e=geo.utm_epsg(F.lit(90.0), F.lit(0.0))).e is None
    assert one(spark, n=geo.utm_name(F.lit(32733)), e=geo.epsg_of_name(F.lit("33S")), x=geo.epsg_of_name(F.lit("?"))).asDict() == {"n": "33S", "e": 32733, "x": None}


def test_signed_distances(spark):
    r = one(spark, a=geo.haversine(F.lit(1.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0)), b=geo.haversine(F.lit(0.0), F.lit(179.5), F.lit(0.0), F.lit(-179.5)))
    assert r.a == pytest.approx(2 * math.pi * geo.EARTH_RADIUS / 180) and r.b == pytest.approx(math.pi * geo.EARTH_RADIUS / 180)


def test_polygons(spark):
    ring = geo.ring_of_box(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(2.0))
    r = one(spark, a=geo.ring_area(ring), p=geo.ring_perimeter(ring), c=geo.ring_centroid(ring), i=geo.in_ring(F.lit(1.0), F.lit(1.0), ring), o=geo.in_ring(F.lit(5.0), F.lit(1.0), ring), b=geo.buffered_area_ratio(ring, 1.0))
    assert (r.a, r.p, r.c.x, r.c.y, r.i, r.o) == (8.0, 12.0, 2.0, 1.0, True, False)
    assert r.b == pytest.approx((12 + math.pi) / 8 * 100)


def test_ring_test_keeps_its_columns_in_a_new_session():
    """The first columns of a session have the numbers that Spark gives lambda variables when it compares expressions."""
    code = """
from pyspark.sql import SparkSession, functions as F
from elevspark.functions import geo
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
points = spark.range(8).select("id", *[(F.col("id") + 0.5).alias(f"c{k}") for k in range(24)])
features = spark.range(2).select(F.col("id").alias("f"), geo.ring_of_box(F.lit(0), F.lit(0), 3 + F.col("id"), 9 + F.col("id")).alias("ring"))
for k in range(23):
    met = points.join(features, F.col("id") >= F.col("f")).where(geo.in_ring(F.col(f"c{k}"), F.col(f"c{k + 1}"), F.col("ring")))
    assert [tuple(r) for r in met.select("f", "id").sort("f", "id").collect()] == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (1, 3)], k
"""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=here, env=os.environ | {"PYTHONPATH": here}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-2000:]


def test_dates(spark):
    names = ["AST_L1A_00307092013101112_z", "SETSM_a_20130709_b", "aerodem_19850101_x", "SETSM_a_2013139_b", "other_x_20130101", "AST_x", ""]
    got = [r.t for r in spark.createDataFrame([(n,) for n in names], "n string").select(scene_date(F.col("n")).alias("t")).collect()]
    assert [str(t) if t else None for t in got] == ["2013-07-09 10:11:12", "2013-07-09 00:00:00", "1985-01-01 00:00:00", None, None, None, None]
    y = one(spark, a=year_fraction(F.lit("2012-07-02 00:00:00").cast("timestamp_ntz")), b=year_fraction(F.lit("2013-01-01 00:00:00").cast("timestamp_ntz")))
    assert y.a == pytest.approx(2012.5) and y.b == 2013.0
