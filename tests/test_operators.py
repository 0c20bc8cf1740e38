"""Operators on small inputs: closed forms, invariances, and the choices where the published workflow is ambiguous."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from elevspark.functions.student import quantile
from elevspark.operators import aggregate, error_model, filters, geometry, gp, hypso, neighbourhood, regression, timejoin, validate, variograms
from elevspark.operators.regression import robust_line


def line_data(n=12, seed=0):
    rng = np.random.default_rng(seed)
    x = np.sort(rng.uniform(0, 20, n))
    return x, 3 + 0.7 * x + rng.normal(0, 1, n), rng.uniform(0.5, 2, n)


def frame(spark, x, y, w, key=1):
    return spark.createDataFrame([(key, float(a), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)], "k long, t double, z double, w double")


def test_lines_match_normal_equations_and_invariances(spark):
    x, y, w = line_data()
    fits = {}
    for name, yy, ww in (("ols", y, np.ones(12)), ("wls", y, w), ("shift", y + 500, w), ("scale", y * 3, w), ("far", y, w)):
        xx = x + 2000 if name == "far" else x
        fits[name] = regression.wls(frame(spark, xx, yy, ww), ["k"]).first()
    a = np.stack([np.ones(12), x], 1)
    for name, ww in (("ols", np.ones(12)), ("wls", w)):
        beta = np.linalg.solve(a.T @ (a * ww[:, None]), a.T @ (ww * y))
        res = y - a @ beta
        sigma = np.sqrt(np.sum(ww * res**2) / 10)
        sxx = np.sum(ww * (x - np.average(x, weights=ww)) ** 2)
        f = fits[name]
        assert (f.intercept, f.slope) == pytest.approx(tuple(beta)) and f.sigma == pytest.approx(sigma)
        assert f.slope_ci == pytest.approx(quantile(0.84, 10) * sigma / np.sqrt(sxx))
    plain = regression.ols(frame(spark, x, y, w), ["k"]).first()
    assert (plain.slope, plain.slope_ci) == pytest.approx((fits["ols"].slope, fits["ols"].slope_ci))
    assert fits["shift"].slope == pytest.approx(fits["wls"].slope) and fits["scale"].slope == pytest.approx(3 * fits["wls"].slope) and fits["far"].slope == pytest.approx(fits["wls"].slope)


def test_few_points_and_nulls(spark):
    rows = [(1, 0.0, 1.0, 1.0), (1, 1.0, 2.0, 1.0), (2, 0.0, 1.0, 1.0), (3, 0.0, 1.0, 1.0), (3, 1.0, 2.0, 1.0), (3, 2.0, 3.5, 1.0), (3, None, 9.0, 1.0), (3, 4.0, float("nan"), 1.0)]
    got = {r.k: r for r in regression.ls(spark.createDataFrame(rows, "k long, t double, z double, w double"), ["k"], w="w").collect()}
    assert got[1].slope is None and got[1].slope_ci is None and got[1].intercept == pytest.approx(1.0)
    assert got[2].slope is None and got[3].n == 3 and got[3].x_max == 2.0  # dates of the pixel's own valid observations


def test_lines_of_one_date_are_void_whatever_the_weights(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(t), float(z), float(w)) for k, (t, z, w) in enumerate(rng.uniform(0.1, 20, (200, 3)))] + [(k, 7.7, float(k), float(w)) for k, w in zip([900] * 5 + [901] * 3, rng.uniform(0.001, 0.1, 8), strict=True)]
    df = spark.createDataFrame(rows, "k long, t double, z double, w double")
    for got in (regression.wls(df, ["k"]), regression.ls(df, ["k"], w="w")):
        assert got.where("slope IS NOT NULL OR slope_ci IS NOT NULL OR intercept IS NOT NULL").count() == 0 and got.count() == 202
    assert regression.wls(df, ["k"]).where("sxx <> 0").count() == 0


def test_filtered_line_drops_points_outside_the_band(spark):
    x, y, w = line_data(30)
    y[7] += 40
    one = regression.ls(frame(spark, x, y, np.ones(30)), ["k"], w="w", conf_filter=0.99).first()
    assert one.n < 30


def test_robust_line():
    x = np.arange(20.0)
    y = 2 * x + np.sin(x)
    y[5] = 400
    slope, _, keep = robust_line(x, y, np.ones(20))
    assert not keep[5] and slope == pytest.approx(2, abs=0.05)
    slope, _, keep = robust_line(x, 2 * x, np.ones(20))
    assert keep.all() and slope == pytest.approx(2)  # no spread: nothing is an outlier
    assert np.isnan(robust_line(np.zeros(3), np.ones(3), np.ones(3))[0])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=3, max_size=30), st.floats(-5, 5))
def test_robust_line_shifts_with_the_data(ys, shift):
    x = np.arange(float(len(ys)))
    a, b = robust_line(x, np.array(ys), np.ones(len(ys))), robust_line(x, np.array(ys) + shift, np.ones(len(ys)))
    if (a[2] == b[2]).all():
        assert a[0] == pytest.approx(b[0], abs=1e-6, nan_ok=True)


def test_gp_recovers_a_series_and_drops_outliers():
    rng = np.random.default_rng(0)
    t = np.sort(rng.uniform(0, 16, 60))
    z = 100 - 2 * t + rng.normal(0, 2, 60)
    z[30] += 500
    grid = np.arange(0, 17, 0.5)
    mean, sigma, keep = gp.fit_series(t, z, np.full(60, 3.0), grid)
    assert not keep[30] and keep.sum() >= 55
    assert np.abs(mean - (100 - 2 * grid))[2:-2].max() < 8 and (sigma > 0).all()
    moved, _, _ = gp.fit_series(t, z + 1000, np.full(60, 3.0), grid)
    assert np.allclose(moved, mean + 1000)
    nothing = gp.fit_series(t[:1], z[:1], np.ones(1), grid)
    assert np.isnan(nothing[0]).all() and not nothing[2].any()
    stable, _, _ = gp.fit_series(t, z, np.full(60, 3.0), grid, unstable=False)
    assert np.isfinite(stable).all()
    own, _, _ = gp.fit_series(t, z, np.full(60, 3.0), grid, kernel=lambda a, b: 100 * np.exp(-((a[:, None] - b[None, :]) ** 2)))
    assert np.isfinite(own).all()


def test_a_trend_is_taken_out_once_or_each_round(monkeypatch):
    lines = []
    monkeypatch.setattr(gp, "robust_line", lambda *a: lines.append(len(a[0])) or (-2.0, 100.0, None))
    t = np.linspace(0, 16, 40)
    z = 100 - 2 * t + np.sin(7 * t)
    z[[4, 30]] += 300
    first = gp.fit_series(t, z, np.full(40, 2.0), t, robust_trend=True)
    assert lines == [40] and not first[2][[4, 30]].any() and np.abs(first[0] - (100 - 2 * t)).max() < 5
    lines.clear()
    gp.fit_series(t, z, np.full(40, 2.0), t, robust_trend=True, refit_trend=True)
    assert len(lines) > 2 and lines[-1] < 40


def test_time_filter_boundaries(spark):
    rows = [(0.0, 100000.0), (365.24, -149.9), (365.24, -151.0), (-365.24, 149.9), (365.24, 129.0), (365.24, 131.0)]
    df = spark.createDataFrame([(i, d, z, 0.0) for i, (d, z) in enumerate(rows)], "i int, days double, z double, ref double")
    assert [r.i for r in filters.time_filter(df, "ref", "days", rate=(-50.0, 30.0)).orderBy("i").collect()] == [0, 1, 3, 4]
    assert [r.i for r in filters.time_filter(df, "ref", "days", rate=30.0).orderBy("i").collect()] == [4]
    heights = spark.createDataFrame([(x,) for x in (-401.0, -400.0, 8900.0, 8901.0, None)], "z double")
    assert filters.elevation_range(heights).count() == 2
    dems = spark.createDataFrame([("a", 19.9), ("b", 20.0), ("c", None)], "dem string, uncert double")
    assert [r.dem for r in filters.rmse_filter(spark.createDataFrame([("a",), ("b",), ("c",)], "dem string"), dems).collect()] == ["a"]


def grid(spark, n=9):
    return spark.createDataFrame([(x, y, float(3 * x - 2 * y)) for x in range(n) for y in range(n) if (x, y) != (4, 4)], "px int, py int, z double")


def test_neighbourhoods(spark):
    cells = {(r.px, r.py): r.z for r in grid(spark).collect()}
    for r in neighbourhood.disk_extremes(grid(spark), 2).collect():
        near = [z for (x, y), z in cells.items() if (x - r.px) ** 2 + (y - r.py) ** 2 <= 4]
        assert (r.disk_min, r.disk_max) == (min(near), max(near))
    for r in neighbourhood.disk_percentiles(grid(spark), 2).collect():
        near = [z for (x, y), z in cells.items() if (x - r.px) ** 2 + (y - r.py) ** 2 <= 4]
        assert (r.p0, r.p1) == pytest.approx(tuple(np.percentile(near, [20, 80])))
    flat = {(r.px, r.py): r for r in neighbourhood.slope(grid(spark), 1.0).collect()}
    assert flat[1, 1].slope == pytest.approx(np.degrees(np.arctan(np.hypot(3, 2)))) and flat[0, 0].slope is None and flat[3, 3].slope is None
    assert flat[1, 1].aspect == pytest.approx(np.degrees(np.arctan2(-3, 2)) % 360)
    bowl = spark.createDataFrame([(x, y, float(x * x)) for x in range(3) for y in range(3)], "px int, py int, z double")
    assert neighbourhood.curvature(bowl, 1.0).where("curvature IS NOT NULL").first().curvature == pytest.approx(0.0)


def test_error_model(spark):
    err = error_model.observation_error
    r = spark.range(1).select(err(F.lit(3.0), F.lit(100.0), F.lit(0.0)).alias("a"), err(F.lit(3.0), F.lit(0.0), F.lit(60.0)).alias("b"), err(F.lit(3.0), F.lit(90.0), F.lit(10.0)).alias("c"), err(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0)).alias("d")).first()
    assert r.a == pytest.approx(3.0) and r.b == 300 and r.d == 300
    assert r.c == pytest.approx(np.sqrt(9 + (220 * np.tan(np.radians(10))) ** 2 + 2**2.5))
    slopes = spark.createDataFrame([(1, 10.0), (1, 80.0), (1, 20.0), (2, 75.0)], "pixel int, slope double")
    ref = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "pixel int, slope double")
    assert {x.pixel: x.slope for x in error_model.median_slope(slopes, ["pixel"], ref).collect()} == {1: 15.0, 2: 6.0, 3: 7.0}


def test_nmad_scales_and_empty_bins_stay(spark):
    v = [1.0, 2.0, 4.0, 8.0, 100.0]
    df = spark.createDataFrame([(None if i == 0 else "g", x, -3 * x) for i in (0, 1) for x in v], "k string, a double, b double")
    for r, s in zip(error_model.nmad_by(df, ["k"], "a").orderBy("k").collect(), error_model.nmad_by(df, ["k"], "b").orderBy("k").collect(), strict=True):
        assert r.nmad == pytest.approx(1.4826 * np.median(np.abs(np.array(v) - 4))) and s.nmad == pytest.approx(3 * r.nmad) and r.n == 5
    bins = error_model.variance_by_bins(df, "b", {"a": [0.0, 5.0, 50.0, 60.0]}).orderBy("bin_a").collect()
    assert [b.n for b in bins] == [6, 2, 0] and bins[2].nmad is None


def joins(df, column):
    """The kinds of the planned joins that compare ``column``; small inputs are what the optimiser would broadcast."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [line.split("Join")[0].split()[-1] + "Join" for line in plan.splitlines() if "Join" in line and column in line.split("Join")[1]]


def test_spatial_variogram_merges_places(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, float(a), float(b), None if i % 17 == 0 else float(c)) for i, (a, b, c) in enumerate(np.column_stack([rng.integers(-6, 7, (300, 2)), rng.normal(1000, 5, 300)]))]
    out = variograms.spatial_variogram(spark.createDataFrame(rows, "id int, k int, x double, y double, z double"), ["k"], 4.0, 4)
    want = {}
    for i, k, x, y, z in rows:
        for j, k2, x2, y2, z2 in rows[i + 1 :]:
            d = np.hypot(x - x2, y - y2)
            if k == k2 and 0 < d <= 4:
                want.setdefault((k, float(np.ceil(d))), []).append(None if z is None or z2 is None else (z - z2) ** 2)
    got = {(r.k, r.lag): r for r in out.collect()}
    assert {g: r.n for g, r in got.items()} == {g: len(v) for g, v in want.items()}
    assert all(r.gamma == pytest.approx(np.mean([v for v in want[g] if v is not None]) / 2) for g, r in got.items())


def test_spatial_variogram_deals_dense_cells_and_broadcasts_none(spark, monkeypatch):
    df = spark.range(400).selectExpr("id", "1 AS k", "double(id % 20) AS x", "double(id div 20) AS y", "double(id * id % 97) AS z")
    out = variograms.spatial_variogram(df, ["k"], 9.0, 3)
    assert set(joins(out, "_cx")) == {"SortMergeJoin"}
    whole = {r.lag: (r.gamma, r.n) for r in out.collect()}
    monkeypatch.setattr(variograms, "PART", 7)
    dealt = {r.lag: (r.gamma, r.n) for r in variograms.spatial_variogram(df, ["k"], 9.0, 3).collect()}
    assert len(whole) == 3 and dealt == {lag: (pytest.approx(g), n) for lag, (g, n) in whole.items()}


def test_spatial_variogram_settles_edges_as_the_sql_does(spark):
    grid = [((k * 37 % 1700 / 10 - 85) * 100, (k * 91 % 3600 / 10 - 180) * 100) for k in range(61200) if k * 37 % 1700 < 150 and k * 91 % 3600 < 150]
    grid += [(-4090.0000000000005, -4079.9999999999995), (-4369.999999999999, -5040.0), (7639.999999999998, -6559.999999999999), (7080.000000000001, -8480.0)]  # a lag apart with plain products
    rows = [(i, 1, x, y, float(i * i % 97)) for i, (x, y) in enumerate([*grid, (-1e-20, 9000.0), (2500.0, 9000.0), (-1e-20, 9e5), (2500.0000000000005, 9e5)])]
    df = spark.createDataFrame(rows, "id int, k int, x double, y double, z double")
    con = duckdb.connect()
    con.register("p", pd.DataFrame(rows, columns=["id", "k", "x", "y", "z"]))
    sql = "SELECT ceil(d / 250) * 250 AS lag, count(*), avg(sq) / 2 FROM (SELECT {} AS d, (a.z - b.z) * (a.z - b.z) AS sq FROM p a JOIN p b ON a.id < b.id) WHERE d <= 2500 AND d > 0 GROUP BY lag"
    want, plain = ({lag: (n, pytest.approx(v)) for lag, n, v in con.execute(sql.format(d)).fetchall()} for d in ("sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))", "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"))
    out = variograms.spatial_variogram(df, ["k"], 2500.0, 10, as_pow=True)
    assert {r.lag: (r.n, r.gamma) for r in out.collect()} == want and {k: v[0] for k, v in want.items()} != {k: v[0] for k, v in plain.items()}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Aggregate" in plan.split("ArrowEvalPython")[1].split("SortMergeJoin")[0]  # of sums, not of pairs


def test_points_in_features_share_places_and_broadcast_no_cells(spark, tmp_path):
    spark.range(500).selectExpr("id", "double(id % 25) / 2 AS x", "double(id % 40) / 4 AS y").write.parquet(f"{tmp_path}/points")
    points = spark.read.parquet(f"{tmp_path}/points")
    rings = {1: [(0, 0), (3, 0.5), (4, 3), (2, 2), (0.5, 4)], 2: [(5, 5), (11, 5), (11, 9.5), (5, 9.5)], 3: [(1, 1), (12, 9), (1, 9)]}
    spark.createDataFrame([(k, [(float(a), float(b)) for a, b in ring]) for k, ring in rings.items()], "rgiid int, ring array<struct<x: double, y: double>>").write.parquet(f"{tmp_path}/features")
    features = spark.read.parquet(f"{tmp_path}/features")
    out = geometry.points_in_features(points, features, 1.5).select("id", "rgiid")

    def inside(x, y, ring):
        return sum((y0 > y) != (y1 > y) and x < x0 + (y - y0) / (y1 - y0) * (x1 - x0) for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2

    want = {(p.id, k) for p in points.collect() for k, ring in rings.items() if inside(p.x, p.y, ring)}
    assert sorted((r.id, r.rgiid) for r in out.collect()) == sorted(want) and len(want) > 100
    assert set(joins(out, "_cell")) == {"SortMergeJoin"} and "BroadcastHashJoin" not in joins(out, "x")
    mask = geometry.mask_of(points, features, 1.5, "rgiid", 2, exclude=True, keys=("id",))
    assert sorted(r.id for r in mask.collect()) == sorted({i for i, k in want if k != 2}) and set(joins(mask, "_cell")) == {"SortMergeJoin"}


def test_mask_repeats_no_pixel_for_each_feature(spark):
    pixels = spark.range(400).selectExpr("id", "double(id % 20) / 2 AS x", "double(id % 10) AS y")
    ring = F.array(*[F.struct((F.col("id") % 3 + a).cast("double").alias("x"), F.lit(b).alias("y")) for a, b in ((0, 0.0), (4, 0.0), (4, 6.0), (0, 6.0))])
    mask = geometry.raster_mask(pixels, spark.range(90).select(ring.alias("ring")), 2.0, ["id"])
    assert sorted(r.id for r in mask.collect()) == [i for i in range(400) if i % 20 / 2 < 6 and i % 10 < 6]
    assert "LeftSemi" in next(line for line in mask._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line)


def test_variogram_windows_overlap(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 2.0, 4.0), (1, 2, 3.0, 6.0)], "pixel int, obs_id int, t double, z double")
    got = {r.lag: (r.gamma, r.n) for r in variograms.temporal_variogram(df, ["pixel"], 1.0, 4.0).collect()}
    pairs = {2.0: 16.0, 1.0: 4.0, 3.0: 36.0}
    want = {}
    for h in range(4):
        sq = [s for d, s in pairs.items() if h - 1 <= d <= h + 1]
        if sq:
            want[float(h)] = (np.mean(sq) / 2, len(sq))
    assert got == want
    assert variograms.temporal_variogram_median(df, ["pixel"], 1.0, 4.0, least=4).count() == 0


def test_time_joins(spark):
    right = spark.createDataFrame([(1, 0.0, 10.0), (1, 4.0, 30.0), (2, 1.0, 5.0)], "k int, t double, z double")
    left = spark.createDataFrame([(1, -1.0, "a"), (1, 0.0, "b"), (1, 1.0, "c"), (1, 2.0, "d"), (1, 9.0, "e"), (2, 3.0, "f"), (3, 0.0, "g")], "k int, t double, id string")
    got = {r.id: r.z for r in timejoin.interpolate(left, right, ["k"], "t", ["z"]).collect()}
    assert got == {"a": None, "b": 10.0, "c": 15.0, "d": 20.0, "e": None, "f": None, "g": None}
    near = {r.id: (r.near_t, r.near_z, r.lag) for r in timejoin.nearest(left, right, ["k"], "t", ["z"]).collect()}
    assert near == {"a": (0.0, 10.0, 1.0), "b": (0.0, 10.0, 0.0), "c": (0.0, 10.0, 1.0), "d": (0.0, 10.0, 2.0), "e": (4.0, 30.0, 5.0), "f": (1.0, 5.0, 2.0), "g": (None, None, None)}


def test_two_step_nearest_lag(spark):
    kept = spark.createDataFrame([(1, 0.0), (1, 5.0), (2, 3.0)], "pixel int, t double")
    dates = spark.createDataFrame([(0.0,), (4.0,)], "t double")
    got = [(r.pixel, r.t, r.stack_t, r.lag) for r in timejoin.lag_to_closest(kept, dates, spark.createDataFrame([(2.1,)], "t double"), ["pixel"]).collect()]
    assert got == [(1, 2.1, 4.0, pytest.approx(2.9))]  # nearest to the stack date 4 is the observation at 5; one observation is too few


def test_full_change_and_campaigns(spark):
    cube = spark.createDataFrame([(1, 0, 1.0, 3.0), (1, 5, 9.0, 4.0), (2, 0, 1.0, 400.0), (2, 5, 2.0, 400.0)], "pixel int, t int, z double, z_ci double")
    assert {r.pixel: (r.dh, r.err) for r in timejoin.full_change(cube, ["pixel"]).collect()} == {1: (8.0, 5.0), 2: (None, None)}
    c = spark.createDataFrame([("A", 100.0, 120.0)], "name string, first_day double, last_day double")
    p = spark.createDataFrame([(1, 91.0), (2, 89.0), (3, 130.0), (4, 131.0), (5, 110.5)], "id int, day double")
    assert {r.id: r.mid_day for r in timejoin.snap_to_campaign(p, c, "day").collect()} == {1: 110.0, 3: 110.0, 5: 110.0}


def test_void_bins_and_edges(spark):
    rows = [(1, float(x), None if x in (150, 350) else float(x), 2.0) for x in (50, 150, 250, 350)] + [(2, 50.0, 1.0, 1.0), (2, 150.0, None, 1.0)]
    got = {(r.k, r.x): r for r in hypso.fill_voids(spark.createDataFrame(rows, "k int, x double, y double, e double"), ["k"], "x", "y", "e").collect()}
    assert got[1, 150.0].y == pytest.approx(150) and got[1, 150.0].e == pytest.approx(np.sqrt(0.5) * 2) and got[1, 150.0].lin_err == pytest.approx(100**2 / 8 * 0.002)
    assert got[1, 350.0].y == pytest.approx(350)  # two on one side: extrapolated
    assert got[2, 150.0].y is None
    pixels = spark.createDataFrame([(1, i, float(r)) for i, r in enumerate([-50, 0, 99, 100, 200])] + [(2, 9, 5.0)], "f int, pixel int, ref double")
    bins = {(r.f, r.pixel): r.bin for r in hypso.elevation_bins(pixels, ["f"], few=1).collect()}
    assert bins == {(1, 0): -100.0, (1, 1): 0.0, (1, 2): 0.0, (1, 3): 100.0, (2, 9): 0.0}  # the highest pixel lies on an edge: in no bin


def test_each_bin_from_the_others(spark):
    rows = [(1, 0.0, 1.0, 2.0), (1, 100.0, 50.0, 2.0), (1, 200.0, None, None), (1, 300.0, 7.0, 4.0), (2, 0.0, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, x double, y double, e double")
    got = {(r.k, r.x): (r.y, r.e, r.lin_err) for r in hypso.fill_voids(df, ["k"], "x", "y", "e", leave_one_out=True).collect()}
    line = lambda x0, p, q: ((q[0] - x0) / (q[0] - p[0]) * p[1] + (x0 - p[0]) / (q[0] - p[0]) * q[1], np.hypot((q[0] - x0) / (q[0] - p[0]) * p[2], (x0 - p[0]) / (q[0] - p[0]) * q[2]))
    a, b, c = (0.0, 1.0, 2.0), (100.0, 50.0, 2.0), (300.0, 7.0, 4.0)
    for x0, p, q in ((0.0, b, c), (100.0, a, c), (200.0, b, c), (300.0, b, a)):
        assert got[1, x0][:2] == pytest.approx(line(x0, p, q)) and got[1, x0][2] == pytest.approx((p[0] - x0) ** 2 / 8 * 0.002)
    assert got[2, 0.0] == (3.0, 1.0, None)  # there are no others


def test_bins_by_a_share_of_the_range(spark):
    rows = [("a", i, 103.0 + i) for i in range(60)] + [("flat", i, 200.0) for i in range(60)] + [("few", i, 103.0 + i) for i in range(3)]
    df = spark.createDataFrame(rows, "f string, pixel int, ref double")
    got = {}
    for r in hypso.elevation_bins(df, ["f"], percent=10.0).collect():
        got.setdefault((r.f, r.bin, r.bin_mid, r.bin_size), []).append(r.ref)
    # 162 - 100 is cut into sevenths: 6.2 rounded up
    want = {("a", 100.0 + 7 * k, 103.5 + 7 * k, 7.0): [103.0 + i for i in range(60) if 7 * k <= 3 + i < 7 * k + 7] for k in range(9)}
    assert {k: sorted(v) for k, v in got.items() if k[0] == "a"} == want
    assert [k[1:] for k in got if k[0] == "few"] == [(100.0, pytest.approx(102.505), pytest.approx(5.01))]
    assert [(k[1], len(v)) for k, v in got.items() if k[0] == "flat"] == [(200.0, 60)]
    assert hypso.elevation_bins(df.where("f = 'flat'"), ["f"]).count() == 60


def test_covariance_limits(spark):
    rows = [(1, 100.0 * i, 2.0, 30.0, 5.0, c) for i, c in ((0, 1e12), (1, 1e12))] + [(2, 100.0 * i, 2.0, 30.0, 5.0, 1e-9) for i in range(2)]
    got = {r.k: r.err_total for r in hypso.hypso_covariance(spark.createDataFrame(rows, "k int, bin_mid double, err double, slope double, area double, crange double"), ["k"]).collect()}
    assert got[1] == pytest.approx(2.0, rel=1e-4) and got[2] == pytest.approx(np.sqrt(2))  # fully correlated: linear; not at all: in quadrature


def test_double_covariance_matches_all_pairs(spark):
    rng = np.random.default_rng(2)
    lat = np.concatenate([rng.uniform(-89.9, 89.9, 150), rng.uniform(88, 90, 30), rng.uniform(-1, 1, 40)])
    lon = np.concatenate([rng.uniform(-180, 180, 180), rng.choice([-179.9, 179.9, 0.1], 40)])
    area, e1, e2 = rng.uniform(1, 5, 220), rng.uniform(0, 2, 220), rng.uniform(0, 1, 220)
    df = spark.createDataFrame([(1, *map(float, r)) for r in zip(lat, lon, area, e1, e2, strict=True)], "reg int, lat double, lon double, area double, e1 double, e2 double")
    got = aggregate.double_covariance(df, ["reg"], {20000.0: "e1", 200000.0: "e2"}).first().err_dh
    la, lo = np.radians(lat), np.radians(lon)
    s = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la[:, None]) * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
    d = 2 * 6373000 * np.arcsin(np.sqrt(np.clip(s, 0, 1)))
    rho = lambda r: np.where(d > r, 0, 1 - 1.5 * d / r + 0.5 * (d / r) ** 3)
    v = ((rho(20000) * np.outer(e1, e1) + rho(200000) * np.outer(e2, e2)) * np.outer(area, area)).sum()
    assert got == pytest.approx(np.sqrt(v) / area.sum())


def test_inventory_and_regions(spark):
    base = spark.createDataFrame([("a", 1, 1, 1, 0, 10.0), ("b", 2, 1, 1, 0, 20.0), ("c", 1, 2, 2, 0, 30.0), ("d", 1, 1, 2, 0, 40.0)], "rgiid string, cl int, nom int, reg int, term int, area double")
    series = spark.createDataFrame([(k, t, 1.0 if (k, t) != ("a", 2.0) else None, 0.5, 5.0, 0.9, 1.0, 1.0, 1.0) for k in "abc" for t in (1.0, 2.0)], "rgiid string, time double, dh double, err_dh double, perc_err_cont double, perc_area_meas double, perc_area_res double, valid_obs double, valid_obs_py double")
    full = aggregate.complete_inventory(series, base)
    got = {(r.rgiid, r.time): (r.dh, r.area) for r in full.collect()}
    assert len(got) == 8 and got["d", 1.0] == (None, 40.0) and got["c", 1.0] == (None, 30.0) and got["b", 1.0] == (1.0, None)
    r = {x.time: x for x in aggregate.regional_sum(full.where("reg = 1"), ["reg"]).collect()}
    # a lacks one date, so its area counts as without data and also in the dates that it has
    assert set(r) == {1.0} and r[1.0].area_nodata == 10.0 and r[1.0].area == 20.0 and r[1.0].dvol == pytest.approx(20.0)
    twice = aggregate.with_combined_regions(spark.createDataFrame([(1,), (13,), (5,)], "reg int"))
    assert sorted(x.reg for x in twice.collect()) == [1, 5, 13, 20, 21]


def test_resampling_and_overlaps(spark):
    raster = spark.createDataFrame([(x, y, float(x + 10 * y)) for x in range(4) for y in range(4)], "px int, py int, z double")
    target = spark.createDataFrame([(1, 15.0, 25.0), (2, 30.0, 30.0), (3, 35.0, 0.0), (4, 0.0, 0.0)], "tid int, x double, y double")
    got = {r.tid: r.z for r in geometry.resample(raster, target, 10.0).collect()}
    assert got == {1: pytest.approx(1.5 + 25.0), 2: 33.0, 3: None, 4: 0.0}
    tiles = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 0.91, 0.0, 1.91, 1.0), (3, 0.89, 0.0, 1.89, 1.0)], "id int, xmin double, ymin double, xmax double, ymax double")
    assert sorted(r.id for r in geometry.reference_tiles(tiles, (0.0, 0.0, 1.0, 1.0)).collect()) == [1, 3]


def test_points_on_tile_edges(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0, 5.0), (2, 1.5, 1.5, 5.0), (3, 1.0, 1.0, -201.0)], "id int, lat double, lon double, elev double")
    assert {r.id: r.tile for r in validate.tile_of_points(p).collect()} == {1: "N00E000", 2: "N01E001"}


def test_gp_goes_on_while_outliers_go_one_at_a_time(monkeypatch):
    monkeypatch.setattr(gp, "_predict", lambda kernel, t, y, v, grid: (np.zeros(len(grid)), np.full(len(grid), max(np.abs(y).max() / 4.5, 5))))
    z = 1.3 ** np.arange(90)
    _, _, keep = gp.fit_series(np.linspace(0, 16, 90), z, np.ones(90), np.linspace(0, 16, 33))
    assert 2 <= keep.sum() < 20 and z[keep].max() < 40
