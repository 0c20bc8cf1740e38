import numpy as np
import pytest
from pyspark.sql import functions as F

from elevspark import cli
from elevspark.functions import geo, models
from elevspark.operators import geometry
from elevspark.plans import pipelines
from elevspark.sources.staging import cut


def stack(spark, n=4, seed=1):
    rng = np.random.default_rng(seed)
    obs, i = [], 0
    for px in range(n):
        for py in range(n):
            for k in range(30):
                t = float(rng.uniform(0, 15))
                z = 500 + 5 * px - 1.5 * t + rng.normal(0, 1)
                obs.append((i, px, py, t, (t - 7) * 365.24, z + (2000 if k == 3 else 0), ["a", "b"][k % 2] if k else "bad", 100.0))
                i += 1
    o = spark.createDataFrame(obs, "obs_id long, px int, py int, t double, days double, z double, dem string, corr double")
    dem = spark.createDataFrame([("a", 3.0), ("b", 4.0), ("bad", 30.0)], "dem string, uncert double")
    ref = spark.createDataFrame([(x, y, 490.0 + 5 * x, 2.0, True) for x in range(n) for y in range(n)], "px int, py int, ref_z double, slope double, unstable boolean")
    return o, dem, ref


@pytest.mark.parametrize("method", ["wls", "ols", "gpr"])
def test_fit_finds_the_trend(spark, method):
    out = pipelines.fit_stack(*stack(spark), method=method, wls_filter=method == "wls").collect()
    if method == "gpr":
        ends = {}
        for r in out:
            ends.setdefault((r.px, r.py), []).append((r.t, r.z))
        for s in ends.values():
            s.sort()
            assert (dict(s)[14.0] - dict(s)[1.0]) / 13 == pytest.approx(-1.5, abs=0.5)
    else:
        assert len(out) == 16 and all(r.slope == pytest.approx(-1.5, abs=0.3) and r.n < 30 for r in out)


def test_volumes_and_rates(spark):
    pixels = [(p, 5.0 * p, "f1" if p < 60 else "f2") for p in range(120)]
    cube = spark.createDataFrame([(p, float(t), 1000 + ref - 2.0 * t, 1.0) for p, ref, _ in pixels for t in range(2000, 2005)], "pixel int, t double, z double, z_ci double")
    lags = cube.select("pixel", "t", F.lit(40.0).alias("days"))
    ref = spark.createDataFrame([(p, r) for p, r, _ in pixels], "pixel int, ref double")
    feats = spark.createDataFrame([(f, p) for p, _, f in pixels], "rgiid string, pixel int")
    series, bins = pipelines.volumes(cube, lags, ref, feats, 900.0)
    series = cut(series)
    got = {(r.rgiid, r.t): r for r in series.collect()}
    for f in ("f1", "f2"):
        assert [got[f, float(t)].dh for t in range(2000, 2005)] == pytest.approx([0, -2, -4, -6, -8])
        assert got[f, 2004.0].err_dh > 0 and got[f, 2004.0].perc_area_meas == pytest.approx(1.0)
    assert bins.count() > 0
    s = series.withColumnRenamed("t", "time").drop("area", "area_meas").withColumn("valid_obs", F.lit(1.0)).withColumn("valid_obs_py", F.lit(1.0)).withColumn("perc_err_cont", F.lit(3.0))
    base = spark.createDataFrame([("f1", 1, 1, 1, 0, 54000.0, 10.0, 45.0), ("f2", 1, 1, 2, 1, 54000.0, 10.1, 45.1)], "rgiid string, cl int, nom int, reg int, term int, area double, lon double, lat double")
    rates = {(r.reg, r.start, r.end): r for r in pipelines.regional_rates(s, base, (1, 2), years=4).collect()}
    assert set(rates) == {(g, a, b) for g in (1, 2, 20) for a, b in ((2000, 2001), (2001, 2002), (2002, 2003), (2003, 2004), (2000, 2002), (2002, 2004))}
    assert rates[20, 2000, 2002].dhdt == pytest.approx(-2.0) and rates[20, 2000, 2002].dvoldt == pytest.approx(-2 * 108000.0) and rates[1, 2000, 2001].err_dhdt > 0


def test_variograms_by_bin_and_of_points(spark):
    o, _, ref = stack(spark)
    out = pipelines.refined_variograms(o.withColumn("err", F.lit(2.0)), ref, 1.0, 5.0, [0.0, 10.0], [0.0, 495.0, 1000.0], [-5.0, 5.0])
    assert set(out) == {"slope", "height", "change"} and out["height"].select("bin").distinct().count() == 2
    rng = np.random.default_rng(0)
    pts = spark.createDataFrame([(i, 1, 0, float(i % 10), float(45 + a), float(10 + b), float(d)) for i, (a, b, d) in enumerate(rng.normal(0, 0.01, (200, 3)))], "id int, reg int, date int, dt double, lat double, lon double, dh double")
    by_region, every = pipelines.interpolation_correlation(pts, [0.0, 5.0, 10.0], [2000.0], 4)
    assert by_region.count() == every.count() > 4


def test_correlation_of_points_broadcasts_none_of_them(spark, tmp_path):
    pts = spark.range(300).selectExpr("id", "1 AS reg", "0 AS date", "double(id % 10) AS dt", "45 + id % 17 / 1000D AS lat", "10 + id % 19 / 1000D AS lon", "double(id * id % 97) AS dh")
    pts.write.parquet(f"{tmp_path}/points")  # the optimiser knows a file's size and would broadcast its copies
    by_region, _ = pipelines.interpolation_correlation(spark.read.parquet(f"{tmp_path}/points"), [0.0, 5.0, 10.0], [500.0, 2000.0], 4)
    plan = by_region._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert [x for x in plan if "SortMergeJoin" in x and "_cx" in x] and not [x for x in plan if "BroadcastHashJoin" in x and "_cx" in x]
    assert {(r.cutoff, r.nb_dt) for r in by_region.collect()} == {(c, b) for c in (500.0, 2000.0) for b in by_region.select("nb_dt").distinct().toPandas()["nb_dt"]}


def test_altimetry(spark):
    cube = spark.createDataFrame([(x, y, float(t), 100.0 + x + t, 2.0) for x in range(3) for y in range(3) for t in (0, 200)], "px int, py int, t double, z double, z_ci double")
    points = spark.createDataFrame([(1, 95.0, 5.0, 5.0, 205.0), (2, 95.0, 5.0, 5.0, -300.0), (3, 60.0, 5.0, 5.0, 1.0)], "id int, utc_day double, x double, y double, elev double")
    camp = spark.createDataFrame([("A", 90.0, 110.0)], "name string, first_day double, last_day double")
    got = pipelines.altimetry_comparison(points, camp, cube, 10.0).collect()
    assert [(r.id, r.t, r.dh, r.z_score) for r in got] == [(1, 100.0, pytest.approx(205 - 200.5), pytest.approx(4.5 / 2))]


def test_tiles_of_stacks(spark):
    p = spark.createDataFrame([(1, 45.2, 15.3), (2, 45.9, 15.9), (3, 46.1, 15.5)], "id int, lat double, lon double").withColumn("u", geo.utm_forward(F.col("lat"), F.col("lon"), F.lit(32633))).select("id", "u.*")
    assert sorted(r.id for r in geometry.tile_mask(p, 32633, "N45E015").collect()) == [1, 2]
    assert geometry.stack_tile(p, 32633).first().tile == "N45E015"
    assert sum(models.gauss_weights(11, 1.0)) == pytest.approx(1.0, abs=1e-4)
    assert spark.range(1).select(models.nearest_index(F.array(F.lit(1.0), F.lit(None), F.lit(4.0)), 3.0).alias("i")).first().i == 2


def test_command_line(spark, tmp_path):
    o, dem, ref = stack(spark, 2)
    paths = {n: str(tmp_path / n) for n in ("obs", "dem", "ref", "out")}
    for df, n in ((o, "obs"), (dem, "dem"), (ref, "ref")):
        df.write.parquet(paths[n])
    cli.main(["fit", paths["obs"], paths["dem"], paths["ref"], paths["out"], "--method", "wls", "--conf-filter", "0.99"])
    assert spark.read.parquet(paths["out"]).count() == 4
    cells = spark.createDataFrame([("a", 0, 0, 1.0)], "dem_id string, px int, py int, z double")
    cells.write.parquet(str(tmp_path / "cells"))
    spark.createDataFrame([("a", 2.0)], "dem_id string, uncert double").write.parquet(str(tmp_path / "d2"))
    cli.main(["stack", str(tmp_path / "cells"), str(tmp_path / "d2"), str(tmp_path / "stack")])
    assert spark.read.parquet(str(tmp_path / "stack")).count() == 1


def test_hypso_integrate_answers_for_every_feature(spark):
    from elevspark.plans.pair_queries import QUERIES
    from elevspark.sources.adapters import series

    d = "/root/testdata/sf0.01"
    want = {r.feature for r in series(spark, d).select("feature").distinct().collect()}
    assert {r.feature for r in QUERIES["hypso_integrate"](spark, d).select("feature").distinct().collect()} == want and max(want) >= 30


def test_reproject_answers_for_every_event(spark):
    from elevspark.plans.space_queries import QUERIES

    d = "/root/testdata/sf0.01"
    tids = QUERIES["reproject"](spark, d).select("tid").distinct().count()
    assert tids == spark.read.parquet(f"{d}/events.parquet").select("event_id").distinct().count() > 9800


def test_volume_series_has_every_step_of_the_cube(spark):
    from elevspark.plans.pipeline_queries import QUERIES
    from elevspark.sources.adapters import cube

    d = "/root/testdata/sf0.001"
    steps = {r.t for r in QUERIES["volume_series"](spark, d).select("t").distinct().collect()}
    assert steps == {float(r.t) for r in cube(spark, d).select("t").distinct().collect()} and len(steps) > 8


def tiled(spark):
    """The stack twice: as it is on one tile, and rising on another at the same places."""
    o, dem, ref = stack(spark)
    up = o.withColumn("z", 1000 - F.col("z") + F.when(F.col("z") > 1500, 5000).otherwise(0))
    both = o.withColumn("tile", F.lit("N45E015")).unionByName(up.withColumn("tile", F.lit("N45E016")))
    refs = ref.withColumn("tile", F.lit("N45E015")).unionByName(ref.withColumn("ref_z", 1000 - F.col("ref_z")).withColumn("tile", F.lit("N45E016")))
    return both, dem, refs


def test_tiles_are_fitted_apart(spark):
    o, dem, ref = tiled(spark)
    out = pipelines.fit_stack(o, dem, ref, method="wls", wls_filter=True, keys=("tile",)).collect()
    assert len(out) == 32
    for r in out:
        assert r.slope == pytest.approx(-1.5 if r.tile == "N45E015" else 1.5, abs=0.3)


def test_from_observations_to_volumes(spark):
    o, dem, ref = tiled(spark)
    series, kept = pipelines.fit_stack_kept(o, dem, ref, step=1.0, span=(0.0, 16.0), keys=("tile",))
    assert series.count() == 32 * 17
    mask = kept.groupBy("tile", "px", "py").agg(F.sum(F.col("kept").cast("int")).alias("n"), F.count("*").alias("all"))
    again = series.select("tile", "px", "py", "n_kept").distinct().join(mask, ["tile", "px", "py"]).collect()
    assert len(again) == 32 and all(r.n == r.n_kept <= r.all for r in again)
    feats = ref.select(F.when(F.col("tile") == "N45E015", "f1").otherwise("f2").alias("rgiid"), "tile", "px", "py")
    got, bins = pipelines.volumes_of_stack(o, dem, ref, feats, 900.0, keys=("tile",), step=1.0, span=(0.0, 16.0))
    last = {r.rgiid: r for r in got.where("t = 14").collect()}
    assert last["f1"].dh == pytest.approx(-21, abs=6) and last["f2"].dh == pytest.approx(21, abs=6) and last["f1"].err_dh > 0 and bins.count() > 0


def test_a_void_feature_has_null_rows_and_leaves_the_rest(spark):
    from elevspark.operators import hypso

    rows = [(f, p, float(t), None if f == "void" else -1.0 * t + p / 100, 1.0 + p % 3, 5.0 * p, 30.0) for f in ("a", "void") for p in range(80) for t in range(3)]
    df = spark.createDataFrame(rows, "rgiid string, pixel int, t double, dh double, err double, ref double, days double")
    series, _ = hypso.integrate(df, ["rgiid"], 900.0)
    alone, _ = hypso.integrate(df.where("rgiid = 'a'"), ["rgiid"], 900.0)
    got = {f: sorted(r for r in map(tuple, series.where(F.col("rgiid") == f).select("t", "dh", "err_dh", "perc_area_meas").collect())) for f in ("a", "void")}
    assert [(r[0], r[1], r[2]) for r in got["void"]] == [(float(t), None, None) for t in range(3)] and {r[3] for r in got["void"]} == {0.0}
    want = sorted(map(tuple, alone.select("t", "dh", "err_dh", "perc_area_meas").collect()))
    assert [pytest.approx(r) for r in want] == got["a"] and got["a"][2][1] == pytest.approx(-2 + 0.395, abs=0.1)


def test_rates_between_any_two_dates(spark):
    from elevspark.operators import aggregate

    rows = [(1, 2000.0 + k / 4, -10.0 * k, 0.1, 100.0, 3.0, 1.0, 1.0, 0.0, 2.0, 1.0) for k in range(60)]
    df = spark.createDataFrame(rows, "reg int, time double, dvol double, err_dh double, area double, perc_err_cont double, perc_area_meas double, perc_area_res double, area_nodata double, valid_obs double, valid_obs_py double")
    periods = spark.createDataFrame([(2000.0, 2010.0), (2003.5, 2012.25)], "start double, end double")
    got = {(r.start, r.end): r for r in aggregate.period_rates(df, periods, ["reg"]).collect()}
    assert set(got) == {(2000.0, 2010.0), (2003.5, 2012.25)} and all(r.dvoldt == pytest.approx(-40.0) for r in got.values())
    assert got[2003.5, 2012.25].valid_obs == 2.0 * 35
