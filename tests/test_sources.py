import pytest
from pyspark.sql import functions as F

from elevspark.sources import readers
from elevspark.streaming.trend import running_trend


def test_stats_take_the_first_place_there_is(spark, tmp_path):
    for place, rows in (("a/re-coreg", "['RMSE', 'NMAD']\n[9, 9]\n[1.5, 2]\n"), ("a/coreg", "['RMSE']\n[7]\n"), ("b", "['RMSE', 'x']\n[3.25]\n"), ("c/coreg", "['NMAD']\n[4]")):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "stats.txt").write_text(rows)
    got = {r.dem_id: r.stats for r in readers.read_stats(spark, str(tmp_path)).collect()}
    assert got == {"a": {"RMSE": 1.5, "NMAD": 2.0}, "b": {"RMSE": 3.25}, "c": {"NMAD": 4.0}}


def test_metadata_of_a_scene(spark):
    text = 'OBJECT = GRINGPOINTLATITUDE\n NUM_VAL = 4\n VALUE = (1.5, 2, -3.25, 4)\nEND_OBJECT = GRINGPOINTLATITUDE\nOBJECT = CALENDARDATE\n VALUE = "2013-07-09"\nEND_OBJECT\nOBJECT = SCENECLOUDCOVERAGE\n VALUE = 27\nEND_OBJECT\nOBJECT = IMAGEDATAINFORMATION3N\n VALUE = "x"\nEND_OBJECT'
    m = spark.createDataFrame([(text,), ("",)], "t string").select(readers.scene_metadata(F.col("t")).alias("m")).collect()
    assert m[0].m.lats == [1.5, 2.0, -3.25, 4.0] and m[0].m.date == "2013-07-09" and m[0].m.cloud == 27.0 and m[0].m.bands == ["3N"] and m[0].m.angle == 15.0
    assert m[1].m.cloud is None and m[1].m.bands == []


def test_stack_from_rasters(spark, tmp_path):
    cells = spark.createDataFrame([("a", 0, 0, 10.0), ("a", 1, 0, -9999.0), ("b", 0, 0, 5000.0), ("c", 0, 0, float("nan")), ("d", 1, 0, 30.0)], "dem_id string, px int, py int, z double")
    dem = spark.createDataFrame([("a", None), ("b", 3.0), ("c", 2.0), ("d", 4.0)], "dem_id string, uncert double")
    ref = spark.createDataFrame([(0, 0, 20.0), (1, 0, 20.0)], "px int, py int, ref_z double")
    got = {r.dem_id: (r.z, r.uncert) for r in readers.build_stack(cells, dem, ref).collect()}
    assert got == {"a": (10.0, 5.0), "d": (30.0, 4.0)}  # far from the reference, fill and NaN are gone, and with them two rasters
    names = spark.createDataFrame([("x",), ("SETSM_a_20130709_b",), ("SETSM_a_20110101_b",)], "dem_id string")
    assert [r.dem_id for r in readers.dated(names).collect()] == ["SETSM_a_20110101_b", "SETSM_a_20130709_b", "x"]


def test_tables_are_written_and_read_by_their_schema(spark, tmp_path):
    df = spark.createDataFrame([("t1", 1, 2, None, 1.0, 2.0), ("t2", 1, 1, None, 3.0, 4.0)], "tile string, px int, py int, t timestamp_ntz, z double, z_ci double")
    readers.write_table(df, str(tmp_path / "fit"), ("tile",))
    back = readers.read_table(spark, "fit", str(tmp_path / "fit"))
    assert back.where("tile = 't2'").count() == 1 and set(back.columns) == {"tile", "px", "py", "t", "z", "z_ci"}
    readers.write_table(df.drop("t"), str(tmp_path / "csv"), fmt="csv")


def test_date_line_and_inventory(spark):
    ring = [(-170.0, 0.0), (170.0, 0.0), (170.0, 1.0)]
    df = spark.createDataFrame([("s", ring), ("s", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], "strip string, ring array<struct<x:double,y:double>>")
    rings = readers.strip_polygon(df, ["strip"]).first().rings
    assert len(rings) == 3 and sorted(p.x for r in rings for p in r)[0] == -180.0
    f = spark.createDataFrame([("G1", 2, 2, 5, 1, 1.0, 0.0, 0.0), ("R1", 2, 1, 5, 1, 1.0, 0.0, 0.0)], "rgiid string, cl int, nom int, term int, reg int, area double, lon double, lat double")
    got = {r.rgiid: (r.cl, r.nom, r.term, r.reg) for r in readers.inventory(f).collect()}
    assert got == {"G1": (0, 0, 0, 12), "R1": (2, 1, 5, 1)}


def test_streamed_trend_equals_the_batch(spark, tmp_path):
    rows = [(k, f"2024-01-{1 + i:02d} 00:00:00", float(i), 2.0 * i + k, 1.0 + i % 3) for k in (1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, ts string, x double, y double, w double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    batch = {r.k: (r.n, r.slope, r.intercept) for r in running_trend(df, ["k"], "ts", "x", "y", "w").collect()}
    assert batch[1][1] == pytest.approx(2.0) and batch[2][2] == pytest.approx(2.0)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_trend(stream, ["k"], "ts", "x", "y", "w").writeStream.outputMode("complete").format("memory").queryName("trend").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.k: (r.n, r.slope, r.intercept) for r in spark.table("trend").collect()}
    assert {k: pytest.approx(v) for k, v in batch.items()} == got
    late = running_trend(df, ["k"], "ts", "x", "y", "w", window="7 days")
    assert late.count() > 2
