"""The driver tables re-read as elevation data: observations, cubes, series, features and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import days_since

ORIGIN = "2024-01-01 00:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def obs(spark: SparkSession, d: str) -> DataFrame:
    """Observations of a grid of pixels: obs_id, pixel, px, py, t (days), day, z, err, dem."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("obs_id"),
        F.col("user_id").alias("pixel"),
        (F.col("user_id") % 16).cast("int").alias("px"),
        F.floor(F.col("user_id") / 16).cast("int").alias("py"),
        days_since(F.col("ts"), ORIGIN).alias("t"),
        F.datediff(F.to_date("ts"), F.lit(ORIGIN[:10]).cast("date")).alias("day"),
        F.col("value").alias("z"),
        (1 + F.col("event_id") % 7).cast("double").alias("err"),
        F.col("event_type").alias("dem"),
    )


#: The same observations for DuckDB.
OBS = """obs AS (
  SELECT event_id AS obs_id, user_id AS pixel, CAST(user_id % 16 AS INTEGER) AS px, CAST(user_id // 16 AS INTEGER) AS py,
    (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 8.64e10::DOUBLE AS t, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
    value AS z, CAST(1 + event_id % 7 AS DOUBLE) AS err, event_type AS dem FROM events
)"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Static pixels: pixel, px, py, ref_z (largest observation, a reference surface), slope (degrees)."""
    return obs(spark, d).groupBy("pixel", "px", "py").agg(F.max("z").alias("ref_z")).withColumn("slope", (F.col("pixel") * 7 % 80).cast("double"))


PIXELS = "pixels AS (SELECT pixel, px, py, max(z) AS ref_z, CAST(pixel * 7 % 80 AS DOUBLE) AS slope FROM obs GROUP BY pixel, px, py)"


def cube(spark: SparkSession, d: str) -> DataFrame:
    """A fitted cube: pixel, t (0..63), z, z_ci."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("pixel"), F.posexplode("embedding").alias("t", "z")).select("pixel", "t", F.col("z").cast("double").alias("z"), (1 + (F.col("pixel") + F.col("t")) % 5).cast("double").alias("z_ci"))


CUBE = """cube AS (
  SELECT pixel, CAST(t AS INTEGER) AS t, CAST(emb[t + 1] AS DOUBLE) AS z, CAST(1 + (pixel + t) % 5 AS DOUBLE) AS z_ci
  FROM (SELECT vec_id AS pixel, embedding AS emb, unnest(range(0, len(embedding))) AS t FROM embeddings)
)"""


def series(spark: SparkSession, d: str) -> DataFrame:
    """Observations by feature and pixel: feature, pixel, year, dh, err, ref."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(
        F.col("l_suppkey").alias("feature"),
        F.col("l_partkey").alias("pixel"),
        F.year("l_shipdate").alias("year"),
        ((F.col("l_extendedprice") % 1000) / 100 - 5).alias("dh"),
        F.col("l_quantity").alias("err"),
        (F.col("p_retailprice") * 2).alias("ref"),
    )


SERIES = """series AS (
  SELECT l_suppkey AS feature, l_partkey AS pixel, CAST(year(l_shipdate) AS INTEGER) AS year, (l_extendedprice % 1000) / 100 - 5 AS dh, l_quantity AS err, p_retailprice * 2 AS ref
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def features(spark: SparkSession, d: str) -> DataFrame:
    """An inventory: rgiid, reg, area (square metres), lat, lon, term, nom, cl."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    k = F.col("s_suppkey")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        k.alias("rgiid"),
        F.col("n_regionkey").alias("reg"),
        (1e6 * (1 + F.abs("s_acctbal"))).alias("area"),
        (k * 37 % 170 - 85).cast("double").alias("lat"),
        (k * 91 % 360 - 180).cast("double").alias("lon"),
        (k % 6).cast("int").alias("term"),
        (k % 3).cast("int").alias("nom"),
        (k % 4).cast("int").alias("cl"),
    )


FEATURES = """features AS (
  SELECT s_suppkey AS rgiid, n_regionkey AS reg, 1e6::DOUBLE * (1 + abs(s_acctbal)) AS area, CAST(s_suppkey * 37 % 170 - 85 AS DOUBLE) AS lat, CAST(s_suppkey * 91 % 360 - 180 AS DOUBLE) AS lon,
    CAST(s_suppkey % 6 AS INTEGER) AS term, CAST(s_suppkey % 3 AS INTEGER) AS nom, CAST(s_suppkey % 4 AS INTEGER) AS cl
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """Altimetry points: id, lat, lon, t, h."""
    k = F.col("o_custkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (k * 37 % 1700 / 10 - 85).cast("double").alias("lat"), (k * 91 % 3600 / 10 - 180).cast("double").alias("lon"), F.col("o_orderdate").alias("t"), F.col("o_totalprice").alias("h"))


POINTS = "points AS (SELECT o_orderkey AS id, CAST(o_custkey * 37 % 1700 AS DOUBLE) / 10 - 85 AS lat, CAST(o_custkey * 91 % 3600 AS DOUBLE) / 10 - 180 AS lon, o_orderdate AS t, o_totalprice AS h FROM orders)"
