"""The error of each observation from slope, correlation score and raster uncertainty; binned statistics of differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nmad_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, median, nmad, std: two grouped medians, so that a group never sits in one array."""
    mid = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.stddev_pop(value).alias("std"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    dev = df.select(*keys, F.col(value).alias("_v")).join(mid, on)
    return dev.groupBy(*keys, "n", "median", "std").agg((1.4826 * F.median(F.abs(F.col("_v") - F.col("median")))).alias("nmad")).select(*keys, "n", "median", "nmad", "std")


def observation_error(uncert: Column, corr: Column, slope: Column) -> Column:
    """Standard error in metres; unusable values are 300."""
    poor = 100 - corr
    steep = F.tan(F.radians(slope))
    var = uncert * uncert + F.pow((20 + 20 * poor) * steep, F.lit(2.0)) + F.when(slope > 50, F.pow((slope - 50) * 5, F.lit(2.0))).otherwise(0.0) + F.pow(poor / 100 * 20, F.lit(2.5))
    err = F.sqrt(var)
    return F.when(err.isNull() | F.isnan(err) | (err > 300), F.lit(300.0)).otherwise(err)


def median_slope(slopes: DataFrame, keys: list[str], ref: DataFrame, steepest: float = 70.0) -> DataFrame:
    """keys, slope: the median over time of slopes up to ``steepest``; the reference's where there is none."""
    mid = slopes.where(F.col("slope") <= steepest).groupBy(*keys).agg(F.median("slope").alias("_s"))
    return ref.join(mid, keys, "left").select(*keys, F.coalesce("_s", "slope").alias("slope"))


def with_error(df: DataFrame, slopes: DataFrame, keys: list[str], uncert: str = "uncert", corr: str = "corr") -> DataFrame:
    return df.join(slopes, keys).withColumn("err", observation_error(F.col(uncert), F.coalesce(F.col(corr), F.lit(60.0)), F.col("slope")))


def sample_rows(df: DataFrame, keys: list[str], order: str, most: int = 10000) -> DataFrame:
    """At most ``most`` rows a group, the first by a hash of ``order``: the same rows on every run."""
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(17), order), order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def bin_of(value: Column, edges: list[float]) -> Column:
    """Index of the half-open bin [edge, next edge), null outside."""
    found = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        found = F.when((value >= edges[i]) & (value < edges[i + 1]), F.lit(i)).otherwise(found)
    return found


def variance_by_bins(df: DataFrame, value: str, bins: dict[str, list[float]]) -> DataFrame:
    """bin_<name> (middle), n, nmad, std for every bin of every combination, empty ones too."""
    spark = df.sparkSession
    keys = []
    for name, edges in bins.items():
        df = df.withColumn(f"_{name}", bin_of(F.abs(F.col(name)), edges))
        keys.append(f"_{name}")
    stats = nmad_by(df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)), keys, value)
    grid = None
    for name, edges in bins.items():
        one = spark.createDataFrame([(i, (edges[i] + edges[i + 1]) / 2) for i in range(len(edges) - 1)], f"_{name} int, bin_{name} double")
        grid = one if grid is None else grid.crossJoin(one)
    return grid.join(F.broadcast(stats), keys, "left").select(*[f"bin_{n}" for n in bins], F.coalesce("n", F.lit(0)).cast("long").alias("n"), "nmad", "std")  # a row per bin at most
