"""Empirical variograms over pairs: in time within a pixel, in space within a group, and their aggregation."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .error_model import nmad_by
from .regression import dealt


def time_pairs(df: DataFrame, keys: list[str], step: float, cutoff: float, t: str = "t", z: str = "z", order: str = "obs_id") -> DataFrame:
    """keys, lag, sq: squared differences of each pair of a group, once for each lag window that it lies in.

    Windows are [h - step, h + step] around h = 0, step, 2 step, ... below ``cutoff``: closed and
    overlapping. Pairs join on the group; the lags of a pair are counted from its distance, not joined.
    """
    a = df.select(*keys, F.col(t).alias("_t1"), F.col(z).alias("_z1"), F.col(order).alias("_o1"))
    b = df.select(*keys, F.col(t).alias("_t2"), F.col(z).alias("_z2"), F.col(order).alias("_o2"))
    lags = len([k for k in range(10**6) if k * step < cutoff]) if step > 0 else 0
    pairs = a.join(b, keys).where("_o1 < _o2").select(*keys, F.abs(F.col("_t1") - F.col("_t2")).alias("_d"), F.pow(F.col("_z1") - F.col("_z2"), F.lit(2.0)).alias("sq"))
    first = F.greatest(F.ceil(F.col("_d") / step - 1).cast("int"), F.lit(0))
    last = F.least(F.floor(F.col("_d") / step + 1).cast("int"), F.lit(lags - 1))
    return pairs.where(first <= last).withColumn("lag", F.explode(F.sequence(first, last))).select(*keys, "lag", "sq")


def temporal_variogram(df: DataFrame, keys: list[str], step: float, cutoff: float, **cols) -> DataFrame:
    """keys, lag (distance), gamma (half the mean squared difference), n."""
    g = time_pairs(df, keys, step, cutoff, **cols).groupBy(*keys, "lag").agg((F.avg("sq") / 2).alias("gamma"), F.count("*").alias("n"))
    return g.withColumn("lag", F.col("lag") * step)


def temporal_variogram_median(df: DataFrame, keys: list[str], step: float, cutoff: float, least: int = 8, half: bool = False, by: list[str] | None = None, **cols) -> DataFrame:
    """lag (shifted by half a step), vmedian, vnmad, n over the squared differences of all groups with ``least`` observations.

    ``by``: further columns to keep apart (bins of a static variable). ``half`` halves the squares.
    """
    by = by or []
    enough = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    pairs = time_pairs(df.join(enough.select(*keys), keys, "left_semi"), [*keys, *by], step, cutoff, **cols)
    stats = nmad_by(pairs.withColumn("sq", F.col("sq") / (2 if half else 1)), [*by, "lag"], "sq")
    return stats.select(*by, (F.col("lag") * step + step / 2).alias("lag"), F.col("median").alias("vmedian"), F.col("nmad").alias("vnmad"), "n")


#: Places of a cell that one task compares with its surroundings: a dense cell is dealt into parts of about so many.
PART = 4096


def pow_distance(dx: Column, dy: Column) -> Column:
    """sqrt(pow(dx, 2) + pow(dy, 2)) by the C library's ``pow``, as SQL engines compute it: not always the rounded squares, which Java's gives."""

    @F.arrow_udf("double")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if u is None or v is None else math.sqrt(math.pow(u, 2.0) + math.pow(v, 2.0)) for u, v in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return distance.asNondeterministic()(dx, dy)  # else a filter of its result is pushed below the grouping before it, onto every pair


def spatial_variogram(df: DataFrame, keys: list[str], cutoff: float, lags: int, x: str = "x", y: str = "y", z: str = "z", order: str = "id", least: int = 10, as_pow: bool = False) -> DataFrame:
    """keys, lag (upper edge), gamma, n of groups with more than ``least`` points, whose ``order`` tells them apart.

    Points of one place (no pair, being at distance zero) become its count, mean and variance, which give the sums over
    the pairs of two places without their pairs. Pairs further apart than ``cutoff`` never meet: places are dealt into cells of
    that size and join with their own and four of the eight around. Neither side's size is known before it is made, so
    the joins are by sorting, not by a broadcast. With ``as_pow``, distances that lie on the edge of a lag but for their
    last digits are kept apart in the sums and settled by :func:`pow_distance`.
    """
    big = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(*keys)
    df = df.join(big, keys, "left_semi").select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(z).cast("double").alias("_z"), F.col(order).alias("_o"))
    df = df.where(F.col("_o").isNotNull() & (F.abs("_x") < float("inf")) & (F.abs("_y") < float("inf")))
    places = df.groupBy(*keys, "_x", "_y").agg(F.count("*").alias("_n"), F.count("_z").alias("_m"), F.avg("_z").alias("_a"), F.var_pop("_z").alias("_v"))
    cell = lambda c: F.floor(F.col(c) / (cutoff * 1.000001))  # noqa: E731  # a distance that only rounds to the cutoff meets too
    at = [*keys, "_cx", "_cy"]
    a = places.withColumn("_cx", cell("_x")).withColumn("_cy", cell("_y"))
    parts = a.groupBy(*at).agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts")).hint("merge")
    a = a.join(parts, at).withColumn("_part", F.pmod(F.xxhash64("_x", "_y"), "_parts").cast("int")).drop("_parts")
    around = F.explode(F.array(*[F.struct((cell("_x") + i).alias("_cx"), (cell("_y") + j).alias("_cy"), F.lit((i, j) == (0, 0)).alias("_own")) for i, j in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))]))
    b = places.withColumn("_c", around).select(*keys, "_c.*", *[F.col(c).alias(c + "2") for c in ("_x", "_y", "_n", "_m", "_a", "_v")])
    b = b.join(parts, at).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    a, b = (dealt(side, [*at, "_part"]) for side in (a, b))
    dx, dy, da = F.col("_x") - F.col("_x2"), F.col("_y") - F.col("_y2"), F.col("_a") - F.col("_a2")
    once = ~F.col("_own") | (F.col("_x") < F.col("_x2")) | ((F.col("_x") == F.col("_x2")) & (F.col("_y") < F.col("_y2")))
    width, d, valid = cutoff / lags, F.col("_d"), F.col("_m") * F.col("_m2")
    inside, lag = (d <= cutoff) & (d > 0), F.ceil(d / width).cast("int")
    pairs = a.join(b.hint("merge"), [*at, "_part"]).withColumn("_d", F.sqrt(dx * dx + dy * dy)).where(once)
    sums = [F.sum(valid * (da * da + F.col("_v") + F.col("_v2"))).alias("_sq"), F.sum(valid).alias("_valid"), F.sum(F.col("_n") * F.col("_n2")).alias("n")]
    if as_pow:
        edge = F.abs(d / width - F.rint(d / width)) <= 4e-15 * d / width  # the two distances are 5e-16 apart at most
        near = pairs.where(d <= cutoff * (1 + 2e-15))
        g = near.groupBy(*keys, F.when(~edge, lag).alias("lag"), F.when(edge, F.abs(dx)).alias("_dx"), F.when(edge, F.abs(dy)).alias("_dy")).agg(*sums)
        g = g.withColumn("_d", pow_distance(F.col("_dx"), F.col("_dy"))).where(d.isNull() | inside)
        g = g.groupBy(*keys, F.coalesce("lag", lag).alias("lag")).agg(*[F.sum(c).alias(c) for c in ("_sq", "_valid", "n")])
    else:
        g = pairs.where(inside).groupBy(*keys, lag.alias("lag")).agg(*sums)
    return g.select(*keys, (F.col("lag") * width).alias("lag"), (F.try_divide("_sq", "_valid") / 2).alias("gamma"), "n")


def aggregate_variograms(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, exp, count: means weighted by their pair counts; samples without a value do not count."""
    w = F.when(F.col("exp").isNotNull(), F.col("count"))
    return df.groupBy(*keys).agg((F.sum(F.col("exp") * w) / F.sum(w)).alias("exp"), F.sum(w).alias("count"))
