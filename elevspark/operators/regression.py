"""Straight lines per group: ordinary and weighted least squares with confidence bands, filtered refits, robust loops.

Sums are centred on the group's (weighted) means in a second pass, so large coordinates do not
cancel. A null in x, y or the weight voids the row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.student import t_two_sided


def _valid(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c))
    return df


def ols(df: DataFrame, keys: list[str], x: str = "t", y: str = "z", conf: float = 0.68) -> DataFrame:
    """keys, n, slope, intercept, sigma, slope_ci (half width), x_mean, sxx."""
    g = _valid(df, x, y).groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.avg(x).alias("x_mean")
    )
    sse = F.greatest(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0))
    g = g.withColumn("sigma", F.when(F.col("n") > 2, F.sqrt(sse / (F.col("n") - 2))))
    return g.withColumn("slope_ci", t_two_sided(F.col("n") - 2, conf) * F.try_divide(F.col("sigma"), F.sqrt("sxx"))).drop("syy")


def wls(df: DataFrame, keys: list[str], x: str = "t", y: str = "z", w: str = "w", conf: float = 0.68) -> DataFrame:
    """As :func:`ols` with weights; sigma is of the weighted residuals, with n - 2 degrees of freedom.

    One shuffle: the window by ``keys`` and the grouping that follows share a partitioning.
    """
    by = Window.partitionBy(*keys)
    wx, wy, sw = F.sum(F.col(w) * F.col(x)).over(by), F.sum(F.col(w) * F.col(y)).over(by), F.sum(w).over(by)
    c = _valid(df, x, y, w).select(*keys, F.col(w).alias("_w"), (F.col(x) - wx / sw).alias("_x"), (F.col(y) - wy / sw).alias("_y"), (wx / sw).alias("_mx"), (wy / sw).alias("_my"), F.col(x).alias("_at"))
    g = c.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("sxx"), F.sum(F.col("_w") * F.col("_x") * F.col("_y")).alias("_sxy"),
        F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("_syy"), F.first("_mx").alias("x_mean"), F.first("_my").alias("_my"), (F.min("_at") < F.max("_at")).alias("_varies"),
    )
    # a mean of equal x is their value but for the last digit: without spread sxx would be noise, and the line a quotient of noise
    g = g.withColumn("sxx", F.when(F.col("_varies"), F.col("sxx")).otherwise(0.0))
    g = g.withColumn("slope", F.try_divide("_sxy", "sxx")).withColumn("intercept", F.col("_my") - F.col("slope") * F.col("x_mean"))
    sse = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    g = g.withColumn("sigma", F.when(F.col("n") > 2, F.sqrt(sse / (F.col("n") - 2))))
    g = g.withColumn("slope_ci", t_two_sided(F.col("n") - 2, conf) * F.try_divide(F.col("sigma"), F.sqrt("sxx")))
    return g.select(*keys, "n", "slope", "intercept", "sigma", "slope_ci", "x_mean", "sxx")


def band(x: Column, w: Column, conf: float, prefix: str = "") -> Column:
    """Half width of the confidence band at ``x`` of the line whose statistics are in the columns ``prefix`` + n, x_mean, sxx, sigma.

    ``w`` is the weight there (1 in OLS).
    """
    n, mean, sxx, sigma = (F.col(prefix + c) for c in ("n", "x_mean", "sxx", "sigma"))
    return t_two_sided(n - 2, conf) * sigma * F.sqrt(1 / n + w * F.pow(x - mean, F.lit(2.0)) / sxx)


def ls(df: DataFrame, keys: list[str], x: str = "t", y: str = "z", w: str | None = None, conf: float = 0.68, conf_filter: float | None = None) -> DataFrame:
    """A line per group; with ``conf_filter``, points outside that band of a first fit are dropped and the line is refitted.

    keys, slope, intercept, slope_ci, n, x_min, x_max. With two points or fewer only the intercept is given.
    """
    df = _valid(df, x, y, *([w] if w else [])).withColumn("_weight", F.col(w) if w else F.lit(1.0))
    if conf_filter is not None:
        fit = wls(df, keys, x, y, "_weight", conf_filter)
        held = {k: f"_k{i}" for i, k in enumerate(keys)} | {c: f"_f_{c}" for c in ("n", "slope", "intercept", "sigma", "x_mean", "sxx")}
        fit = fit.select(*[F.col(k).alias(v) for k, v in held.items()])
        on = [F.col(k) == F.col(held[k]) for k in keys]
        inside = F.abs(F.col(y) - F.col("_f_slope") * F.col(x) - F.col("_f_intercept")) <= band(F.col(x), F.col("_weight"), conf_filter, "_f_")
        df = df.join(fit, on).where((F.col("_f_n") <= 2) | inside).drop(*held.values())
    fit = wls(df, keys, x, y, "_weight", conf)
    ends = df.groupBy(*keys).agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"))
    many = F.col("n") > 2
    return fit.join(ends, keys).select(*keys, F.when(many, F.col("slope")).alias("slope"), "intercept", F.when(many, F.col("slope_ci")).alias("slope_ci"), "n", "x_min", "x_max")


def line(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the weighted line; NaN where x does not vary."""
    if len(x) < 2 or np.ptp(x) == 0:
        return np.nan, np.nan
    mx, my = np.average(x, weights=w), np.average(y, weights=w)
    slope = np.sum(w * (x - mx) * (y - my)) / np.sum(w * (x - mx) ** 2)
    return slope, my - slope * mx


def robust_line(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, np.ndarray]:
    """The line after repeated removal of outliers, and which points it keeps.

    A point goes if its residual is four times the spread or more: the normalised median deviation
    where the standard deviation is over 20 times that, else the standard deviation. A spread of zero
    keeps every point.
    """
    keep = np.isfinite(x) & np.isfinite(y) & np.isfinite(w)
    while True:
        slope, intercept = line(x[keep], y[keep], w[keep])
        if not np.isfinite(slope):
            return slope, intercept, keep
        left = y - slope * x - intercept
        r = left[keep]
        mad, std = 1.4826 * np.median(np.abs(r - np.median(r))), np.std(r)
        limit = 4 * (mad if mad > 0 and std / mad > 20 else std)
        good = keep & ((np.abs(left) < limit) | (limit <= 1e-9 * (1 + np.abs(y).max(initial=0, where=keep))))
        if good.sum() == keep.sum():
            return slope, intercept, keep
        keep = good


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` by ``keys`` over all shuffle partitions: groups that cost Python time are many though their bytes are few, so none are merged."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def _robust(df: DataFrame, keys: list[str], x: str, y: str, w: str | None) -> DataFrame:
    """Groups are fitted one at a time in numpy: the number of removals depends on the data."""
    cols = [*keys, x, y, *([w] if w else [])]
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        weights = pdf[w].to_numpy(float) if w else np.ones(len(pdf))
        slope, intercept, keep = robust_line(pdf[x].to_numpy(float), pdf[y].to_numpy(float), weights)
        row = {k: pdf[k].iloc[0] for k in keys} | {"slope": slope, "intercept": intercept, "n": int(keep.sum()), "dropped": int(len(pdf) - keep.sum())}
        return pd.DataFrame([row])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", slope double, intercept double, n long, dropped long"
    return dealt(df.select(*cols), keys).groupBy(*keys).applyInPandas(run, schema)


def robust_wls(df: DataFrame, keys: list[str], x: str = "t", y: str = "z", err: str = "err") -> DataFrame:
    """keys, slope, intercept, n, dropped of lines weighted by 1/err with outliers removed."""
    return _robust(df.withColumn("_w", F.try_divide(F.lit(1.0), F.col(err))), keys, x, y, "_w")


def detrend(df: DataFrame, keys: list[str], x: str = "t", y: str = "z") -> DataFrame:
    """The same without weights."""
    return _robust(df, keys, x, y, None)

