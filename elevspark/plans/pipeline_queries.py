"""The end-to-end plans on the driver tables. Those without SQL are held against known trends by tests."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.student import t_sql
from ..sources.adapters import OBS, PIXELS, cube, features, obs, pixels, series
from . import pipelines
from .fit_queries import wls_sql
from .rounding import big, r, rounded

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _stack(spark, d):
    o = obs(spark, d).withColumn("days", (F.col("t") - 15) * 30).withColumn("t", F.col("t") / 2).withColumn("corr", F.lit(95.0)).drop("err")
    dem = o.groupBy("dem").agg((F.avg("z") / 10).alias("uncert"))
    ref = pixels(spark, d).select("px", "py", "ref_z", (F.col("slope") / 8).alias("slope"), (F.col("pixel") % 3 != 0).alias("unstable"))
    return o, dem, ref


_ERR = """sqrt(u * u + pow((20 + 20 * 5.0::DOUBLE) * tan(radians(sl)), 2) + CASE WHEN sl > 50 THEN pow((sl - 50) * 5, 2) ELSE 0 END + pow(5.0::DOUBLE / 100 * 20, 2.5))"""
WLS_SQL = f"""WITH {OBS}, {PIXELS}, dem AS (SELECT dem, avg(z) / 10 AS u FROM obs GROUP BY dem),
j AS (SELECT px, py, o.t / 2 AS t, z, u, slope / 8 AS sl FROM obs o JOIN dem USING (dem) JOIN pixels USING (pixel, px, py) WHERE u < 20 AND z BETWEEN -400 AND 8900 AND abs(ref_z - z) <= 100 + abs(((o.t - 15) * 30) / 365.24::DOUBLE) * 50),
k AS (SELECT px, py, t, z, least({_ERR}, 300) AS e FROM j), d AS (SELECT px, py, t, avg(z) AS z, 1 / (avg(e) * avg(e)) AS w FROM k GROUP BY px, py, t),
{wls_sql('d', 't', 'w', 0.99, 'a', 'px, py')}, kept AS (
  SELECT d.* FROM d JOIN a USING (px, py) WHERE a.n <= 2 OR abs(z - slope * t - intercept) <= {t_sql('(a.n - 2)', 0.99)} * sigma * sqrt(1 / a.n::DOUBLE + w * (t - x_mean) * (t - x_mean) / sxx)
), {wls_sql('kept', 't', 'w', 0.68, 'fit', 'px, py')}, ends AS (SELECT px, py, min(t) AS x_min, max(t) AS x_max FROM kept GROUP BY px, py)
SELECT {big('px', 'py', 'n')}, {r('CASE WHEN n > 2 THEN slope END')} AS slope, {r('intercept')} AS intercept, {r('CASE WHEN n > 2 THEN ' + t_sql('(n - 2)', 0.68) + ' * sigma / sqrt(sxx) END')} AS slope_ci, {r('x_min')} AS x_min, {r('x_max')} AS x_max FROM fit JOIN ends USING (px, py)"""


@query("fit_stack_wls", WLS_SQL)
def fit_stack_wls(spark, d):
    """Filters, error model and weighted lines of every pixel."""
    return rounded(pipelines.fit_stack(*_stack(spark, d), method="wls", prefilter="time", conf_filter=0.99))


@query("fit_stack_gpr")
def fit_stack_gpr(spark, d):
    """The same with Gaussian processes on a grid of half years."""
    return rounded(pipelines.fit_stack(*_stack(spark, d), method="gpr", prefilter="time", step=0.5, span=(0.0, 16.0)), 4)


@query("volume_series")
def volume_series(spark, d):
    """Series of features from a fitted cube, its lags and a reference surface."""
    c = cube(spark, d).withColumn("t", F.col("t").cast("double"))
    p = c.select("pixel").distinct()
    lags = c.select("pixel", "t", ((F.col("pixel") * 7 + F.col("t")) % 300).cast("double").alias("days"))
    ref = p.select("pixel", (F.col("pixel") * 3 % 800).cast("double").alias("ref"))
    s, _ = pipelines.volumes(c, lags, ref, p.select((F.col("pixel") % 5).alias("rgiid"), "pixel"), 900.0)
    return rounded(s.select("rgiid", "t", "dh", "err_dh", "perc_area_meas", "dt"))


@query("regional_rates")
def regional_rates(spark, d):
    """Regions and periods from feature series with correlated errors."""
    s = series(spark, d).where("feature % 10 != 7").groupBy(F.col("feature").alias("rgiid"), F.col("year").cast("double").alias("time")).agg(F.avg("dh").alias("dh"), (1 + F.avg("err") / 50).alias("err_dh"))
    for r in (150, 2000, 5000, 20000, 50000, 200000):
        s = s.withColumn(f"err_corr_{r}", F.col("err_dh") / 3)
    for c, v in (("perc_err_cont", 5.0), ("perc_area_meas", 0.8), ("perc_area_res", 0.9), ("valid_obs", 3.0), ("valid_obs_py", 1.0)):
        s = s.withColumn(c, F.lit(v))
    return rounded(pipelines.regional_rates(s, features(spark, d), (1, 5, 10)))


@query("refined_variogram")
def refined_variogram(spark, d):
    """Temporal variograms of prefiltered observations by bins of slope, of height and of change."""
    o, _, ref = _stack(spark, d)
    out = pipelines.refined_variograms(o.withColumn("err", F.lit(2.0)), ref, 1.0, 8.0, [0.0, 5.0, 10.0], [0.0, 250.0, 1000.0], [-100.0, 0.0, 100.0])
    return rounded(functools.reduce(DataFrame.unionByName, (v.withColumn("by", F.lit(name)) for name, v in out.items())), 2)
