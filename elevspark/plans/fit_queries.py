"""Regression, filters, error model and neighbourhoods on the observations of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.student import t_sql
from ..operators import error_model, filters, gp, neighbourhood, regression
from ..sources.adapters import OBS, PIXELS, obs, pixels
from ..streaming.trend import running_trend
from .rounding import big, r, rounded

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def weighted(spark, d):
    return obs(spark, d).withColumn("w", 1 / (F.col("err") * F.col("err")))


@query("ols_trend", f"""WITH {OBS}, g AS (
  SELECT pixel, count(*) AS n, regr_slope(z, t) AS slope, regr_intercept(z, t) AS intercept, regr_sxx(z, t) AS sxx, regr_syy(z, t) AS syy FROM obs GROUP BY pixel
), s AS (SELECT *, CASE WHEN n > 2 THEN sqrt(greatest(syy - slope * slope * sxx, 0) / (n - 2)) END AS sigma FROM g)
SELECT {big('pixel', 'n')}, {r('slope')} AS slope, {r('intercept')} AS intercept, {r('sigma')} AS sigma, {r(t_sql('(n - 2)', 0.68) + ' * sigma / sqrt(sxx)')} AS slope_ci FROM s""")
def ols_trend(spark, d):
    return rounded(regression.ols(obs(spark, d), ["pixel"]).select("pixel", "n", "slope", "intercept", "sigma", "slope_ci"))


def wls_sql(source: str, x: str, w: str, conf: float, out: str = "fit", keys: str = "pixel") -> str:
    """CTEs that end in ``out``: keys, n, slope, intercept, sigma, sxx, x_mean."""
    return f"""{out}_m AS (SELECT {keys}, sum({w} * {x}) / sum({w}) AS mx, sum({w} * z) / sum({w}) AS my FROM {source} GROUP BY {keys}
), {out}_s AS (
  SELECT {keys}, count(*) AS n, sum({w} * ({x} - mx) * ({x} - mx)) AS sxx, sum({w} * ({x} - mx) * (z - my)) AS sxy, sum({w} * (z - my) * (z - my)) AS syy, min(mx) AS x_mean, min(my) AS y_mean
  FROM {source} JOIN {out}_m USING ({keys}) GROUP BY {keys}
), {out}_l AS (SELECT *, CASE WHEN sxx <> 0 THEN sxy / sxx END AS slope FROM {out}_s
), {out} AS (
  SELECT *, y_mean - slope * x_mean AS intercept, CASE WHEN n > 2 THEN sqrt(greatest(syy - slope * sxy, 0) / (n - 2)) END AS sigma FROM {out}_l
)"""


W2 = "(1 / (err * err))"


@query("wls_trend", f"""WITH {OBS}, {wls_sql('obs', 't', W2, 0.68)}
SELECT {big('pixel', 'n')}, {r('slope')} AS slope, {r('intercept')} AS intercept, {r('sigma')} AS sigma, {r(t_sql('(n - 2)', 0.68) + ' * sigma / sqrt(sxx)')} AS slope_ci FROM fit""")
def wls_trend(spark, d):
    return rounded(regression.wls(weighted(spark, d), ["pixel"]).select("pixel", "n", "slope", "intercept", "sigma", "slope_ci"))


@query("ls_filtered_trend", f"""WITH {OBS}, {wls_sql('obs', 't', W2, 0.99, 'a')}, kept AS (
  SELECT o.* FROM obs o JOIN a USING (pixel) WHERE a.n <= 2 OR abs(z - slope * t - intercept) <= {t_sql('(a.n - 2)', 0.99)} * sigma * sqrt(1 / a.n::DOUBLE + {W2} * (t - x_mean) * (t - x_mean) / sxx)
), {wls_sql('kept', 't', W2, 0.68)}, ends AS (SELECT pixel, min(t) AS x_min, max(t) AS x_max FROM kept GROUP BY pixel)
SELECT {big('pixel', 'n')}, {r('CASE WHEN n > 2 THEN slope END')} AS slope, {r('intercept')} AS intercept, {r('CASE WHEN n > 2 THEN ' + t_sql('(n - 2)', 0.68) + ' * sigma / sqrt(sxx) END')} AS slope_ci,
  {r('x_min')} AS x_min, {r('x_max')} AS x_max FROM fit JOIN ends USING (pixel)""")
def ls_filtered_trend(spark, d):
    return rounded(regression.ls(weighted(spark, d), ["pixel"], w="w", conf_filter=0.99))


def robust_sql(w: str, passes: int = 12) -> str:
    """Passes of fit and removal, one after the other; a group that keeps all points is not changed by further ones."""
    ctes = [f"k0 AS (SELECT pixel, t, z, {w} AS w FROM obs)"]
    for i in range(passes):
        ctes.append(f"""f{i}_m AS (SELECT pixel, sum(w * t) / sum(w) AS mx, sum(w * z) / sum(w) AS my FROM k{i} GROUP BY pixel), f{i} AS (
  SELECT pixel, any_value(mx) AS mx, any_value(my) AS my, sum(w * (t - mx) * (z - my)) / sum(w * (t - mx) * (t - mx)) AS b, count(*) AS n, max(abs(z)) AS big FROM k{i} JOIN f{i}_m USING (pixel) GROUP BY pixel),
r{i} AS (SELECT k.*, z - my - b * (t - mx) AS res, big FROM k{i} k JOIN f{i} USING (pixel)),
l{i} AS (SELECT pixel, 1.4826::DOUBLE * mad(res) AS m, stddev_pop(res) AS s FROM r{i} GROUP BY pixel),
k{i + 1} AS (SELECT pixel, t, z, w FROM r{i} JOIN l{i} USING (pixel) WHERE abs(res) < 4 * CASE WHEN m > 0 AND s / m > 20 THEN m ELSE s END OR 4 * CASE WHEN m > 0 AND s / m > 20 THEN m ELSE s END <= 1e-9::DOUBLE * (1 + big))""")
    last = passes - 1
    return f"""WITH {OBS}, {', '.join(ctes)}, c AS (SELECT pixel, count(*) AS every FROM obs GROUP BY pixel)
SELECT pixel, {r('b')} AS slope, {r('my - b * mx')} AS intercept, n, CAST(every - n AS BIGINT) AS dropped FROM f{last} JOIN c USING (pixel)"""


@query("robust_wls", robust_sql("1 / err"))
def robust_wls(spark, d):
    return rounded(regression.robust_wls(obs(spark, d), ["pixel"]))


@query("detrend", robust_sql("1.0::DOUBLE"))
def detrend(spark, d):
    return rounded(regression.detrend(obs(spark, d), ["pixel"]))


@query("gpr_fit")
def gpr_fit(spark, d):
    years = obs(spark, d).withColumn("t", F.col("t") / 2)
    return rounded(gp.fit_gp(years, ["pixel"], [0.5 * i for i in range(33)]), 4)


@query("running_trend", f"""WITH {OBS}, s AS (SELECT pixel, date_trunc('day', TIMESTAMP '2024-01-01' + INTERVAL (day - day % 10) DAY) AS start, t, z, {W2} AS w, ts FROM obs JOIN events ON event_id = obs_id),
b AS (SELECT pixel, CAST(floor(epoch(ts) / 864000) AS BIGINT) AS period, count(*) AS n, sum(w) AS sw, sum(w * t) AS sx, sum(w * z) AS sy, sum(w * t * t) AS sxx, sum(w * t * z) AS sxy FROM s GROUP BY ALL),
l AS (SELECT *, CASE WHEN n > 1 THEN (sw * sxy - sx * sy) / (sw * sxx - sx * sx) END AS slope FROM b)
SELECT {big('pixel', 'period', 'n')}, {r('slope', 3)} AS slope, {r('(sy - slope * sx) / sw', 1)} AS intercept FROM l WHERE n >= 10""")
def running(spark, d):
    ts = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("obs_id"), "ts")
    g = running_trend(weighted(spark, d).join(ts, "obs_id"), ["pixel"], "ts", "t", "z", "w", window="10 days")
    g = g.withColumn("period", F.floor(F.unix_timestamp("window.start") / 864000)).where("n >= 10")
    return rounded(g.select("pixel", "period", "n", "slope", F.round("intercept", 1).alias("intercept")), 3)


NMAD = "1.4826::DOUBLE * mad({0})"


@query("nmad_by_group", f"WITH {OBS} SELECT pixel, count(z) AS n, {r('median(z)')} AS median, {r(NMAD.format('z'))} AS nmad, {r('stddev_pop(z)')} AS std FROM obs GROUP BY pixel")
def nmad_by_group(spark, d):
    return rounded(error_model.nmad_by(obs(spark, d), ["pixel"], "z"))


def _bins(edges: list[float], x: str) -> str:
    return "CASE " + " ".join(f"WHEN abs({x}) >= {a} AND abs({x}) < {b} THEN {(a + b) / 2}" for a, b in zip(edges, edges[1:], strict=False)) + " END"


SLOPES, CORRS = [0.0, 10.0, 20.0, 40.0, 60.0, 200.0], [0.0, 3.0, 5.0, 7.0, 9.0]


def _binned(spark, d):
    o = obs(spark, d).join(pixels(spark, d), ["pixel", "px", "py"])
    return o.withColumn("corr", F.col("err")).withColumn("diff", F.col("z") - F.col("ref_z"))


@query("var_by_bin", f"""WITH {OBS}, {PIXELS}, j AS (SELECT z - ref_z AS diff, slope, err FROM obs JOIN pixels USING (pixel)), e(bin_slope) AS (VALUES {', '.join(f'({(a + b) / 2}::DOUBLE)' for a, b in zip(SLOPES, SLOPES[1:], strict=False))}),
g AS (SELECT {_bins(SLOPES, 'slope')} AS b, count(*) AS n, {NMAD.format('diff')} AS nmad, stddev_pop(diff) AS std FROM j GROUP BY 1)
SELECT bin_slope, CAST(coalesce(n, 0) AS BIGINT) AS n, {r('nmad')} AS nmad, {r('std')} AS std FROM e LEFT JOIN g ON b = bin_slope""")
def var_by_bin(spark, d):
    return rounded(error_model.variance_by_bins(_binned(spark, d), "diff", {"slope": SLOPES}))


@query("var_by_2d_bins", f"""WITH {OBS}, {PIXELS}, j AS (SELECT z - ref_z AS diff, slope, err FROM obs JOIN pixels USING (pixel)),
e AS (SELECT * FROM (VALUES {', '.join(f'({(a + b) / 2}::DOUBLE)' for a, b in zip(SLOPES, SLOPES[1:], strict=False))}) x(bin_slope), (VALUES {', '.join(f'({(a + b) / 2}::DOUBLE)' for a, b in zip(CORRS, CORRS[1:], strict=False))}) y(bin_corr)),
g AS (SELECT {_bins(SLOPES, 'slope')} AS b, {_bins(CORRS, 'err')} AS c, count(*) AS n, {NMAD.format('diff')} AS nmad, stddev_pop(diff) AS std FROM j GROUP BY 1, 2)
SELECT bin_slope, bin_corr, CAST(coalesce(n, 0) AS BIGINT) AS n, {r('nmad')} AS nmad, {r('std')} AS std FROM e LEFT JOIN g ON b = bin_slope AND c = bin_corr""")
def var_by_2d_bins(spark, d):
    return rounded(error_model.variance_by_bins(_binned(spark, d), "diff", {"slope": SLOPES, "corr": CORRS}))


@query("elevation_range_filter", f"WITH {OBS} SELECT pixel, count(*) AS n, {r('sum(z)', 4)} AS total FROM obs WHERE z BETWEEN 20 AND 300 GROUP BY pixel")
def elevation_range_filter(spark, d):
    kept = filters.elevation_range(obs(spark, d), "z", 20.0, 300.0)
    return rounded(kept.groupBy("pixel").agg(F.count("*").alias("n"), F.sum("z").alias("total")), 4)


DAYS = "(t - 15) * 100"


def _with_ref(spark, d):
    return obs(spark, d).join(pixels(spark, d), ["pixel", "px", "py"]).withColumn("days", (F.col("t") - 15) * 100)


@query("time_filter_ref", f"""WITH {OBS}, {PIXELS}, j AS (SELECT obs_id, ref_z - z AS dh, -({DAYS}) / 365.24::DOUBLE AS dt FROM obs JOIN pixels USING (pixel))
SELECT obs_id FROM j WHERE NOT ((dt < 0 AND (dh < -100 + dt * 30 OR dh > 100 + dt * -50)) OR (dt > 0 AND (dh > 100 + dt * 30 OR dh < -100 + dt * -50)))""")
def time_filter_ref(spark, d):
    return filters.time_filter(_with_ref(spark, d), "ref_z", "days", rate=(-50.0, 30.0)).select("obs_id")


@query("time_filter_symmetric", f"WITH {OBS}, {PIXELS} SELECT obs_id FROM obs JOIN pixels USING (pixel) WHERE abs(ref_z - z) <= 100 + abs({DAYS} / 365.24::DOUBLE) * 40")
def time_filter_symmetric(spark, d):
    return filters.time_filter(_with_ref(spark, d), "ref_z", "days", rate=40.0).select("obs_id")


def disk_sql(radius: int, value: str = "ref_z") -> str:
    return f"""near AS (SELECT a.px, a.py, b.{value} AS v FROM pixels a JOIN pixels b ON (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) <= {radius * radius})"""


@query("disk_minmax", f"WITH {OBS}, {PIXELS}, {disk_sql(3)} SELECT {big('px', 'py')}, {r('min(v)')} AS disk_min, {r('max(v)')} AS disk_max FROM near GROUP BY px, py")
def disk_minmax(spark, d):
    return rounded(neighbourhood.disk_extremes(pixels(spark, d), 3, "ref_z"))


@query("disk_p20_p80", f"WITH {OBS}, {PIXELS}, {disk_sql(3)} SELECT {big('px', 'py')}, {r('quantile_cont(v, 0.2)')} AS p0, {r('quantile_cont(v, 0.8)')} AS p1 FROM near GROUP BY px, py")
def disk_p20_p80(spark, d):
    return rounded(neighbourhood.disk_percentiles(pixels(spark, d), 3, (0.2, 0.8), "ref_z"))


@query("spatial_filter", f"""WITH {OBS}, {PIXELS}, {disk_sql(2)}, s AS (SELECT px, py, min(v) AS lo, max(v) AS hi FROM near GROUP BY px, py)
SELECT obs_id FROM obs JOIN s USING (px, py) WHERE z BETWEEN lo - 60 AND hi + 60""")
def spatial_filter(spark, d):
    return filters.spatial_filter(obs(spark, d), pixels(spark, d), 200.0, 60.0, 100.0).select("obs_id")


@query("prefilter_both", f"""WITH {OBS}, {PIXELS}, s AS (
  SELECT a.px, a.py, min(b.ref_z) FILTER (WHERE q <= 4) AS l2, max(b.ref_z) FILTER (WHERE q <= 4) AS h2, min(b.ref_z) FILTER (WHERE q <= 25) AS l5, max(b.ref_z) FILTER (WHERE q <= 25) AS h5, min(b.ref_z) AS l20, max(b.ref_z) AS h20
  FROM pixels a, pixels b, LATERAL (SELECT (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) AS q) WHERE q <= 400 GROUP BY a.px, a.py
) SELECT obs_id FROM obs JOIN pixels USING (pixel, px, py) JOIN s USING (px, py)
WHERE z BETWEEN -400 AND 8900 AND z BETWEEN l2 - 700 AND h2 + 700 AND z BETWEEN l5 - 500 AND h5 + 500 AND z BETWEEN l20 - 300 AND h20 + 300 AND abs(ref_z - z) <= 100 + abs({DAYS} / 365.24::DOUBLE) * 50""")
def prefilter_both(spark, d):
    o = obs(spark, d).withColumn("days", (F.col("t") - 15) * 100)
    return filters.prefilter(o, pixels(spark, d), "both").select("obs_id")


@query("wls_ref_filter", f"""WITH {OBS}, {PIXELS}, y AS (SELECT *, {DAYS} / 365.24::DOUBLE AS yr FROM obs), {wls_sql('y', 'yr', W2, 0.99, 'a')}, kept AS (
  SELECT y.* FROM y JOIN a USING (pixel) WHERE a.n <= 2 OR abs(z - slope * yr - intercept) <= {t_sql('(a.n - 2)', 0.99)} * sigma * sqrt(1 / a.n::DOUBLE + {W2} * (yr - x_mean) * (yr - x_mean) / sxx)
), {wls_sql('kept', 'yr', W2, 0.68, 'b')}, tr AS (SELECT px, py, slope FROM b JOIN pixels USING (pixel) WHERE n > 2 AND b.slope BETWEEN -50 AND 50
), tr2 AS (SELECT p.px, p.py, t.slope AS v FROM (SELECT DISTINCT px, py FROM tr) p JOIN tr t ON (p.px - t.px) * (p.px - t.px) + (p.py - t.py) * (p.py - t.py) <= 9
), m AS (SELECT px, py, greatest(abs(quantile_cont(v, 0.2)), abs(quantile_cont(v, 0.8))) AS m FROM tr2 GROUP BY px, py), {disk_sql(3)}, s AS (SELECT px, py, min(v) AS lo, max(v) AS hi FROM near GROUP BY px, py)
SELECT obs_id FROM y JOIN pixels USING (pixel, px, py) JOIN m USING (px, py) JOIN s USING (px, py)
WHERE z BETWEEN lo - (20 + 30 * m) AND hi + (20 + 30 * m) AND abs(ref_z - z) <= 20 + 2 * m + abs({DAYS}) / 365.24::DOUBLE * 2 * m""".replace("SELECT px, py, slope FROM b JOIN pixels USING (pixel)", "SELECT px, py, b.slope AS slope FROM b JOIN pixels USING (pixel)"))
def wls_ref_filter(spark, d):
    o = obs(spark, d).withColumn("days", (F.col("t") - 15) * 100)
    return filters.wls_reference_filter(o, pixels(spark, d), base=20.0, radius=3).select("obs_id")


@query("rmse_filter", f"WITH {OBS}, dem AS (SELECT dem, avg(err) * 5 AS uncert FROM obs GROUP BY dem) SELECT obs_id FROM obs JOIN dem USING (dem) WHERE uncert < 20.0")
def rmse_filter(spark, d):
    o = obs(spark, d)
    return filters.rmse_filter(o, o.groupBy("dem").agg((F.avg("err") * 5).alias("uncert")), 20.0).select("obs_id")


@query("merge_duplicate_dates", f"WITH {OBS} SELECT {big('pixel', 'day')}, {r('avg(z)')} AS z, {r('avg(err)')} AS err, count(z) AS n FROM obs GROUP BY pixel, day")
def merge_duplicate_dates(spark, d):
    return rounded(filters.merge_duplicate_dates(obs(spark, d), ["pixel"]))


@query("clip_to_mask", f"WITH {OBS}, {PIXELS} SELECT obs_id FROM obs WHERE (px, py) IN (SELECT (px, py) FROM pixels WHERE slope > 40)")
def clip_to_mask(spark, d):
    return filters.clip_to_mask(obs(spark, d), pixels(spark, d).where("slope > 40").select("px", "py")).select("obs_id")


@query("clip_to_extent", f"WITH {OBS}, {PIXELS}, b AS (SELECT min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM pixels WHERE slope > 70) SELECT obs_id FROM obs, b WHERE px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 AND t BETWEEN 3 AND 20")
def clip_to_extent(spark, d):
    return filters.clip_to_extent(obs(spark, d), pixels(spark, d).where("slope > 70"), "t", 3.0, 20.0).select("obs_id")


@query("error_model", f"""WITH {OBS}, {PIXELS}, s AS (SELECT pixel, median(CASE WHEN err * 12 <= 70 THEN err * 12 END) AS m FROM obs GROUP BY pixel),
j AS (SELECT obs_id, err AS u, 100 - z / 5 AS c, coalesce(m, slope) AS sl FROM obs JOIN pixels USING (pixel) JOIN s USING (pixel)),
e AS (SELECT obs_id, sqrt(u * u + pow((20 + 20 * (100 - c)) * tan(radians(sl)), 2) + CASE WHEN sl > 50 THEN pow((sl - 50) * 5, 2) ELSE 0 END + pow((100 - c) / 100 * 20, 2.5)) AS e FROM j)
SELECT obs_id, {r('CASE WHEN e > 300 THEN 300 ELSE e END', 5)} AS err FROM e""")
def error_model_query(spark, d):
    o = obs(spark, d)
    s = error_model.median_slope(o.select("pixel", (F.col("err") * 12).alias("slope")), ["pixel"], pixels(spark, d).select("pixel", "slope"))
    data = o.select("obs_id", "pixel", F.col("err").alias("uncert"), (100 - F.col("z") / 5).alias("corr"))
    return rounded(error_model.with_error(data, s, ["pixel"]).select("obs_id", "err"), 5)


AROUND = "max(CASE WHEN b.px - a.px = {0} AND b.py - a.py = {1} THEN b.ref_z END)"


def three_sql() -> str:
    names = {(-1, 1): "nw", (0, 1): "n", (1, 1): "ne", (-1, 0): "w", (0, 0): "c", (1, 0): "e", (-1, -1): "sw", (0, -1): "s", (1, -1): "se"}
    cols = ", ".join(f"{AROUND.format(*k)} AS {v}" for k, v in names.items())
    return f"q AS (SELECT a.px, a.py, {cols} FROM pixels a JOIN pixels b ON abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1 GROUP BY a.px, a.py)"


@query("slope_aspect", f"""WITH {OBS}, {PIXELS}, {three_sql()}, g AS (SELECT px, py, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / 800 AS gx, ((nw + 2 * n + ne) - (sw + 2 * s + se)) / 800 AS gy FROM q),
k AS (SELECT px, py, gx, gy, degrees(atan2(-gx, -gy)) + 360 AS a FROM g)
SELECT {big('px', 'py')}, {r('degrees(atan(sqrt(gx * gx + gy * gy)))')} AS slope, {r('a - 360 * floor(a / 360)')} AS aspect FROM k""")
def slope_aspect(spark, d):
    return rounded(neighbourhood.slope(pixels(spark, d), 100.0, "ref_z"))


@query("curvature", f"""WITH {OBS}, {PIXELS}, {three_sql()}, k AS (SELECT px, py, ((w + e) / 2 - c) / 10000 AS d, ((s + n) / 2 - c) / 10000 AS g, (-nw + ne + sw - se) / 40000 AS f FROM q)
SELECT {big('px', 'py')}, {r('-d - g + sqrt((d - g) * (d - g) + f * f)', 8)} AS curvature FROM k""")
def curvature(spark, d):
    return rounded(neighbourhood.curvature(pixels(spark, d), 100.0, "ref_z"), 8)


@query("corr_opening", f"""WITH {OBS}, {PIXELS}, f AS (SELECT px, py, pixel % 11 > 1 AS good FROM pixels),
er AS (SELECT a.px, a.py, bool_and(b.good) AS good FROM f a JOIN f b ON (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) <= 1 GROUP BY a.px, a.py),
op AS (SELECT a.px, a.py, bool_or(b.good) AS good FROM er a JOIN er b ON (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) <= 1 GROUP BY a.px, a.py)
SELECT CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py FROM op WHERE good""")
def corr_opening(spark, d):
    cells = pixels(spark, d).withColumn("corr", F.when(F.col("pixel") % 11 > 1, 90).otherwise(10))
    return rounded(neighbourhood.corr_filter(cells, 80, 1).select("px", "py"))


@query("sampled_variance", None)
def sampled_variance(spark, d):
    o = _with_ref(spark, d).withColumn("diff", F.col("z") - F.col("ref_z"))
    return rounded(error_model.nmad_by(error_model.sample_rows(o, ["dem"], "obs_id", 500), ["dem"], "diff"))
