"""Variograms, models, effective samples, joins in time and hypsometry."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import models
from ..functions.dates import year_fraction
from ..operators import hypso, timejoin, validate, variograms
from ..operators.error_model import bin_of
from ..sources.adapters import CUBE, OBS, PIXELS, POINTS, SERIES, cube, obs, pixels, points, series
from .rounding import big, r, rounded

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


PAIRS = """pairs AS (
  SELECT a.pixel, unnest(range(greatest(CAST(ceil(abs(a.t - b.t) / 2 - 1) AS BIGINT), 0), least(CAST(floor(abs(a.t - b.t) / 2 + 1) AS BIGINT), 7) + 1)) AS lag, (a.z - b.z) * (a.z - b.z) AS sq
  FROM obs a JOIN obs b ON a.pixel = b.pixel AND a.obs_id < b.obs_id
)"""


@query("temporal_variogram", f"WITH {OBS}, {PAIRS} SELECT pixel, {r('lag * 2')} AS lag, {r('avg(sq) / 2', 2)} AS gamma, count(*) AS n FROM pairs GROUP BY pixel, lag")
def temporal_variogram(spark, d):
    return rounded(variograms.temporal_variogram(obs(spark, d), ["pixel"], 2.0, 16.0), 2)


@query("temporal_variogram_median", f"WITH {OBS}, {PAIRS} SELECT {r('lag * 2 + 1')} AS lag, {r('median(sq)', 2)} AS vmedian, {r('1.4826::DOUBLE * mad(sq)', 2)} AS vnmad, count(*) AS n FROM pairs GROUP BY lag")
def temporal_variogram_median(spark, d):
    return rounded(variograms.temporal_variogram_median(obs(spark, d), ["pixel"], 2.0, 16.0), 2)


@query("vgm_by_bin", f"""WITH {OBS}, {PAIRS}, b AS (SELECT *, CAST(pixel * 7 % 80 // 20 AS BIGINT) AS bin FROM pairs)
SELECT bin, {r('lag * 2 + 1')} AS lag, {r('median(sq)', 2)} AS vmedian, {r('1.4826::DOUBLE * mad(sq)', 2)} AS vnmad, count(*) AS n FROM b GROUP BY bin, lag""")
def vgm_by_bin(spark, d):
    o = obs(spark, d).join(pixels(spark, d).select("pixel", "slope"), "pixel").withColumn("bin", bin_of(F.col("slope"), [0, 20, 40, 60, 80]))
    return rounded(variograms.temporal_variogram_median(o, ["pixel"], 2.0, 16.0, by=["bin"]), 2)


@query("spatial_variogram", f"""WITH {POINTS}, s AS (SELECT year(t) * 100 + month(t) AS grp, id, lat * 100 AS y, lon * 100 AS x, h / 1000 AS z FROM points),
k AS (SELECT grp FROM s GROUP BY grp HAVING count(*) > 10), p AS (
  SELECT a.grp, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist, (a.z - b.z) * (a.z - b.z) AS sq FROM s a JOIN s b ON a.grp = b.grp AND a.id < b.id WHERE a.grp IN (SELECT grp FROM k)
) SELECT CAST(grp AS BIGINT) AS grp, {r('ceil(dist / 250) * 250')} AS lag, {r('avg(sq) / 2', 3)} AS gamma, count(*) AS n FROM p WHERE dist <= 2500 AND dist > 0 GROUP BY grp, ceil(dist / 250)""")
def spatial_variogram(spark, d):
    p = points(spark, d).select((F.year("t") * 100 + F.month("t")).alias("grp"), "id", (F.col("lat") * 100).alias("y"), (F.col("lon") * 100).alias("x"), (F.col("h") / 1000).alias("z"))
    return rounded(variograms.spatial_variogram(p, ["grp"], 2500.0, 10, as_pow=True), 3)


@query("variogram_aggregate", f"""WITH {OBS}, {PAIRS}, v AS (SELECT pixel, lag, CASE WHEN pixel % 9 <> 0 THEN avg(sq) / 2 END AS exp, count(*) AS c FROM pairs GROUP BY pixel, lag)
SELECT CAST(pixel % 5 AS BIGINT) AS reg, lag, {r('sum(exp * c) / sum(CASE WHEN exp IS NOT NULL THEN c END)', 2)} AS exp, CAST(sum(CASE WHEN exp IS NOT NULL THEN c END) AS BIGINT) AS count FROM v GROUP BY 1, 2""")
def variogram_aggregate(spark, d):
    v = variograms.time_pairs(obs(spark, d), ["pixel"], 2.0, 16.0).groupBy("pixel", "lag").agg(F.avg("sq").alias("g"), F.count("*").alias("count"))
    v = v.select((F.col("pixel") % 5).alias("reg"), "lag", F.when(F.col("pixel") % 9 != 0, F.col("g") / 2).alias("exp"), "count")
    return rounded(variograms.aggregate_variograms(v, ["reg", "lag"]), 2)


H, A, C = "(p_size * 10.0::DOUBLE)", "(p_retailprice / 10)", "(p_size / 5.0::DOUBLE)"
SHAPES = {"Sph": f"CASE WHEN {H} < {A} THEN 1.5 * {H} / {A} - 0.5 * pow({H} / {A}, 3) ELSE 1 END", "Exp": f"1 - exp(-{H} / {A})", "Gau": f"1 - exp(-pow({H} / {A}, 2))", "Exc": f"1 - exp(-sqrt({H} / {A}))"}


def _part(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p, F.col("p_size") * 10.0, F.col("p_retailprice") / 10, F.col("p_size") / 5.0


@query("vgm_models", "SELECT p_partkey, " + ", ".join(f"{r(f'0.5 + {C} * ({s})')} AS vgm_{m.lower()}, {r(f'{C} * (1 - ({s})) + 0.5')} AS cov_{m.lower()}" for m, s in SHAPES.items()) + " FROM part")
def vgm_models(spark, d):
    p, h, a, c = _part(spark, d)
    cols = [x for m in models.MODELS for x in (models.variogram(h, a, m, c, 0.5).alias(f"vgm_{m.lower()}"), models.covariance(h, a, m, c, 0.5).alias(f"cov_{m.lower()}"))]
    return rounded(p.select("p_partkey", *cols))


KERNELS = {"Exc": f"exp(-sqrt({H} / {A}))", "Exp": f"exp(-{H} / {A})", "Gau": f"exp(-pow({H} / {A}, 2))", "Sph": f"CASE WHEN {H} > {A} THEN 0 ELSE 1 - 1.5 * {H} / {A} + 0.5 * pow({H} / {A}, 3) END"}


@query("kernels", "SELECT p_partkey, " + ", ".join(f"{r(s)} AS k_{m.lower()}" for m, s in KERNELS.items()) + f", {r('pow(' + H + ', 2) / 8 * 0.002')} AS lin_err FROM part")
def kernels(spark, d):
    p, h, a, _ = _part(spark, d)
    return rounded(p.select("p_partkey", *[models.kernel(h, F.lit(0.0), a, m).alias(f"k_{m.lower()}") for m in KERNELS], models.linear_err(h, 0.002).alias("lin_err")))


def sph_int(h: str, a: str, c: str) -> str:
    m = f"least({h}, {a})"
    return f"({c} * ({m} * {m} / 2 - pow({m}, 3) / (2 * {a}) + pow({m}, 5) / (10 * pow({a}, 3))))"


def exp_int(h: str, a: str, c: str) -> str:
    return f"({c} * ({a} * {a} - {a} * ({a} + {h}) * exp(-{h} / {a})))"


AREA = "(p_retailprice * 10000)"
BOTH = f"({sph_int(f'sqrt({AREA} / pi())', '100.0', '16.0')} + {exp_int(f'sqrt({AREA} / pi())', '1500.0', '0.36')})"
#: The closed form for two spherical models in a disk.
SPH2 = f"(16 * CASE WHEN hq > 100 THEN 100.0::DOUBLE * 100 / (5 * hq * hq) ELSE 1 - hq / 100 + pow(hq / 100, 3) / 5 END + 0.36 * CASE WHEN hq > 1500 THEN 1500.0::DOUBLE * 1500 / (5 * hq * hq) ELSE 1 - hq / 1500 + pow(hq / 1500, 3) / 5 END)"


@query("neff_circ", f"""WITH q AS (SELECT p_partkey, sqrt({AREA} / pi()) AS hq, {r(f'16.36 * {AREA} / (2 * pi() * {BOTH})')} AS neff_mixed FROM part)
SELECT p_partkey, neff_mixed, {r(f'16.36 / {SPH2}')} AS neff_two_spheres FROM q""")
def neff_circ(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    area = F.col("p_retailprice") * 10000
    two = [(100.0, "Sph", 16.0), (1500.0, "Sph", 0.36)]
    return rounded(p.select("p_partkey", models.neff_circ(area, [two[0], (1500.0, "Exp", 0.36)]).alias("neff_mixed"), models.neff_circ(area, two).alias("neff_two_spheres")))


@query("neff_rect", f"""WITH q AS (SELECT p_partkey, {AREA} AS area, least(p_size * 10.0::DOUBLE, {AREA} / (p_size * 10.0::DOUBLE)) AS w FROM part),
e AS (SELECT *, w / 2 AS lo, (area / w - w / 2) / 99 AS st FROM q),
s AS (SELECT p_partkey, area, {sph_int('lo', '500.0', '4.0')} AS first, list_sum([({sph_int('(lo + st * (i + 1))', '500.0', '4.0')} - {sph_int('(lo + st * i)', '500.0', '4.0')}) * 2 / pi() * atan(w / (2 * (lo + st * i + st / 2))) FOR i IN range(0, 99)]) AS rings FROM e)
SELECT p_partkey, {r('4 * area / (2 * pi() * (first + rings))')} AS neff FROM s""")
def neff_rect(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return rounded(p.select("p_partkey", models.neff_rect(F.col("p_retailprice") * 10000, F.col("p_size") * 10.0, [(500.0, "Sph", 4.0)]).alias("neff")))


@query("std_errors", f"SELECT p_partkey, {r('p_retailprice / sqrt(p_size + 0.0)')} AS std_err, {r('p_retailprice * sqrt(1 / (p_size + 60.0::DOUBLE) * 60.0 / (p_size + 60.0::DOUBLE))')} AS std_err_finite FROM part")
def std_errors(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    n = F.col("p_size").cast("double")
    return rounded(p.select("p_partkey", models.std_err(F.col("p_retailprice"), n).alias("std_err"), models.std_err_finite(F.col("p_retailprice"), n + 60, n).alias("std_err_finite")))


ENDS = "e AS (SELECT pixel, arg_min(z, t) AS z0, arg_max(z, t) AS z1, arg_min(z_ci, t) AS c0, arg_max(z_ci, t) AS c1 FROM cube GROUP BY pixel)"


@query("full_dh", f"WITH {CUBE}, {ENDS}, f AS (SELECT pixel, z1 - z0 AS dh, sqrt(c0 * c0 + c1 * c1) AS err FROM e) SELECT pixel, {r('CASE WHEN err <= 5 THEN dh END')} AS dh, {r('CASE WHEN err <= 5 THEN err END')} AS err FROM f")
def full_dh(spark, d):
    return rounded(timejoin.full_change(cube(spark, d), ["pixel"], limit=5.0))


@query("dh_from_first", f"WITH {CUBE}, {ENDS} SELECT pixel, CAST(t AS BIGINT) AS t, {r('z - z0')} AS dh, {r('sqrt(z_ci * z_ci + c0 * c0)')} AS err_dh FROM cube JOIN e USING (pixel)")
def dh_from_first(spark, d):
    return rounded(timejoin.change_from_first(cube(spark, d), ["pixel"]).select("pixel", "t", "dh", "err_dh"))


@query("dh_successive", f"WITH {CUBE} SELECT pixel, CAST(t AS BIGINT) AS t, {r('z - lag(z) OVER (PARTITION BY pixel ORDER BY t)')} AS dh FROM cube")
def dh_successive(spark, d):
    return rounded(timejoin.successive_change(cube(spark, d), ["pixel"]).select("pixel", "t", "dh"))


@query("interp_at_date", f"""WITH {OBS}, {CUBE}, w AS (SELECT obs_id, pixel, t * 2 AS t FROM obs), p AS (SELECT w.*, a.t AS t0, a.z AS z0, a.z_ci AS c0 FROM w ASOF JOIN cube a ON w.pixel = a.pixel AND w.t >= a.t),
n AS (SELECT p.*, b.t AS t1, b.z AS z1, b.z_ci AS c1 FROM p ASOF JOIN cube b ON p.pixel = b.pixel AND p.t <= b.t),
f AS (SELECT *, CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0 END AS k FROM n)
SELECT obs_id, {r('z0 * (1 - k) + z1 * k')} AS z, {r('c0 * (1 - k) + c1 * k')} AS z_ci FROM f""")
def interp_at_date(spark, d):
    c = cube(spark, d).withColumn("t", F.col("t").cast("double"))
    left = obs(spark, d).select("obs_id", "pixel", (F.col("t") * 2).alias("t"))
    return rounded(timejoin.interpolate(left, c, ["pixel"], "t", ["z", "z_ci"]).where("z IS NOT NULL").select("obs_id", "z", "z_ci"))


@query("nearest_date", f"""WITH {OBS}, m AS (SELECT pixel, arg_min(struct_pack(t := t, z := z), struct_pack(d := abs(t - 14.3), t := t)) AS q FROM obs GROUP BY pixel) SELECT pixel, {r('q.t')} AS t, {r('q.z')} AS z FROM m""")
def nearest_date(spark, d):
    return rounded(timejoin.value_at_nearest(obs(spark, d), ["pixel"], "t", 14.3, ["z"]))


GRID = "grid AS (SELECT CAST(g * 2.7 + 0.13 AS DOUBLE) AS t FROM range(0, 11) x(g))"


@query("closest_valid_obs", f"""WITH {OBS}, {GRID}, kept AS (SELECT * FROM obs), dates AS (SELECT DISTINCT CAST(day AS DOUBLE) + 0.5 AS t FROM obs),
s AS (SELECT g.t AS gt, arg_min(dt.t, struct_pack(d := round(abs(dt.t - g.t), 9), t := dt.t)) AS st FROM grid g, dates dt GROUP BY g.t), k AS (SELECT pixel FROM kept GROUP BY pixel HAVING count(*) >= 2),
n AS (SELECT pixel, gt, st, arg_min(o.t, struct_pack(d := abs(o.t - st), t := o.t)) AS nt FROM s, kept o WHERE pixel IN (SELECT pixel FROM k) GROUP BY pixel, gt, st)
SELECT pixel, {r('gt')} AS t, {r('st')} AS stack_t, {r('abs(nt - gt)')} AS lag FROM n""")
def closest_valid_obs(spark, d):
    o = obs(spark, d)
    grid = spark.range(11).select((F.col("id") * 2.7 + 0.13).cast("double").alias("t"))
    dates = o.select((F.col("day") + 0.5).cast("double").alias("t")).distinct()
    return rounded(timejoin.lag_to_closest(o.select("pixel", "t"), dates, grid, ["pixel"]))


@query("obs_per_interval", f"WITH {OBS} SELECT pixel, CAST(floor(t / 5) AS BIGINT) AS step, count(*) AS n, CAST(max(CASE WHEN err > 4 THEN 1 ELSE 0 END) AS BIGINT) AS any_poor FROM obs GROUP BY 1, 2")
def obs_per_interval(spark, d):
    k = obs(spark, d).groupBy("pixel", F.floor(F.col("t") / 5).alias("step"))
    return rounded(k.agg(F.count("*").alias("n"), F.max((F.col("err") > 4).cast("int")).alias("any_poor")))


CAMPAIGNS = [("A", 30.0, 60.0), ("B", 150.0, 190.0), ("C", 185.0, 200.0), ("D", 900.0, 933.0)]


@query("campaign_snap", f"""WITH {POINTS}, p AS (SELECT id, datediff('day', DATE '1995-01-01', CAST(t AS DATE)) + 0.25::DOUBLE AS dy FROM points), c(name, a, b) AS (VALUES {', '.join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in CAMPAIGNS)})
SELECT id, name, (a + b) / 2 AS mid_day FROM p JOIN c ON dy BETWEEN a - 10 AND b + 10""")
def campaign_snap(spark, d):
    p = points(spark, d).select("id", (F.datediff(F.to_date("t"), F.lit("1995-01-01").cast("date")) + 0.25).cast("double").alias("dy"))
    c = spark.createDataFrame(CAMPAIGNS, "name string, first_day double, last_day double")
    return timejoin.snap_to_campaign(p, c, "dy").select("id", "name", "mid_day")


@query("point_compare", f"""WITH {OBS}, {CUBE}, cb AS (SELECT pixel % 16 AS px, pixel // 16 AS py, t, z, z_ci FROM cube), q AS (SELECT event_id AS id, user_id % 15 * 10 + event_id % 10 AS x, user_id // 16 * 10 + event_id // 10 % 10 AS y, o.t * 2 AS t, o.z / 100 AS h FROM events JOIN obs o ON obs_id = event_id),
w AS (SELECT id, t, h, x // 10 + i AS px, y // 10 + j AS py, CASE WHEN i = 1 THEN x % 10 / 10.0::DOUBLE ELSE 1 - x % 10 / 10.0::DOUBLE END * CASE WHEN j = 1 THEN y % 10 / 10.0::DOUBLE ELSE 1 - y % 10 / 10.0::DOUBLE END AS w FROM q, range(0, 2) a(i), range(0, 2) b(j)),
f AS (SELECT * FROM w WHERE w > 0), v AS (SELECT f.*, a.z * (1 - (f.t - floor(f.t))) + coalesce(b.z, 0) * (f.t - floor(f.t)) AS z, a.z_ci * (1 - (f.t - floor(f.t))) + coalesce(b.z_ci, 0) * (f.t - floor(f.t)) AS z_ci
  FROM f LEFT JOIN cb a ON a.px = f.px AND a.py = f.py AND a.t = floor(f.t) LEFT JOIN cb b ON b.px = f.px AND b.py = f.py AND b.t = floor(f.t) + 1 AND f.t > floor(f.t)),
g AS (SELECT id, h, sum(z * w) AS z, sum(z_ci * w) AS ci FROM v GROUP BY id, h HAVING count(z) = count(*))
SELECT id, {r('h - z')} AS dh, {r('(h - z) / ci')} AS z_score FROM g""")
def point_compare(spark, d):
    c = cube(spark, d).select((F.col("pixel") % 16).cast("int").alias("px"), F.floor(F.col("pixel") / 16).cast("int").alias("py"), F.col("t").cast("double").alias("t"), "z", "z_ci")
    i, u = F.col("obs_id"), F.col("pixel")
    p = obs(spark, d).select(i.alias("id"), (F.col("t") * 2).alias("t"), (u % 15 * 10 + i % 10).cast("double").alias("x"), (F.col("py") * 10 + F.floor(i / 10) % 10).cast("double").alias("y"), (F.col("z") / 100).alias("h"))
    return rounded(validate.compare_points(p, c, 10.0).select("id", "dh", "z_score"))


@query("raster_compare", f"""WITH {OBS}, {PIXELS}, {CUBE} SELECT p.pixel, {r('ref_z - (a.z * 0.75 + b.z * 0.25)')} AS dh, {r('(ref_z - (a.z * 0.75 + b.z * 0.25)) / (a.z_ci * 0.75 + b.z_ci * 0.25)')} AS z_score
FROM pixels p JOIN cube a ON a.pixel = p.pixel AND a.t = 20 JOIN cube b ON b.pixel = p.pixel AND b.t = 21 WHERE p.slope < 30""")
def raster_compare(spark, d):
    p = pixels(spark, d)
    c = cube(spark, d).withColumn("t", F.col("t").cast("double"))
    return rounded(validate.compare_raster(p.select("pixel", F.col("ref_z").alias("z")), c, p.where("slope < 30").select("pixel"), 20.25, ["pixel"]))


@query("yearfraction", f"SELECT o_orderkey, {r("year(o_orderdate) + (epoch_us(o_orderdate) - epoch_us(date_trunc('year', o_orderdate)))::DOUBLE / (epoch_us(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR) - epoch_us(date_trunc('year', o_orderdate)))", 9)} AS yf FROM orders")
def yearfraction(spark, d):
    return rounded(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", year_fraction(F.col("o_orderdate")).alias("yf")), 9)


BINNED = """sp AS (SELECT feature, 100 * floor(min(ref) / 100) AS lo, CASE WHEN max(ref) = 100 * floor(min(ref) / 100) THEN max(ref) + 0.01 ELSE max(ref) END AS hi, count(DISTINCT pixel) AS np FROM series GROUP BY feature),
binned AS (SELECT s.*, CASE WHEN np <= 50 THEN lo ELSE 100 * floor(ref / 100) END AS bin, CASE WHEN np <= 50 THEN lo + (hi + 0.01 - lo) / 2 ELSE 100 * floor(ref / 100) + 50 END AS bin_mid
  FROM series s JOIN sp USING (feature) WHERE np <= 50 OR 100 * floor(ref / 100) < hi)"""
CLEAN = """st AS (SELECT feature, bin, count(*) AS n, median(dh) AS m, 1.4826::DOUBLE * mad(dh) AS s FROM binned WHERE year = 2001 GROUP BY feature, bin),
far AS (SELECT DISTINCT b.feature, b.bin, b.pixel FROM binned b JOIN st USING (feature, bin) WHERE year = 2001 AND n > 10 AND s > 0 AND abs(dh - m) >= 1.5 * s),
clean AS (SELECT * FROM binned b WHERE NOT EXISTS (SELECT 1 FROM far f WHERE f.feature = b.feature AND f.bin = b.bin AND f.pixel = b.pixel))"""


@query("hypso_bins", f"WITH {SERIES}, {BINNED} SELECT feature, {r('bin')} AS bin, {r('bin_mid')} AS bin_mid, count(*) AS n, count(DISTINCT pixel) AS pixels FROM binned GROUP BY feature, bin, bin_mid")
def hypso_bins(spark, d):
    b = hypso.elevation_bins(series(spark, d), ["feature"])
    return rounded(b.groupBy("feature", "bin", "bin_mid").agg(F.count("*").alias("n"), F.count_distinct("pixel").alias("pixels")))


@query("hypso_percent_bins", f"""WITH {SERIES}, sp AS (SELECT feature, 10 * floor(min(ref) / 10) AS lo, max(ref) AS top, count(DISTINCT pixel) AS np FROM series GROUP BY feature),
z AS (SELECT *, CASE WHEN top = lo THEN lo + 0.01 ELSE top END AS hi FROM sp), w AS (SELECT *, CASE WHEN np <= 50 THEN hi + 0.01 - lo ELSE ceil(0.1::DOUBLE * (hi - lo)) END AS bin_size FROM z),
b AS (SELECT feature, pixel, hi, bin_size, CASE WHEN np <= 50 THEN lo ELSE lo + floor((ref - lo) / bin_size) * bin_size END AS bin FROM series JOIN w USING (feature))
SELECT feature, {r('bin')} AS bin, {r('bin + bin_size / 2')} AS bin_mid, {r('bin_size')} AS bin_size, count(*) AS n, count(DISTINCT pixel) AS pixels FROM b WHERE bin < hi GROUP BY feature, bin, bin_size""")
def hypso_percent_bins(spark, d):
    b = hypso.elevation_bins(series(spark, d), ["feature"], percent=10.0)
    return rounded(b.groupBy("feature", "bin", "bin_mid", "bin_size").agg(F.count("*").alias("n"), F.count_distinct("pixel").alias("pixels")))


def _clean(spark, d):
    b = hypso.elevation_bins(series(spark, d), ["feature"]).withColumn("final", F.col("year") == 2001)
    return hypso.drop_outliers(b, ["feature", "bin"], "final", factor=1.5)


@query("hypso_nmad_filter", f"WITH {SERIES}, {BINNED}, {CLEAN} SELECT feature, {r('bin')} AS bin, count(*) AS n, {r('sum(dh)', 4)} AS total FROM clean GROUP BY feature, bin")
def hypso_nmad_filter(spark, d):
    return rounded(_clean(spark, d).groupBy("feature", "bin").agg(F.count("*").alias("n"), F.sum("dh").alias("total")), 4)


MEANS = "means AS (SELECT feature, bin, bin_mid, year, count(*) AS n, sum(dh / (err * err)) / sum(1 / (err * err)) AS mean, sqrt(count(*) / sum(1 / (err * err))) AS ss_err, stddev_pop(dh) AS std FROM clean GROUP BY ALL)"


@query("hypso_mean", f"WITH {SERIES}, {BINNED}, {CLEAN}, {MEANS} SELECT feature, {r('bin')} AS bin, CAST(year AS BIGINT) AS year, n, {r('mean')} AS mean, {r('ss_err')} AS ss_err, {r('std')} AS std FROM means")
def hypso_mean(spark, d):
    return rounded(hypso.bin_means(_clean(spark, d), ["feature", "bin", "year"]))


@query("hypso_void_interp", f"""WITH {SERIES}, {BINNED}, {CLEAN}, {MEANS}, v AS (SELECT feature, year, bin_mid AS x, CASE WHEN (CAST(bin AS BIGINT) // 100) % 3 <> 1 THEN mean END AS y, ss_err AS e FROM means),
nb AS (SELECT a.feature, a.year, a.x, b.x AS bx, b.y AS by_, b.e AS be, row_number() OVER (PARTITION BY a.feature, a.year, a.x ORDER BY abs(b.x - a.x), b.x) AS k FROM v a JOIN v b ON a.feature = b.feature AND a.year = b.year AND b.y IS NOT NULL WHERE a.y IS NULL),
two AS (SELECT p.feature, p.year, p.x, (q.bx - p.x) / (q.bx - p.bx) AS a, (p.x - p.bx) / (q.bx - p.bx) AS b, p.by_ AS y1, q.by_ AS y2, p.be AS e1, q.be AS e2, abs(p.bx - p.x) AS dx FROM nb p JOIN nb q USING (feature, year, x) WHERE p.k = 1 AND q.k = 2)
SELECT v.feature, CAST(v.year AS BIGINT) AS year, {r('v.x')} AS x, {r('coalesce(v.y, a * y1 + b * y2)')} AS y, {r('CASE WHEN v.y IS NULL AND a IS NOT NULL THEN sqrt(a * a * e1 * e1 + b * b * e2 * e2) ELSE e END')} AS e, {r('dx * dx / 8 * 0.002')} AS lin_err
FROM v LEFT JOIN two USING (feature, year, x)""")
def hypso_void_interp(spark, d):
    m = hypso.bin_means(_clean(spark, d), ["feature", "bin", "bin_mid", "year"])
    v = m.select("feature", "year", F.col("bin_mid").alias("x"), F.when(F.floor(F.col("bin") / 100) % 3 != 1, F.col("mean")).alias("y"), F.col("ss_err").alias("e"))
    return rounded(hypso.fill_voids(v, ["feature", "year"], "x", "y", "e"))


@query("hypso_covar", f"""WITH {SERIES}, {BINNED}, {CLEAN}, {MEANS}, v AS (SELECT feature, bin_mid, avg(ss_err) AS err, sum(n) * 1.0::DOUBLE AS area FROM means GROUP BY feature, bin_mid),
k AS (SELECT *, coalesce(sum(100 / tan(radians(30.0::DOUBLE))) OVER (PARTITION BY feature ORDER BY bin_mid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dist FROM v),
s AS (SELECT a.feature, sum(exp(-abs(a.dist - b.dist) / 900.0) * a.err * b.err * a.area * b.area) AS q FROM k a JOIN k b USING (feature) GROUP BY a.feature), t AS (SELECT feature, sum(area) AS area FROM v GROUP BY feature)
SELECT feature, {r('sqrt(q) / area')} AS err_total FROM s JOIN t USING (feature)""")
def hypso_covar(spark, d):
    m = hypso.bin_means(_clean(spark, d), ["feature", "bin", "bin_mid", "year"]).groupBy("feature", "bin_mid").agg(F.avg("ss_err").alias("err"), F.sum("n").cast("double").alias("area"))
    m = m.withColumn("slope", F.lit(30.0)).withColumn("crange", F.lit(900.0))
    return rounded(hypso.hypso_covariance(m, ["feature"]))


@query("lowess", f"""WITH {SERIES}, {BINNED}, {CLEAN}, {MEANS}, v AS (SELECT feature, year, bin_mid AS x, mean AS y, ss_err AS e FROM means),
p AS (SELECT a.feature, a.year, a.x, b.x - a.x AS dx, b.y AS y, exp(-sqrt(abs(b.x - a.x) / 200)) / (b.e * b.e) AS w FROM v a JOIN v b USING (feature, year)),
s AS (SELECT feature, year, x, sum(w) AS s, sum(w * dx) AS sx, sum(w * y) AS sy, sum(w * dx * dx) AS sxx, sum(w * dx * y) AS sxy FROM p GROUP BY ALL)
SELECT feature, CAST(year AS BIGINT) AS year, {r('x')} AS x, {r('CASE WHEN s * sxx - sx * sx <> 0 THEN (sxx * sy - sx * sxy) / (s * sxx - sx * sx) END', 4)} AS smooth FROM s""")
def lowess(spark, d):
    m = hypso.bin_means(_clean(spark, d), ["feature", "bin_mid", "year"])
    v = m.select("feature", "year", F.col("bin_mid").alias("x"), F.col("mean").alias("y"), F.col("ss_err").alias("err"))
    return rounded(hypso.local_regression(v, ["feature", "year"], 800.0), 4)


def _growth_sql(i: int, t: str) -> str:
    (ra, oa), (rr, oo), (rb, ob) = hypso.GROWTH[-1], hypso.GROWTH[i], hypso.GROWTH[len(hypso.GROWTH) - 1 - hypso.FOLLOWS[i]]
    c = hypso.ONSET[i]
    return f"CASE WHEN {t} >= {c} THEN pow({ra!r} * {t} + {oa!r}, 2) - pow({rr!r} * {t} + {oo!r}, 2) - ({(oa + c * ra) ** 2 - (ob + c * rb) ** 2!r}) ELSE 0 END"


def _corr_sql() -> str:
    steps, used = [], "0"
    for k in range(5):
        steps.append(f"greatest({_growth_sql(4 - k, '((b + 0.5) * 5)')} - ({used}), 0)")
        used = f"{used} + {steps[-1]}"
    steps.append(f"greatest(v - ({used}), 0)")
    return ", ".join(f"{r(f'sqrt(sum(sqrt({s}) * n) / sum(n))')} AS sd_{k}" for k, s in enumerate(steps))


@query("correlated_errors", f"WITH {SERIES}, g AS (SELECT feature, year, CAST(floor(pixel % 997 / 5.0) AS BIGINT) AS b, count(*) AS n, avg(err * err) AS v FROM series GROUP BY ALL) SELECT feature, CAST(year AS BIGINT) AS year, {_corr_sql()} FROM g GROUP BY feature, year")
def correlated_errors(spark, d):
    s = series(spark, d).withColumn("days", (F.col("pixel") % 997).cast("double"))
    return rounded(hypso.correlated_errors(s, ["feature", "year"]))


def rect_sql(name: str, source: str, area: str, models: list[tuple[str, str, str, object]], sills: str) -> str:
    """A CTE ``name``: the rows of ``source`` with neff, the effective samples of a rectangle of ``area`` and the width of a bin."""
    total = lambda h: " + ".join(f(h, a, c) for _, a, c, f in models)
    wide = repr(100 / math.tan(math.radians(30)))
    return f"""{name}_w AS (SELECT *, least({wide}, {area} / {wide}) AS w FROM {source}), {name}_e AS (SELECT *, w / 2 AS lo, ({area} / w - w / 2) / 99 AS st FROM {name}_w),
{name} AS (SELECT * EXCLUDE (w, lo, st), {sills} * {area} / (2 * pi() * ({total('lo')} + list_sum([({total('(lo + st * (i + 1))')} - ({total('(lo + st * i)')})) * 2 / pi() * atan(w / (2 * (lo + st * i + st / 2))) FOR i IN range(0, 99)]))) AS neff_{name} FROM {name}_e)"""


@query("hypso_bin_errors", f"""WITH {SERIES}, {BINNED}, {CLEAN}, {MEANS}, q AS (SELECT feature, bin, year, ss_err, std, n * 900.0::DOUBLE AS am, n * 1350.0::DOUBLE AS area_all, pow(10, 2 + n * 13500.0::DOUBLE / 1e6 / 2.5) AS cr FROM means),
{rect_sql('m', 'q', 'am', [('Sph', '100.0', '16.0', sph_int), ('Sph', '1500.0', '0.36', sph_int)], '16.36')}, {rect_sql('t', 'm', 'area_all', [('Exp', 'cr', 'std', exp_int)], 'std')}, {rect_sql('s', 't', 'am', [('Exp', 'cr', 'std', exp_int)], 'std')},
e AS (SELECT *, ss_err / sqrt(neff_m) AS num, CASE WHEN std > 0 THEN coalesce(std * sqrt((neff_t - neff_s) / (neff_t * neff_t)), 0) ELSE 0 END AS geo FROM s)
SELECT feature, {r('bin')} AS bin, CAST(year AS BIGINT) AS year, {r('geo', 4)} AS geo_err, {r('sqrt(num * num + geo * geo)', 4)} AS all_err FROM e""")
def hypso_bin_errors(spark, d):
    m = hypso.bin_means(_clean(spark, d), ["feature", "bin", "bin_mid", "year"]).withColumn("area_meas", F.col("n") * 900.0)
    m = m.withColumn("area", F.col("area_meas") * 1.5).withColumn("feature_area", F.col("area") * 10)
    return rounded(hypso.bin_errors(m, 100.0).select("feature", "bin", "year", "geo_err", "all_err"), 4)


@query("hypso_errors", f"""WITH {SERIES}, {BINNED}, {CLEAN}, {MEANS}, q AS (SELECT feature, bin, year, ss_err, n * 900.0::DOUBLE AS am, least({100 / math.tan(math.radians(30))!r}, n * 900.0 / {100 / math.tan(math.radians(30))!r}) AS w FROM means),
e AS (SELECT *, w / 2 AS lo, (am / w - w / 2) / 99 AS st FROM q),
s AS (SELECT *, {sph_int('lo', '100.0', '16.0')} + {sph_int('lo', '1500.0', '0.36')} + list_sum([({sph_int('(lo + st * (i + 1))', '100.0', '16.0')} + {sph_int('(lo + st * (i + 1))', '1500.0', '0.36')} - {sph_int('(lo + st * i)', '100.0', '16.0')} - {sph_int('(lo + st * i)', '1500.0', '0.36')}) * 2 / pi() * atan(w / (2 * (lo + st * i + st / 2))) FOR i IN range(0, 99)]) AS f FROM e)
SELECT feature, {r('bin')} AS bin, CAST(year AS BIGINT) AS year, {r('ss_err * sqrt(2 * pi() * f / (16.36 * am))', 5)} AS num_err FROM s""")
def hypso_errors(spark, d):
    m = hypso.bin_means(_clean(spark, d), ["feature", "bin", "bin_mid", "year"]).withColumn("area_meas", F.col("n") * 900.0)
    m = m.withColumn("area", F.col("area_meas") * 1.5).withColumn("feature_area", F.col("area") * 10)
    return rounded(hypso.bin_errors(m, 100.0).select("feature", "bin", "year", "num_err"), 5)


@query("hypso_integrate")
def hypso_integrate(spark, d):
    s = series(spark, d).groupBy("feature", "pixel", F.col("year").alias("t")).agg(F.avg("dh").alias("dh"), F.max("err").alias("err"), F.first("ref").alias("ref"))
    out, _ = hypso.integrate(s.withColumn("days", (F.col("pixel") % 400).cast("double")), ["feature"], 900.0)
    return rounded(out.select("feature", "t", "dh", "err_dh", "perc_area_meas", "perc_area_res", "dt", "std_dt", "err_corr_150", "err_corr_200000"))
