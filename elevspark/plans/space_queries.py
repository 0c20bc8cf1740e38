"""Aggregation to regions and periods, tiles and projections, polygons, resampling, names and metadata."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo, models
from ..functions.dates import scene_date
from ..operators import aggregate, geometry
from ..operators.error_model import bin_of
from ..sources import readers
from ..sources.adapters import FEATURES, OBS, PIXELS, POINTS, SERIES, features, obs, pixels, points, series
from . import pipelines
from .rounding import r, rounded

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# --- aggregation ---------------------------------------------------------------------------------

YEARLY = f"""{SERIES}, {FEATURES}, yearly AS (SELECT feature AS rgiid, CAST(year AS DOUBLE) AS time, CASE WHEN (feature + year) % 11 <> 0 THEN avg(dh) END AS dh, 1 + avg(err) / 50 AS err_dh, 5.0::DOUBLE AS perc_err_cont,
  0.5 + (feature % 4) / 10.0::DOUBLE AS perc_area_meas, 0.6 + (feature % 3) / 10.0::DOUBLE AS perc_area_res, count(*) * 1.0::DOUBLE AS valid_obs, 1.0::DOUBLE AS valid_obs_py FROM series WHERE feature % 10 <> 7 GROUP BY feature, year)"""


def yearly(spark, d):
    s = series(spark, d).where("feature % 10 != 7").groupBy(F.col("feature").alias("rgiid"), "year").agg(F.avg("dh").alias("m"), F.avg("err").alias("e"), F.count("*").alias("n"))
    k = F.col("rgiid")
    return s.select(
        "rgiid", F.col("year").cast("double").alias("time"), F.when((k + F.col("year")) % 11 != 0, F.col("m")).alias("dh"), (1 + F.col("e") / 50).alias("err_dh"), F.lit(5.0).alias("perc_err_cont"),
        (0.5 + (k % 4) / 10).alias("perc_area_meas"), (0.6 + (k % 3) / 10).alias("perc_area_res"), F.col("n").cast("double").alias("valid_obs"), F.lit(1.0).alias("valid_obs_py"),
    )


def base(spark, d):
    return features(spark, d)


FULL = f"""{YEARLY}, full_ AS (SELECT f.rgiid, y.time, f.reg, f.lat, f.lon, f.term, CASE WHEN f.nom <> 2 THEN z.dh END AS dh, CASE WHEN f.cl <> 2 THEN f.area END AS area, z.err_dh, z.perc_err_cont, z.perc_area_meas, z.perc_area_res, z.valid_obs, z.valid_obs_py
  FROM features f JOIN (SELECT DISTINCT rgiid, time FROM yearly UNION SELECT f.rgiid, t.time FROM features f, (SELECT DISTINCT time FROM yearly) t WHERE f.rgiid NOT IN (SELECT rgiid FROM yearly)) y USING (rgiid) LEFT JOIN yearly z ON z.rgiid = y.rgiid AND z.time = y.time)"""


def full(spark, d):
    return aggregate.complete_inventory(yearly(spark, d), base(spark, d))


@query("inventory_complete", f"WITH {FULL} SELECT rgiid, time, CAST(reg AS BIGINT) AS reg, {r('dh')} AS dh, {r('area', 3)} AS area, {r('err_dh')} AS err_dh FROM full_")
def inventory_complete(spark, d):
    f = full(spark, d).select("rgiid", "time", "reg", "dh", F.round("area", 3).alias("area"), "err_dh")
    return rounded(f)


@query("combined_regions", f"WITH {FEATURES}, x AS (SELECT rgiid, reg FROM features UNION ALL SELECT rgiid, 20 FROM features WHERE reg IN (1, 2) UNION ALL SELECT rgiid, 21 FROM features WHERE reg IN (13, 14, 15)) SELECT CAST(reg AS BIGINT) AS reg, count(*) AS n FROM x GROUP BY reg")
def combined_regions(spark, d):
    return rounded(aggregate.with_combined_regions(base(spark, d)).groupBy("reg").agg(F.count("*").alias("n")))


NODATA = "nd AS (SELECT reg, coalesce(sum(a) FILTER (WHERE gap), 0) AS area_nodata FROM (SELECT reg, rgiid, bool_or(dh IS NULL OR area IS NULL OR err_dh IS NULL) AS gap, max(area) AS a FROM full_ GROUP BY reg, rgiid) GROUP BY reg)"
REGION = f"""{NODATA}, rg0 AS (SELECT reg, time, sum(dh * area) AS dv, sum(area) AS a, sum(perc_err_cont * area) AS pc, sum(perc_area_meas * area) AS pm, sum(perc_area_res * area) AS pr, sum(valid_obs * area) AS vo, sum(valid_obs_py * area) AS vp
  FROM full_ WHERE dh IS NOT NULL AND area IS NOT NULL AND err_dh IS NOT NULL GROUP BY reg, time),
rg AS (SELECT reg, time, dv * (a + area_nodata) / a AS dvol, a + area_nodata AS area, pc / a AS perc_err_cont, vo / a AS valid_obs, vp / a AS valid_obs_py, pm / (a + area_nodata) AS perc_area_meas, pr / (a + area_nodata) AS perc_area_res, area_nodata,
  dv / a AS dh, 0.1 + time / 10000 AS err_dh FROM rg0 JOIN nd USING (reg))"""


def regions(spark, d):
    f = full(spark, d)
    errors = f.select("reg", "time").distinct().withColumn("err_dh", 0.1 + F.col("time") / 10000)
    return aggregate.regional_sum(f, ["reg"], errors=errors)


@query("regional_sum", f"""WITH {FULL}, {REGION}, e AS (SELECT *, sqrt(pow(err_dh * area, 2) + pow(dh * perc_err_cont / 100 * area, 2)) AS ev FROM rg)
SELECT CAST(reg AS BIGINT) AS reg, time, {r('dvol / 1e6')} AS dvol, {r('area / 1e6')} AS area, {r('perc_err_cont')} AS perc_err_cont, {r('valid_obs')} AS valid_obs, {r('perc_area_meas')} AS perc_area_meas, {r('perc_area_res')} AS perc_area_res,
  {r('area_nodata / 1e6')} AS area_nodata, {r('dh')} AS dh, {r('ev / 1e6')} AS err_dvol, {r('dvol * 0.85 / 1e9')} AS dm, {r('sqrt(pow(ev * 0.85 / 1e9, 2) + pow(dvol * 0.06 / 1e9, 2))')} AS err_dm FROM e""")
def regional_sum(spark, d):
    g = regions(spark, d)
    for c in ("dvol", "area", "area_nodata", "err_dvol"):
        g = g.withColumn(c, F.col(c) / 1e6)
    return rounded(g.select("reg", "time", "dvol", "area", "perc_err_cont", "valid_obs", "perc_area_meas", "perc_area_res", "area_nodata", "dh", "err_dvol", "dm", "err_dm"))


@query("annual_dates", f"WITH {OBS}, g AS (SELECT pixel, t * 0.5 + 2000 AS t FROM obs), y AS (SELECT DISTINCT pixel, CAST(2000 + u AS DOUBLE) AS y FROM g, range(0, 21) x(u)) SELECT pixel, CAST(y AS BIGINT) AS year, {r('arg_min(t, struct_pack(d := abs(t - y), t := t))')} AS time FROM y JOIN g USING (pixel) GROUP BY pixel, y")
def annual_dates(spark, d):
    g = obs(spark, d).select("pixel", (F.col("t") * 0.5 + 2000).alias("time"))
    return rounded(aggregate.annual_dates(g, ["pixel"]))


PERIODS = [(1995.0 + k * i, 1995.0 + k * (i + 1)) for k in (1, 2, 3, 6) for i in range(6 // k)] + [(1995.75, 1998.25), (1996.5, 2000.25)]
RATES = f"""p("start", "end") AS (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in PERIODS)}), st AS (SELECT reg, p."start" AS y0, p."end" AS y1, (SELECT arg_min(time, struct_pack(d := abs(time - p."start"), t := time)) FROM rg q WHERE q.reg = g.reg) AS t0,
  (SELECT arg_min(time, struct_pack(d := abs(time - p."end"), t := time)) FROM rg q WHERE q.reg = g.reg) AS t1 FROM (SELECT DISTINCT reg FROM rg) g, p),
fx AS (SELECT reg, arg_min(area, time) AS area, arg_min(perc_err_cont, time) AS pc, arg_min(perc_area_meas, time) AS pm, arg_min(perc_area_res, time) AS pr, arg_min(area_nodata, time) AS nd FROM rg GROUP BY reg),
rt AS (SELECT st.reg, y0, y1, b.dvol - a.dvol AS dv, fx.area, sqrt(pow(sqrt(b.err_dh * b.err_dh + a.err_dh * a.err_dh) * fx.area, 2) + pow((b.dvol - a.dvol) * pc / 100, 2)) AS ev, pm, pr, nd, y1 - y0 AS yr,
  coalesce((SELECT sum(valid_obs) FROM rg o WHERE o.reg = st.reg AND o.time >= t0 AND o.time < t1), 0) AS vo, coalesce((SELECT sum(valid_obs_py) FROM rg o WHERE o.reg = st.reg AND o.time >= t0 AND o.time < t1), 0) AS vp
  FROM st JOIN rg a ON a.reg = st.reg AND a.time = t0 JOIN rg b ON b.reg = st.reg AND b.time = t1 JOIN fx ON fx.reg = st.reg),
pr AS (SELECT *, dv / yr AS dvoldt, ev / yr AS err_dvoldt, dv / area / yr AS dhdt, sqrt(pow(ev / area, 2) + pow(0.01 * dv / area, 2)) / yr AS err_dhdt, dv * 0.85 / 1e9 / yr AS dmdt, sqrt(pow(ev * 0.85 / 1e9, 2) + pow(dv * 0.06 / 1e9, 2)) / yr AS err_dmdt FROM rt),
pq AS (SELECT *, dmdt * 1e9 / area AS dmdtda, sqrt(pow(err_dmdt * 1e9 / area, 2) + pow(0.01 * dmdt * 1e9 / area, 2)) AS err_dmdtda FROM pr)"""


def rates(spark, d):
    return aggregate.period_rates(regions(spark, d), spark.createDataFrame(PERIODS, "start double, end double"), ["reg"])


@query("periods", f"""WITH {FULL}, {REGION}, {RATES} SELECT CAST(reg AS BIGINT) AS reg, y0 AS "start", y1 AS "end", {r('dhdt')} AS dhdt, {r('err_dhdt')} AS err_dhdt, {r('dmdt')} AS dmdt, {r('err_dmdt')} AS err_dmdt,
  {r('dmdtda')} AS dmdtda, {r('err_dmdtda')} AS err_dmdtda, {r('dvoldt / 1e6')} AS dvoldt, {r('err_dvoldt / 1e6')} AS err_dvoldt, {r('vo')} AS valid_obs, {r('vp')} AS valid_obs_py FROM pq""")
def periods(spark, d):
    g = rates(spark, d).withColumn("dvoldt", F.col("dvoldt") / 1e6).withColumn("err_dvoldt", F.col("err_dvoldt") / 1e6)
    return rounded(g.select("reg", "start", "end", "dhdt", "err_dhdt", "dmdt", "err_dmdt", "dmdtda", "err_dmdtda", "dvoldt", "err_dvoldt", "valid_obs", "valid_obs_py"))


@query("global_sum", f"""WITH {FULL}, {REGION}, {RATES}, g AS (SELECT y0, y1, sum(area) AS area, sum(nd) AS nd, sum(dmdt) AS dmdt, sqrt(sum(err_dmdt * err_dmdt)) AS em, sum(dvoldt) AS dv, sqrt(sum(err_dvoldt * err_dvoldt)) AS ev, 0.01 * sqrt(sum(area * area)) AS ea,
  sum(pr * area) / sum(pr) AS par, sum(pm * area) / sum(pm) AS pam, sum(pm * area) / sum(area) AS sm FROM pq GROUP BY y0, y1)
SELECT y0 AS "start", y1 AS "end", {r('dmdt')} AS dmdt, {r('em')} AS err_dmdt, {r('dv / area')} AS dhdt, {r('sqrt(pow(ev / area, 2) + pow(ea * dv / (area * area), 2))')} AS err_dhdt, {r('dmdt * 1e9 / area')} AS dmdtda,
  {r('sqrt(pow(em * 1e9 / area, 2) + pow(ea * dmdt * 1e9 / (area * area), 2))')} AS err_dmdtda, {r('par / 1e6')} AS perc_area_res, {r('pam / 1e6')} AS perc_area_meas, {r('sm')} AS area_share_perc_area_meas, {r('nd / 1e6')} AS area_nodata FROM g""")
def global_sum(spark, d):
    g = aggregate.global_sum(rates(spark, d), ["start", "end"])
    for c in ("perc_area_res", "perc_area_meas", "area_nodata"):
        g = g.withColumn(c, F.col(c) / 1e6)
    return rounded(g.select("start", "end", "dmdt", "err_dmdt", "dhdt", "err_dhdt", "dmdtda", "err_dmdtda", "perc_area_res", "perc_area_meas", "area_share_perc_area_meas", "area_nodata"))


PICK = "arg_min(struct_pack(t := time, dh := dh, e := err_dh), struct_pack(d := abs(time - {0}), t := time))"


@query("feature_rates", f"""WITH {YEARLY}, g AS (SELECT rgiid, {PICK.format(1996)} AS a, {PICK.format(2000)} AS b FROM yearly GROUP BY rgiid), h AS (SELECT rgiid, area, b.dh - a.dh AS dh, sqrt(a.e * a.e + b.e * b.e) AS e, b.t - a.t AS y FROM g JOIN features USING (rgiid)),
v AS (SELECT *, dh * area AS v, sqrt(pow(e * area, 2) + pow(dh * 0.05 * area, 2)) AS ev FROM h)
SELECT rgiid, {r('dh / y')} AS dh, {r('e / y')} AS err_dh, {r('v / y / 1e6')} AS dvol, {r('ev / y / 1e6')} AS err_dvol, {r('v * 0.85 / 1e9 / y')} AS dm, {r('sqrt(pow(ev * 0.85 / 1e9, 2) + pow(v * 0.06 / 1e9, 2)) / y')} AS err_dm, {r('v * 0.85 / area / y')} AS dmda, {r('area / 1e6')} AS area_km2 FROM v""")
def feature_rates(spark, d):
    y = yearly(spark, d).join(base(spark, d).select("rgiid", "area"), "rgiid")
    g = aggregate.feature_rates(y, 1996.0, 2000.0)
    return rounded(g.withColumn("dvol", F.col("dvol") / 1e6).withColumn("err_dvol", F.col("err_dvol") / 1e6))


@query("tile_rates", f"""WITH {FULL}, x AS (SELECT floor(lat / 30) * 30 AS tile_lat, floor(lon / 60) * 60 AS tile_lon, unnest(['all', CASE WHEN term = 1 THEN 'tw' ELSE 'ntw' END]) AS category, * FROM full_),
nd AS (SELECT tile_lat, tile_lon, category, coalesce(sum(a) FILTER (WHERE gap), 0) AS nd FROM (SELECT tile_lat, tile_lon, category, rgiid, bool_or(dh IS NULL OR area IS NULL OR err_dh IS NULL) AS gap, max(area) AS a FROM x GROUP BY ALL) GROUP BY ALL),
g AS (SELECT tile_lat, tile_lon, category, time, sum(dh * area) AS dv, sum(area) AS a FROM x WHERE dh IS NOT NULL AND area IS NOT NULL AND err_dh IS NOT NULL GROUP BY ALL)
SELECT CAST(tile_lat AS BIGINT) AS tile_lat, CAST(tile_lon AS BIGINT) AS tile_lon, category, time, {r('dv * (a + nd) / a / 1e6')} AS dvol, {r('dv / a')} AS dh FROM g JOIN nd USING (tile_lat, tile_lon, category)""")
def tile_rates(spark, d):
    t = aggregate.tile_keys(aggregate.categories(full(spark, d)), 30).withColumn("tile_lon", F.floor(F.col("lon") / 60) * 60)
    g = aggregate.regional_sum(t, ["tile_lat", "tile_lon", "category"])
    return rounded(g.select(F.col("tile_lat").cast("long").alias("tile_lat"), F.col("tile_lon").cast("long").alias("tile_lon"), "category", "time", (F.col("dvol") / 1e6).alias("dvol"), "dh"))


@query("double_covar", f"""WITH {FEATURES}, s AS (SELECT reg, rgiid, lat / 20 AS lat, lon / 20 AS lon, area, 0.5 + rgiid % 3 AS e1, 0.2 * (1 + rgiid % 2) AS e2 FROM features),
p AS (SELECT a.reg, 6373000.0::DOUBLE * 2 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS d, a.e1 * b.e1 AS q1, a.e2 * b.e2 AS q2, a.area * b.area AS aa FROM s a JOIN s b USING (reg)),
v AS (SELECT reg, sum((CASE WHEN d > 50000 THEN 0 ELSE (1 - 1.5 * d / 50000 + 0.5 * pow(d / 50000, 3)) * q1 END + CASE WHEN d > 200000 THEN 0 ELSE (1 - 1.5 * d / 200000 + 0.5 * pow(d / 200000, 3)) * q2 END) * aa) AS v FROM p GROUP BY reg), t AS (SELECT reg, sum(area) AS a FROM s GROUP BY reg)
SELECT CAST(reg AS BIGINT) AS reg, {r('sqrt(v) / a')} AS err_dh FROM v JOIN t USING (reg)""")
def double_covar(spark, d):
    f = base(spark, d).withColumn("lat", F.col("lat") / 20).withColumn("lon", F.col("lon") / 20).withColumn("e1", 0.5 + F.col("rgiid") % 3).withColumn("e2", 0.2 * (1 + F.col("rgiid") % 2))
    return rounded(aggregate.double_covariance(f, ["reg"], {50000.0: "e1", 200000.0: "e2"}))


# --- tiles, zones, projections -------------------------------------------------------------------

NAME = "CASE WHEN floor({0}) >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(CAST(abs(floor({0})) AS INTEGER) AS VARCHAR), 2, '0') || CASE WHEN floor({1}) >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(CAST(abs(floor({1})) AS INTEGER) AS VARCHAR), 3, '0')"


@query("tile_naming", f"WITH {POINTS} SELECT id, {NAME.format('lat', 'lon')} AS tile, CAST(floor(lat) AS BIGINT) AS lat, CAST(floor(lon) AS BIGINT) AS lon FROM points")
def tile_naming(spark, d):
    t = points(spark, d).select("id", geo.tile_name(F.col("lat"), F.col("lon")).alias("tile"))
    return rounded(t.withColumn("c", geo.tile_corner(F.col("tile"))).select("id", "tile", F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon")))


ZONE = "(CAST(floor((lon + 180) / 6) AS BIGINT) + 1)"


@query("utm_zone", f"WITH {POINTS} SELECT id, {ZONE} AS zone, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + {ZONE} AS epsg, CAST({ZONE} AS VARCHAR) || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS utm, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + {ZONE} AS back FROM points")
def utm_zone(spark, d):
    p = points(spark, d).withColumn("epsg", geo.utm_epsg(F.col("lat"), F.col("lon"))).withColumn("utm", geo.utm_name(F.col("epsg")))
    return rounded(p.select("id", geo.utm_zone(F.col("lon")).alias("zone"), "epsg", "utm", geo.epsg_of_name(F.col("utm")).alias("back")))


def _forward_sql() -> str:
    """Krueger's series with the coefficients written out."""
    e = 2 * math.sqrt(geo._N) / (1 + geo._N)
    k = geo.SCALE * geo._A
    x = " + ".join(["eta", *[f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geo._FORWARD, 1)]])
    y = " + ".join(["xi", *[f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geo._FORWARD, 1)]])
    return f"""u AS (SELECT id, lat, lon, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + {ZONE} AS epsg, radians(lat) AS phi, radians(lon - ({ZONE} * 6 - 183)) AS lam FROM points WHERE abs(lat) < 84),
u1 AS (SELECT *, sinh(atanh(sin(phi)) - {e!r} * atanh({e!r} * sin(phi))) AS tt FROM u), u2 AS (SELECT *, atan2(tt, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + tt * tt)) AS eta FROM u1),
utm AS (SELECT id, lat, lon, epsg, 500000 + {k!r} * ({x}) AS x, CASE WHEN lat >= 0 THEN 0 ELSE 10000000 END + {k!r} * ({y}) AS y FROM u2)"""


@query("utm_forward", f"WITH {POINTS}, {_forward_sql()} SELECT id, {r('x', 3)} AS x, {r('y', 3)} AS y, {r('lat', 7)} AS lat, {r('lon', 7)} AS lon FROM utm")
def utm_forward(spark, d):
    p = points(spark, d).where(F.abs("lat") < 84).withColumn("epsg", geo.utm_epsg(F.col("lat"), F.col("lon"))).withColumn("u", geo.utm_forward(F.col("lat"), F.col("lon"), F.col("epsg")))
    p = p.withColumn("b", geo.utm_inverse(F.col("u.x"), F.col("u.y"), F.col("epsg")))  # there and back
    return rounded(p.select("id", F.round("u.x", 3).alias("x"), F.round("u.y", 3).alias("y"), F.col("b.lat").alias("lat"), F.col("b.lon").alias("lon")), 7)


@query("tile_extent_snap", f"WITH {POINTS}, {_forward_sql()} SELECT id, {r('x - (x - 30 * floor(x / 30)) - 90', 3)} AS xmin, {r('y - (y - 30 * floor(y / 30)) - 90', 3)} AS ymin, {r('x + 5000 - (x + 5000 - 30 * floor((x + 5000) / 30)) + 90', 3)} AS xmax, {r('y + 5000 - (y + 5000 - 30 * floor((y + 5000) / 30)) + 90', 3)} AS ymax FROM utm")
def tile_extent_snap(spark, d):
    p = points(spark, d).where(F.abs("lat") < 84).withColumn("u", geo.utm_forward(F.col("lat"), F.col("lon"), geo.utm_epsg(F.col("lat"), F.col("lon"))))
    s = geo.snapped_extent(F.col("u.x"), F.col("u.y"), F.col("u.x") + 5000, F.col("u.y") + 5000, 30.0)
    return rounded(p.select("id", s.alias("s")).select("id", "s.*"), 3)


@query("tile_rings", f"""WITH {POINTS}, c AS (SELECT id, floor(lat) + a AS lat, floor(lon) + b AS lon, lat AS la, lon AS lo FROM points, (VALUES (0, 0), (0, 1), (1, 1), (1, 0)) q(a, b) WHERE lat BETWEEN -84 AND 83),
{_forward_sql().replace("FROM points WHERE abs(lat) < 84", "FROM c").replace(ZONE, ZONE.replace("lon", "lo")).replace("lat >= 0", "la >= 0").replace("SELECT id, lat, lon,", "SELECT id, la, lo, lat, lon,")}
SELECT id, {r('min(x)', 2)} AS xmin, {r('min(y)', 2)} AS ymin, {r('max(x)', 2)} AS xmax, {r('max(y)', 2)} AS ymax FROM utm GROUP BY id""")
def tile_rings(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    p = points(spark, d).where(F.col("lat").between(-84, 83))  # a tile above 84 degrees is in no zone
    ring = geo.tile_ring(F.floor(lat), F.floor(lon), geo.utm_epsg(lat, lon))
    return rounded(p.select("id", geo.ring_extent(ring).alias("b")).select("id", "b.*"), 2)


@query("tile_mask", f"WITH {POINTS}, {_forward_sql()}, z AS (SELECT * FROM utm WHERE epsg = 32650) SELECT id FROM z WHERE {NAME.format('lat', 'lon')} IN ('N83E119', 'N10E115', 'N45E117')")
def tile_mask(spark, d):
    p = points(spark, d).withColumn("epsg", geo.utm_epsg(F.col("lat"), F.col("lon"))).where("epsg = 32650 AND abs(lat) < 84")
    # half a millimetre up and right of the points, which lie on multiples of a tenth of a degree
    p = p.withColumn("u", geo.utm_forward(F.col("lat"), F.col("lon"), F.col("epsg"))).select("id", (F.col("u.x") + 0.005).alias("x"), (F.col("u.y") + 0.005).alias("y"))
    out = None
    for tile in ("N83E119", "N10E115", "N45E117"):
        one = geometry.tile_mask(p, 32650, tile).select("id")
        out = one if out is None else out.unionAll(one)
    return out


@query("nearest_index", "SELECT vec_id, (SELECT arg_min(i, struct_pack(d := abs(embedding[i + 1]::DOUBLE - 0.05), i := i)) FROM range(0, len(embedding)) r(i)) AS near FROM embeddings")
def nearest_index(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return rounded(e.select("vec_id", models.nearest_index(F.col("embedding").cast("array<double>"), 0.05).cast("long").alias("near")))


@query("interpolation_correlation")
def interpolation_correlation(spark, d):
    p = points(spark, d).withColumn("lat", F.col("lat") / 100 + 45).withColumn("lon", F.col("lon") / 100 + 10)
    p = p.select("id", (F.col("id") % 3).cast("int").alias("reg"), F.year("t").alias("date"), (F.col("id") % 50).cast("double").alias("dt"), "lat", "lon", (F.col("h") / 1e4).alias("dh"))
    by_region, _ = pipelines.interpolation_correlation(p, [0.0, 25.0, 50.0], [5000.0, 50000.0], 5)
    return rounded(by_region)


# --- polygons ------------------------------------------------------------------------------------

CORNERS = ((0.0, 0.0), (3.0, 0.5), (4.0, 3.0), (2.0, 2.0), (0.5, 4.0))
RINGS = f"""rings AS (SELECT rgiid, reg, lat, lon, i, lon + x * (1 + rgiid % 3) AS x, lat + y * (1 + rgiid % 3) AS y FROM features, (VALUES {', '.join(f'({i}, {x}::DOUBLE, {y}::DOUBLE)' for i, (x, y) in enumerate(CORNERS))}) c(i, x, y)),
edges AS (SELECT a.rgiid, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM rings a JOIN rings b ON a.rgiid = b.rgiid AND b.i = (a.i + 1) % {len(CORNERS)})"""


def rings(spark, d):
    grow = 1 + F.col("rgiid") % 3
    ring = F.array(*[F.struct((F.col("lon") + x * grow).alias("x"), (F.col("lat") + y * grow).alias("y")) for x, y in CORNERS])
    return base(spark, d).withColumn("ring", ring)


@query("point_in_polygon", f"WITH {POINTS}, {FEATURES}, {RINGS}, h AS (SELECT id, rgiid, count(*) AS n FROM points p JOIN edges e ON ((y0 > p.lat) <> (y1 > p.lat)) AND p.lon < x0 + (p.lat - y0) / (y1 - y0) * (x1 - x0) GROUP BY id, rgiid) SELECT id, rgiid FROM h WHERE n % 2 = 1")
def point_in_polygon(spark, d):
    p = points(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return geometry.points_in_features(p, rings(spark, d).select("rgiid", "ring"), 5.0).select("id", "rgiid")


@query("polygon_mask", f"WITH {POINTS}, {FEATURES}, {RINGS}, h AS (SELECT id, e.rgiid, count(*) AS n FROM points p JOIN edges e ON ((y0 > p.lat) <> (y1 > p.lat)) AND p.lon < x0 + (p.lat - y0) / (y1 - y0) * (x1 - x0) JOIN features f ON f.rgiid = e.rgiid AND f.reg <> 2 GROUP BY id, e.rgiid) SELECT DISTINCT id FROM h WHERE n % 2 = 1")
def polygon_mask(spark, d):
    p = points(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return geometry.mask_of(p, rings(spark, d).select("rgiid", "reg", "ring"), 5.0, "reg", 2, exclude=True, keys=("id",))


@query("polygon_rates", f"""WITH {POINTS}, {FULL}, {RINGS}, m AS (SELECT f.rgiid, e.rgiid AS poly FROM features f JOIN edges e ON ((y0 > f.lat + 0.7) <> (y1 > f.lat + 0.7)) AND f.lon + 0.9 < x0 + (f.lat + 0.7 - y0) / (y1 - y0) * (x1 - x0) GROUP BY f.rgiid, e.rgiid HAVING count(*) % 2 = 1)
SELECT poly, time, count(*) AS n, {r('sum(dh * area) / sum(area)')} AS dh FROM full_ JOIN m USING (rgiid) WHERE dh IS NOT NULL AND area IS NOT NULL AND err_dh IS NOT NULL GROUP BY poly, time""")
def polygon_rates(spark, d):
    places = base(spark, d).select("rgiid", (F.col("lon") + 0.9).alias("x"), (F.col("lat") + 0.7).alias("y"))
    m = geometry.points_in_features(places, rings(spark, d).select(F.col("rgiid").alias("poly"), "ring"), 5.0).select("rgiid", "poly")
    f = full(spark, d).join(m, "rgiid").where("dh IS NOT NULL AND area IS NOT NULL AND err_dh IS NOT NULL")
    return rounded(f.groupBy("poly", "time").agg(F.count("*").alias("n"), (F.sum(F.col("dh") * F.col("area")) / F.sum("area")).alias("dh")))


CROSS = "(x0 * y1 - x1 * y0)"


@query("ring_measures", f"""WITH {FEATURES}, {RINGS}, g AS (SELECT rgiid, sum({CROSS}) AS c, sum((x0 + x1) * {CROSS}) AS cx, sum((y0 + y1) * {CROSS}) AS cy, sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))) AS p, min(x0) AS xmin, min(y0) AS ymin, max(x0) AS xmax, max(y0) AS ymax, bool_or(x0 < -160) AND bool_or(x0 > 160) AS dl FROM edges GROUP BY rgiid)
SELECT rgiid, {r('abs(c) / 2')} AS area, {r('p')} AS perimeter, {r('cx / (3 * c)', 4)} AS x, {r('cy / (3 * c)', 4)} AS y, {r('(p * 0.1 + pi() * 0.01) / (abs(c) / 2) * 100')} AS buffered, xmin, ymin, xmax, ymax, dl AS dateline FROM g""")
def ring_measures(spark, d):
    g = F.col("ring")
    t = rings(spark, d).withColumn("c", geo.ring_centroid(g)).withColumn("b", geo.ring_extent(g))
    out = t.select("rgiid", geo.ring_area(g).alias("area"), geo.ring_perimeter(g).alias("perimeter"), F.round("c.x", 4).alias("x"), F.round("c.y", 4).alias("y"), geo.buffered_area_ratio(g, 0.1).alias("buffered"), "b.*", geo.split_at_dateline(F.transform(g, lambda p: p["x"])).alias("dateline"))
    return rounded(out)


BOXES = "boxes AS (SELECT rgiid, lon AS xmin, lat AS ymin, lon + 1 + rgiid % 5 AS xmax, lat + 2 + rgiid % 3 AS ymax FROM features)"


def boxes(spark, d):
    k = F.col("rgiid")
    return base(spark, d).select("rgiid", F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), (F.col("lon") + 1 + k % 5).alias("xmax"), (F.col("lat") + 2 + k % 3).alias("ymax"))


@query("footprints_in_extent", f"WITH {FEATURES}, {BOXES} SELECT rgiid FROM boxes WHERE xmin <= 60 AND xmax >= -60 AND ymin <= 40 AND ymax >= -30")
def footprints_in_extent(spark, d):
    return geometry.boxes_overlapping(boxes(spark, d), (-60.0, -30.0, 60.0, 40.0)).select("rgiid")


@query("common_box", f"WITH {FEATURES}, {BOXES} SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM boxes")
def common_box(spark, d):
    return geometry.common_box(boxes(spark, d))


@query("reference_tiles", f"WITH {FEATURES}, {BOXES}, s AS (SELECT rgiid, greatest(least(xmax, 60.5) - greatest(xmin, -60.5), 0) * greatest(least(ymax, 40.5) - greatest(ymin, -30.5), 0) / ((xmax - xmin) * (ymax - ymin)) AS share FROM boxes) SELECT rgiid, {r('share')} AS share FROM s WHERE share > 0.1")
def reference_tiles(spark, d):
    return rounded(geometry.reference_tiles(boxes(spark, d), (-60.5, -30.5, 60.5, 40.5)).select("rgiid", "share"))


@query("tiles_of_boxes", f"""WITH {FEATURES}, {BOXES}, c AS (SELECT rgiid, unnest(range(CAST(floor(xmin + 0.3) AS BIGINT), CAST(floor(xmax + 0.6) AS BIGINT) + 1)) AS i, CAST(floor(ymin + 0.3) AS BIGINT) AS j0, CAST(floor(ymax + 0.6) AS BIGINT) AS j1 FROM boxes),
k AS (SELECT rgiid, i, unnest(range(j0, j1 + 1)) AS j FROM c) SELECT rgiid, {NAME.format('j', 'i')} AS tile FROM k""")
def tiles_of_boxes(spark, d):
    b = boxes(spark, d).select("rgiid", geo.ring_of_box(F.col("xmin") + 0.3, F.col("ymin") + 0.3, F.col("xmax") + 0.6, F.col("ymax") + 0.6).alias("ring"))
    return geometry.tiles_of_features(b)


@query("tile_sets", f"""WITH {FEATURES}, k AS (SELECT rgiid, {NAME.format('floor(lat / 20) * 20', 'floor(lon / 30) * 30')} AS tile FROM features UNION SELECT rgiid, {NAME.format('floor((lat + 5) / 20) * 20', 'floor(lon / 30) * 30')} FROM features),
s AS (SELECT rgiid, string_agg(tile, ',' ORDER BY tile) AS tiles FROM k GROUP BY rgiid) SELECT tiles, count(*) AS n, min(rgiid) AS first FROM s GROUP BY tiles""")
def tile_sets(spark, d):
    f = base(spark, d)
    down = lambda c, s: F.floor(c / s) * s
    k = f.select("rgiid", F.explode(F.array(geo.tile_name(down(F.col("lat"), 20), down(F.col("lon"), 30)), geo.tile_name(down(F.col("lat") + 5, 20), down(F.col("lon"), 30)))).alias("tile")).distinct()
    s = geometry.shared_tile_sets(k)
    return s.select(F.concat_ws(",", "tiles").alias("tiles"), F.size("rgiids").cast("long").alias("n"), F.get("rgiids", F.lit(0)).alias("first"))


@query("merge_stacks", f"WITH {OBS}, u AS (SELECT pixel, day, CASE WHEN obs_id % 3 <> 1 THEN z END AS z FROM obs UNION ALL SELECT pixel, day, CASE WHEN obs_id % 3 <> 2 THEN z END FROM obs) SELECT pixel, CAST(day AS BIGINT) AS day, count(DISTINCT z) > 1 AS conflict, {r('min(z)')} AS z FROM u GROUP BY pixel, day")
def merge_stacks(spark, d):
    """Two stacks of all observations, each with gaps of its own."""
    one, two = (obs(spark, d).select("pixel", "day", F.when(F.col("obs_id") % 3 != gap, F.col("z")).alias("z")) for gap in (1, 2))
    return rounded(geometry.merge_stacks(one.unionAll(two), ["pixel", "day"]).select("pixel", "day", "conflict", "z"))


@query("majority_epsg", f"WITH {POINTS}, e AS (SELECT CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + {ZONE} AS epsg FROM points) SELECT epsg FROM e GROUP BY epsg ORDER BY count(*) DESC, epsg LIMIT 1")
def majority_epsg(spark, d):
    return rounded(geometry.majority_epsg(points(spark, d).select(geo.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"))))


TARGETS = "targets AS (SELECT event_id AS tid, CAST(event_id % 140 AS DOUBLE) + 3 AS x, CAST(event_id // 140 % 70 AS DOUBLE) + 2.5 AS y FROM events)"


def targets(spark, d):
    k = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select(k.alias("tid"), ((k % 140) + 3).cast("double").alias("x"), (F.floor(k / 140) % 70 + 2.5).cast("double").alias("y"))


@query("resample_bilinear", f"""WITH {OBS}, {PIXELS}, {TARGETS}, f AS (SELECT *, x / 10 - floor(x / 10) AS fx, y / 10 - floor(y / 10) AS fy FROM targets),
w AS (SELECT tid, floor(x / 10) + i AS px, floor(y / 10) + j AS py, CASE WHEN i = 1 THEN fx ELSE 1 - fx END * CASE WHEN j = 1 THEN fy ELSE 1 - fy END AS w FROM f, range(0, 2) a(i), range(0, 2) b(j)),
g AS (SELECT tid, CASE WHEN count(ref_z) = count(*) THEN sum(ref_z * w) END AS z FROM w LEFT JOIN pixels USING (px, py) WHERE w > 0 GROUP BY tid) SELECT tid, {r('z')} AS ref_z FROM g""")
def resample_bilinear(spark, d):
    return rounded(geometry.resample(pixels(spark, d).select("px", "py", "ref_z"), targets(spark, d), 10.0, value="ref_z").select("tid", "ref_z"))


@query("resample_nearest", f"WITH {OBS}, {PIXELS}, {TARGETS} SELECT tid, {r('ref_z')} AS ref_z FROM targets LEFT JOIN pixels ON px = floor(x / 10 + 0.5) AND py = floor(y / 10 + 0.5)")
def resample_nearest(spark, d):
    return rounded(geometry.resample(pixels(spark, d).select("px", "py", "ref_z"), targets(spark, d), 10.0, "nearest", "ref_z").select("tid", "ref_z"))


@query("reproject")
def reproject(spark, d):
    """A raster of zone 33 north moved onto a grid of zone 32."""
    cell = pixels(spark, d).select((F.col("px") + 5000).alias("px"), (F.col("py") + 60000).alias("py"), "ref_z")
    grid = targets(spark, d).select("tid", "x", "y").withColumn("ll", geo.utm_inverse(500000 + F.col("x") * 100, 6000000 + F.col("y") * 100, F.lit(32633))).withColumn("u", geo.utm_forward(F.col("ll.lat"), F.col("ll.lon"), F.lit(32632)))
    moved = geometry.reproject(cell, 32633, 32632, grid.select("tid", F.col("u.x").alias("x"), F.col("u.y").alias("y")), 100.0, value="ref_z")
    return rounded(moved, 3)


@query("stack_extent", f"WITH {OBS}, {PIXELS}, c AS (SELECT px * 99.25 + 0.25 AS x, py * 100.75 + 0.35 AS y FROM pixels) SELECT round_even(min(x), 1) AS xmin, round_even(min(y), 1) AS ymin, round_even(max(x), 1) AS xmax, round_even(max(y), 1) AS ymax, (max(x) - min(x)) / (count(DISTINCT x) - 1) AS dx FROM c")
def stack_extent(spark, d):
    return geometry.stack_extent(pixels(spark, d).select((F.col("px") * 99.25 + 0.25).alias("x"), (F.col("py") * 100.75 + 0.35).alias("y")), 100.0)


@query("coregistration", f"""WITH {OBS}, s AS (SELECT dem, z / 100 + 3 AS dh, tan(radians(5 + err * 5)) * sin(radians(pixel * 37 % 360)) AS u, tan(radians(5 + err * 5)) * cos(radians(pixel * 37 % 360)) AS v FROM obs),
q AS (SELECT dem, count(*) AS n, sum(u) AS u, sum(v) AS v, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(dh) AS z, sum(u * dh) AS uz, sum(v * dh) AS vz FROM s GROUP BY dem),
d AS (SELECT *, uu * (vv * n - v * v) - uv * (uv * n - v * u) + u * (uv * v - vv * u) AS det FROM q)
SELECT dem, {r('(uz * (vv * n - v * v) - uv * (vz * n - v * z) + u * (vz * v - vv * z)) / det')} AS dx, {r('(uu * (vz * n - v * z) - uz * (uv * n - v * u) + u * (uv * z - vz * u)) / det')} AS dy, {r('(uu * (vv * z - vz * v) - uv * (uv * z - vz * u) + uz * (uv * v - vv * u)) / det')} AS dz FROM d""")
def coregistration(spark, d):
    o = obs(spark, d).select("dem", (F.col("z") / 100 + 3).alias("dh"), (5 + F.col("err") * 5).alias("slope"), (F.col("pixel") * 37 % 360).cast("double").alias("aspect"))
    return rounded(geometry.coregistration_shift(o, ["dem"]))


# --- names and metadata --------------------------------------------------------------------------

SCENE = "CASE o_orderkey % 4 WHEN 0 THEN 'SETSM_WV01_' || strftime(o_orderdate, '%Y%m%d') || '_x.tif' WHEN 1 THEN 'AST_L1A_003' || strftime(o_orderdate, '%m%d%Y') || '101112_y' WHEN 2 THEN 'aerodem_' || strftime(o_orderdate, '%Y%m%d') || '_utm' ELSE 'foo_bar_baz' END"


def scenes(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k, ymd = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyyMMdd")
    name = F.when(k == 0, F.concat(F.lit("SETSM_WV01_"), ymd, F.lit("_x.tif"))).when(k == 1, F.concat(F.lit("AST_L1A_003"), F.date_format("o_orderdate", "MMddyyyy"), F.lit("101112_y"))).when(k == 2, F.concat(F.lit("aerodem_"), ymd, F.lit("_utm"))).otherwise("foo_bar_baz")
    return o.select("o_orderkey", "o_orderdate", name.alias("name"))


@query("parse_dem_date", f"SELECT o_orderkey, {SCENE} AS name, strftime(CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 1 THEN date_trunc('day', o_orderdate) + INTERVAL 36672 SECOND ELSE date_trunc('day', o_orderdate) END, '%Y-%m-%d %H:%M:%S') AS t FROM orders")
def parse_dem_date(spark, d):
    return scenes(spark, d).select("o_orderkey", "name", F.date_format(scene_date(F.col("name")), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("stats_file", f"SELECT p_partkey, {r('p_retailprice / 100', 4)} AS rmse, CASE WHEN p_partkey % 3 <> 0 THEN {r('p_size + 0.5', 4)} END AS nmad FROM part")
def stats_file(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    text = F.array(F.lit("['NMAD_before', 'RMSE_after', 'NMAD_after']"), F.lit("[0, 0, 0]"), F.concat(F.lit("[1.5, "), F.round(F.col("p_retailprice") / 100, 4).cast("string"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit(", "), (F.col("p_size") + F.lit(0.5)).cast("string"))).otherwise(""), F.lit("]")))
    s = p.withColumn("s", readers.stats_of(text))
    return rounded(s.select("p_partkey", F.try_element_at("s", F.lit("RMSE_after")).alias("rmse"), F.try_element_at("s", F.lit("NMAD_after")).alias("nmad")), 4)


@query("scene_metadata", f"WITH {POINTS} SELECT id, CAST(id % 100 AS DOUBLE) AS cloud, strftime(t, '%Y-%m-%d') AS day, {r('lat', 3)} AS lat1, {r('lat + 0.5', 3)} AS lat2, CAST(CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS bands FROM points")
def scene_metadata(spark, d):
    v = lambda c: F.round(c, 4).cast("decimal(12,4)").cast("string")
    obj = lambda name, value: F.concat(F.lit(f"  OBJECT = {name}\n    NUM_VAL = 1\n    VALUE = "), value, F.lit(f"\n  END_OBJECT = {name}\n"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    p = points(spark, d)
    text = F.concat(
        obj("GRINGPOINTLATITUDE", F.concat(F.lit("("), v(F.col("lat")), F.lit(", "), v(F.col("lat") + 0.5), F.lit(")"))), obj("GRINGPOINTLONGITUDE", F.lit("(1.0, 2.0)")), obj("CALENDARDATE", quoted(F.date_format("t", "yyyy-MM-dd"))),
        obj("TIMEOFDAY", quoted(F.lit("10:00:00"))), obj("SCENECLOUDCOVERAGE", (F.col("id") % 100).cast("string")), obj("IMAGEDATAINFORMATION1", quoted(F.lit("a"))), F.when(F.col("id") % 2 == 0, obj("IMAGEDATAINFORMATION3N", quoted(F.lit("b")))).otherwise(""),
    )
    m = p.withColumn("m", readers.scene_metadata(text))
    return rounded(m.select("id", "m.cloud", F.col("m.date").alias("day"), F.get("m.lats", F.lit(0)).alias("lat1"), F.get("m.lats", F.lit(1)).alias("lat2"), F.size("m.bands").cast("int").alias("bands")), 3)


@query("strip_polygons", f"WITH {FEATURES}, {RINGS}, f AS (SELECT rgiid, bool_or(x < -160) AND bool_or(x > 160) AS dl FROM (SELECT rgiid, CASE WHEN x > 180 THEN x - 360 ELSE x END AS x FROM rings) GROUP BY rgiid) SELECT CAST(rgiid % 7 AS BIGINT) AS strip, CAST(sum(CASE WHEN dl THEN 2 ELSE 1 END) AS BIGINT) AS rings FROM f GROUP BY 1")
def strip_polygons(spark, d):
    wrap = lambda p: F.struct(F.when(p["x"] > 180, p["x"] - 360).otherwise(p["x"]).alias("x"), p["y"].alias("y"))
    g = rings(spark, d).select((F.col("rgiid") % 7).alias("strip"), F.transform("ring", wrap).alias("ring"))
    return rounded(readers.strip_polygon(g, ["strip"]).select("strip", F.size("rings").alias("rings")))


@query("base_inventory", f"WITH {FEATURES} SELECT CASE WHEN rgiid % 5 = 0 THEN 'G' ELSE 'R' END || rgiid AS rgiid, CAST(CASE WHEN rgiid % 5 = 0 THEN 0 ELSE cl END AS BIGINT) AS cl, CAST(CASE WHEN rgiid % 5 = 0 THEN 0 ELSE nom END AS BIGINT) AS nom, CAST(CASE WHEN rgiid % 5 = 0 THEN 0 ELSE term END AS BIGINT) AS term, CAST(CASE WHEN rgiid % 5 = 0 THEN 12 ELSE reg END AS BIGINT) AS reg FROM features")
def base_inventory(spark, d):
    f = base(spark, d).withColumn("rgiid", F.concat(F.when(F.col("rgiid") % 5 == 0, F.lit("G")).otherwise("R"), F.col("rgiid").cast("string")))
    return rounded(readers.inventory(f).select("rgiid", "cl", "nom", "term", "reg"))


@query("wkt_epsg", "SELECT o_orderkey, 32600 + o_orderkey % 60 AS epsg FROM orders")
def wkt_epsg(spark, d):
    k = 32600 + F.col("o_orderkey") % 60
    wkt = F.concat(F.lit('PROJCS["x", UNIT["metre",1], AUTHORITY["EPSG", "'), k.cast("string"), F.lit('"]]'))
    return rounded(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", geo.epsg_of_wkt(wkt).alias("epsg")))


@query("value_bins", f"WITH {OBS} SELECT CAST(CASE WHEN z < 20 THEN 0 WHEN z < 60 THEN 1 WHEN z < 150 THEN 2 WHEN z < 500 THEN 3 END AS BIGINT) AS bin, count(*) AS n FROM obs GROUP BY 1")
def value_bins(spark, d):
    return rounded(obs(spark, d).withColumn("bin", bin_of(F.col("z"), [0.0, 20.0, 60.0, 150.0, 500.0])).groupBy("bin").agg(F.count("*").alias("n")))

