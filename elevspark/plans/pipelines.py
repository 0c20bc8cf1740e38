"""End-to-end plans: stack to fit, fit to volumes, volumes to rates, fit against altimetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.dates import YEAR_RATE
from ..operators import aggregate, error_model, filters, gp, hypso, regression, validate, variograms
from ..operators.timejoin import change_from_first, lag_to_closest, snap_to_campaign
from ..sources.staging import cut


def fit_stack(obs: DataFrame, dem: DataFrame, ref: DataFrame, method: str = "gpr", prefilter: str | None = "both", ref_days: str = "days", res: float = 100.0, step: float = 0.25, span: tuple[float, float] | None = None, wls_filter: bool = False, max_uncert: float = 20.0, conf: float = 0.68, conf_filter: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Fit every pixel of a stack.

    obs: px, py, t (years), days (from the reference date), z, dem, corr. dem: dem, uncert. ref: px, py, ref_z, slope, unstable.
    ``keys``: columns of obs and ref that tell stacks apart (the tile). ``method``: gpr gives keys, px, py, t, z, z_ci, n_kept; ols and wls
    give a line per pixel. For the observations that a Gaussian process keeps see :func:`fit_stack_kept`.
    """
    out = _prepared(obs, dem, ref, prefilter, ref_days, res, wls_filter, max_uncert, keys)
    place = [*keys, "px", "py"]
    if method == "gpr":
        return gp.fit_gp(out.join(ref.select(*place, "unstable"), place), place, _grid(out, span, step), unstable="unstable")
    out = out.withColumn("w", 1 / (F.col("err") * F.col("err")) if method == "wls" else F.lit(1.0))
    return regression.ls(out, place, "t", "z", "w", conf, conf_filter)


def fit_stack_kept(obs: DataFrame, dem: DataFrame, ref: DataFrame, prefilter: str | None = "both", ref_days: str = "days", res: float = 100.0, step: float = 0.25, span: tuple[float, float] | None = None, wls_filter: bool = False, max_uncert: float = 20.0, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(series, kept) of Gaussian-process fits, from one pass: kept is keys, px, py, t, kept for every observation."""
    out = _prepared(obs, dem, ref, prefilter, ref_days, res, wls_filter, max_uncert, keys)
    place = [*keys, "px", "py"]
    return gp.fit_gp_kept(out.join(ref.select(*place, "unstable"), place), place, _grid(out, span, step), unstable="unstable")


def _grid(out: DataFrame, span: tuple[float, float] | None, step: float) -> list[float]:
    if span is None:
        ends = out.agg(F.floor(F.min("t")).alias("a"), F.max("t").alias("b")).first()
        span = (float(ends["a"] or 0), float(ends["b"] or 0) + 1.1)
    return [span[0] + step * i for i in range(int((span[1] - span[0]) / step) + 1)]


def _prepared(obs: DataFrame, dem: DataFrame, ref: DataFrame, prefilter: str | None, ref_days: str, res: float, wls_filter: bool, max_uncert: float, keys: tuple[str, ...]) -> DataFrame:
    """place, t, z, err: the filtered observations with their errors, one a date."""
    place = [*keys, "px", "py"]
    out = filters.rmse_filter(obs, dem, max_uncert).join(dem.select("dem", "uncert"), "dem")
    if prefilter:
        out = filters.prefilter(out, ref, prefilter, ref_days, res, keys=keys)
    out = cut(error_model.with_error(out, ref.select(*place, "slope"), place))
    if wls_filter:
        out = filters.wls_reference_filter(out, ref, ref_days, keys=keys)
    return out.groupBy(*place, "t").agg(F.avg("z").alias("z"), F.avg("err").alias("err"))

def volumes_of_stack(obs: DataFrame, dem: DataFrame, ref: DataFrame, features: DataFrame, pixel_area: float, keys: tuple[str, ...] = (), **fit) -> tuple[DataFrame, DataFrame]:
    """(series, bins) of features (rgiid, keys, px, py) from the observations of a stack: fit, days since kept observations, integration."""
    place = [*keys, "px", "py"]
    series, kept = fit_stack_kept(obs, dem, ref, keys=keys, **fit)
    name = F.concat_ws(":", *place).alias("pixel")
    cube, kept = (x.select(name, *[c for c in x.columns if c not in place]) for x in (series, kept))
    dates = kept.select("t").distinct()
    lags = lag_to_closest(kept.where("kept").select("pixel", "t"), dates, cube.select("t").distinct(), ["pixel"])
    lags = lags.select("pixel", "t", (F.col("lag") * YEAR_RATE).alias("days"))
    return volumes(cube.select("pixel", "t", "z", "z_ci"), lags, ref.select(name, F.col("ref_z").alias("ref")), features.select("rgiid", name), pixel_area)


def volumes(cube: DataFrame, lags: DataFrame, ref: DataFrame, features: DataFrame, pixel_area: float) -> tuple[DataFrame, DataFrame]:
    """(series, bins) of features from a fitted cube (pixel, t, z, z_ci), lags (pixel, t, days), ref (pixel, ref) and features (rgiid, pixel).

    Tiles need no merging: a feature's pixels are grouped wherever they lie. A pixel without a fit or a lag is void.
    """
    dh = change_from_first(cube, ["pixel"]).withColumnRenamed("err_dh", "err")
    obs = dh.join(lags, ["pixel", "t"], "left").join(ref, "pixel").join(features, "pixel").select("rgiid", "pixel", "t", "dh", "err", "ref", "days")
    return hypso.integrate(obs, ["rgiid"], pixel_area)


def regional_rates(series: DataFrame, base: DataFrame, lengths: tuple[int, ...] = (1, 2, 4, 5, 10, 20), years: int = 20) -> DataFrame:
    """Rates of every region and multi-annual period from feature series (rgiid, time in years, dh, err_dh, err_corr_*, shares)."""
    full = cut(aggregate.with_combined_regions(aggregate.complete_inventory(series, base)))
    dates = aggregate.annual_dates(full.where("dh IS NOT NULL"), ["reg"], years=years + 1).select("reg", "time").distinct()
    near = full.where("dh IS NOT NULL AND area IS NOT NULL AND err_dh IS NOT NULL").join(dates, ["reg", "time"], "left_semi")
    errors = aggregate.double_covariance(near, ["reg", "time"], {float(r): f"err_corr_{r}" for r in aggregate.CORR_RANGES})
    regions = aggregate.regional_sum(full, ["reg"], errors=errors)
    return aggregate.period_rates(regions, aggregate.multi_annual(regions, lengths, years=years), ["reg"])


def altimetry_comparison(points: DataFrame, campaigns: DataFrame, cube: DataFrame, res: float) -> DataFrame:
    """Altimetry points (id, utc_day, x, y, elev) against a cube in days: snapped to campaigns, interpolated, scored."""


    at = snap_to_campaign(points.where(F.col("elev") > validate.LOWEST_POINT), campaigns, "utc_day")
    out = validate.compare_points(at.withColumn("t", F.col("mid_day")).withColumnRenamed("elev", "h"), cube, res)
    return out.withColumn("years", F.col("t") / YEAR_RATE)


def refined_variograms(obs: DataFrame, ref: DataFrame, step: float, cutoff: float, slopes: list[float], heights: list[float], changes: list[float], days: str = "days", keys: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Temporal variograms of prefiltered observations by bins of slope, of height and of the trend's change.

    obs: obs_id, px, py, t (years), days, z, err. ref: px, py, ref_z, slope.
    """
    place = [*keys, "px", "py"]
    kept = filters.prefilter(obs, ref, "both", days, keys=keys)
    trend = regression.ls(kept.withColumn("w", 1 / (F.col("err") * F.col("err"))), place, "t", "z", "w").select(*place, F.col("slope").alias("change"))
    data = kept.join(ref.select(*place, "ref_z", "slope"), place).join(trend, place)
    out = {}
    for name, column, edges in (("slope", "slope", slopes), ("height", "ref_z", heights), ("change", "change", changes)):
        binned = data.withColumn("bin", error_model.bin_of(F.col(column), edges)).where("bin IS NOT NULL")
        out[name] = variograms.temporal_variogram_median(binned, place, step, cutoff, by=["bin"])
    return out


def interpolation_correlation(points: DataFrame, dt_edges: list[float], cutoffs: list[float], lags: int, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(by region, of all) spatial variograms of differences by the days between a fit's observation and the point.

    points: id, reg, date, dt, lat, lon, dh. Groups are a region, a date and a bin of dt, in the zone of their median place.
    """
    keys = ["reg", "date", "nb_dt"]
    p = points.withColumn("nb_dt", error_model.bin_of(F.abs("dt"), dt_edges)).where("nb_dt IS NOT NULL")
    middle = p.groupBy(*keys).agg(F.median("lat").alias("_la"), F.median("lon").alias("_lo")).withColumn("_epsg", geo.utm_epsg(F.col("_la"), F.col("_lo"))).drop("_la", "_lo")
    p = p.join(middle, keys).withColumn("_xy", geo.utm_forward(F.col("lat"), F.col("lon"), F.col("_epsg"))).select(*keys, "id", F.col("_xy.x").alias("x"), F.col("_xy.y").alias("y"), F.col("dh").alias("z"))
    p = cut(p)  # every cutoff reads the projected points several times
    every = None
    for cutoff in cutoffs:
        v = variograms.spatial_variogram(p, keys, cutoff, lags, least=least)
        v = v.select("reg", "nb_dt", F.lit(float(cutoff)).alias("cutoff"), F.col("lag").alias("bins"), F.col("gamma").alias("exp"), F.col("n").alias("count"))
        every = v if every is None else every.unionByName(v)
    by_region = variograms.aggregate_variograms(every, ["reg", "cutoff", "nb_dt", "bins"])
    return by_region, variograms.aggregate_variograms(by_region, ["cutoff", "nb_dt", "bins"])
