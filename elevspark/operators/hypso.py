"""Hypsometric integration: bins of elevation, robust means, voids, spatially correlated errors, change of a feature.

Every step is grouped by feature, so features of any number are integrated at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import kernel, linear_err, neff_circ, neff_rect, std_err, std_err_finite
from ..sources.staging import cut
from .error_model import nmad_by

#: Error models of the instrument (range, model, variance), void acceleration, outlier factor.
INSTRUMENT = ((100.0, "Sph", 16.0), (1500.0, "Sph", 0.36))
ACCELERATION, OUTLIER, FEW, DEFAULT_SLOPE, LARGEST_ERROR = 0.002, 5.0, 10, 30.0, 500.0
#: Correlation ranges, and (rate, offset) of the standard error with days since an observation beyond each.
RANGES = (150.0, 2000.0, 5000.0, 20000.0, 50000.0)
GROWTH = (
    (1.26694247e-03, 3.03486839e00),
    (1.35708936e-03, 4.05065698e00),
    (1.42572733e-03, 4.20851582e00),
    (1.82537137e-03, 4.28515920e00),
    (1.87250755e-03, 4.31311254e00),
    (2.06249620e-03, 4.33582812e00),
)
ONSET, FOLLOWS, LONGEST, LONGEST_TOTAL = (0, 0, 0, 180, 180), (1, 1, 1, 2, 1), 500000.0, 200000.0


def elevation_bins(df: DataFrame, keys: list[str], ref: str = "ref", size: float = 100.0, few: int = 50, percent: float | None = None) -> DataFrame:
    """``df`` with bin (lower edge), bin_mid and bin_size; a feature of ``few`` pixels or fewer is one bin.

    Bins are half-open and begin at the lowest pixel, floored to ``size``; a highest pixel that lies on an edge is in
    none unless the feature is flat. With ``percent`` a bin is that share of the feature's range, rounded up to a whole
    number, and the floor is to ``percent``.
    """
    step = float(size if percent is None else percent)
    span = df.groupBy(*keys).agg(F.min(ref).alias("_lo"), F.max(ref).alias("_hi"), F.count_distinct("pixel").alias("_n"))
    out = df.join(span, keys)
    low = F.col("_lo") - F.pmod("_lo", F.lit(step))
    high = F.when(F.col("_hi") == low, low + 0.01).otherwise(F.col("_hi"))
    one = F.col("_n") <= few
    wide = F.lit(step) if percent is None else F.ceil(F.lit(percent / 100) * (high - low)).cast("double")
    out = out.withColumn("bin_size", F.when(one, high + 0.01 - low).otherwise(wide))
    out = out.withColumn("bin", F.when(one, low).otherwise(low + F.floor((F.col(ref) - low) / F.col("bin_size")) * F.col("bin_size")))
    return out.where(F.col("bin") < high).withColumn("bin_mid", F.col("bin") + F.col("bin_size") / 2).drop("_lo", "_hi", "_n")


def drop_outliers(df: DataFrame, keys: list[str], at: str, value: str = "dh", factor: float = OUTLIER) -> DataFrame:
    """Without pixels that lie ``factor`` NMAD or more from the median of their bin where ``at`` is true (the last date).

    Bins with ten values or fewer, or without spread, keep all.
    """
    last = df.where(at)
    stats = nmad_by(last, keys, value).select(*keys, F.col("n").alias("_n"), F.col("median").alias("_m"), F.col("nmad").alias("_s"))
    far = last.join(stats, keys).where((F.col("_n") > FEW) & (F.col("_s") > 0) & (F.abs(F.col(value) - F.col("_m")) >= factor * F.col("_s")))
    return df.join(far.select(*keys, "pixel").distinct(), [*keys, "pixel"], "left_anti")


def bin_means(df: DataFrame, keys: list[str], value: str = "dh", err: str = "err") -> DataFrame:
    """keys, n, mean (weighted by 1/err^2), ss_err, std (population), area-free."""
    w = 1 / (F.col(err) * F.col(err))
    return df.where(F.col(value).isNotNull() & F.col(err).isNotNull() & (F.col(err) > 0)).groupBy(*keys).agg(
        F.count("*").alias("n"), (F.sum(F.col(value) * w) / F.sum(w)).alias("mean"), F.sqrt(F.sum(F.col(err) * F.col(err) * w) / F.sum(w)).alias("ss_err"), F.stddev_pop(value).alias("std")
    )


def bin_errors(df: DataFrame, size, area_total: str = "area", area_measured: str = "area_meas", feature_area: str = "feature_area") -> DataFrame:
    """Adds num_err, geo_err and all_err to bins (std, ss_err, areas) of ``size`` (a number or a column): instrument, and the part of the bin not seen."""
    width = (size if isinstance(size, Column) else F.lit(float(size))) / math.tan(math.radians(DEFAULT_SLOPE))
    crange = F.pow(F.lit(10.0), 2 + F.col(feature_area) / 1e6 / 2.5)
    sill = F.col("std")
    geo = std_err_finite(sill, neff_rect(F.col(area_total), width, [(crange, "Exp", sill)]), neff_rect(F.col(area_measured), width, [(crange, "Exp", sill)]))
    num = std_err(F.col("ss_err"), neff_rect(F.col(area_measured), width, list(INSTRUMENT)))
    seen = (F.col(area_measured) > 0) & (sill > 0)
    df = df.withColumn("num_err", F.when(F.col(area_measured) > 0, num).otherwise(0.0)).withColumn("geo_err", F.when(seen, F.coalesce(F.nanvl(geo, F.lit(0.0)), F.lit(0.0))).otherwise(0.0))
    return df.withColumn("all_err", F.sqrt(F.col("num_err") * F.col("num_err") + F.col("geo_err") * F.col("geo_err")))


def fill_voids(df: DataFrame, keys: list[str], x: str = "bin_mid", y: str = "mean", err: str = "all_err", acceleration: float = ACCELERATION, leave_one_out: bool = False) -> DataFrame:
    """Bins without a mean take the line through the two nearest with one (on either side or the same).

    Adds lin_err, the error of the interpolation there. With one bin that has a mean, voids stay. With ``leave_one_out``
    bins that have a mean take the line through the two nearest others too.
    The two nearest are among the two before and the two after: windows, not a product of bins.
    """
    w = Window.partitionBy(*keys).orderBy(x)
    known = F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(err).alias("e")))
    held = lambda frame: F.collect_list(known).over(frame)
    before = F.slice(F.reverse(held(w.rowsBetween(Window.unboundedPreceding, -1))), 1, 2)
    after = F.slice(held(w.rowsBetween(1, Window.unboundedFollowing)), 1, 2)
    near = F.sort_array(F.transform(F.concat(before, after), lambda p: F.struct(F.abs(p["x"] - F.col(x)).alias("d"), p["x"].alias("x"), p["y"].alias("y"), p["e"].alias("e"))))
    df = df.withColumn("_near", near)
    p, q, at = F.get("_near", F.lit(0)), F.get("_near", F.lit(1)), F.col(x)
    a, b = (q["x"] - at) / (q["x"] - p["x"]), (at - p["x"]) / (q["x"] - p["x"])
    void = (F.lit(leave_one_out) | F.col(y).isNull()) & (F.size("_near") >= 2)
    return (
        df.withColumn("_y", F.when(void, a * p["y"] + b * q["y"]).otherwise(F.col(y)))
        .withColumn("_e", F.when(void, F.sqrt(a * a * p["e"] * p["e"] + b * b * q["e"] * q["e"])).otherwise(F.col(err)))
        .withColumn("lin_err", F.when(void, linear_err(p["d"], acceleration)))
        .drop("_near", y, err).withColumnRenamed("_y", y).withColumnRenamed("_e", err)
    )


def local_regression(df: DataFrame, keys: list[str], crange: float, x: str = "x", y: str = "y", err: str = "err", model: str = "Exc") -> DataFrame:
    """keys, x, smooth: at each x the line weighted by 1/err^2 and the kernel of the distance.

    The pairs of a group are its bins against each other (some tens).
    """
    a = df.select(*keys, F.col(x).alias("x0")).distinct()
    b = df.where(F.col(y).isNotNull()).select(*keys, F.col(x).alias("x1"), F.col(y).alias("y1"), (1 / (F.col(err) * F.col(err))).alias("w1"))
    p = a.join(b, keys).withColumn("w", F.col("w1") * kernel(F.col("x1"), F.col("x0"), crange / 4, model))
    d = F.col("x1") - F.col("x0")
    g = p.groupBy(*keys, "x0").agg(F.sum("w").alias("s"), F.sum(F.col("w") * d).alias("sx"), F.sum(F.col("w") * F.col("y1")).alias("sy"), F.sum(F.col("w") * d * d).alias("sxx"), F.sum(F.col("w") * d * F.col("y1")).alias("sxy"))
    det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    return g.select(*keys, F.col("x0").alias("x"), F.try_divide(F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy"), det).alias("smooth"))


def hypso_covariance(df: DataFrame, keys: list[str], crange: str = "crange", err: str = "err", slope: str = "slope", x: str = "bin_mid", area: str = "area", size=100.0, model: str = "Exp") -> DataFrame:
    """keys, err_total: error of the mean of bins whose errors correlate with the distance along the slope."""
    before = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_d", F.coalesce(F.sum(size / F.tan(F.radians(slope))).over(before), F.lit(0.0)))
    a = df.select(*keys, F.col("_d").alias("d1"), (F.col(err) * F.col(area)).alias("v1"), F.col(crange).alias("c"))
    b = df.select(*keys, F.col("_d").alias("d2"), (F.col(err) * F.col(area)).alias("v2"))
    var = a.join(b, keys).groupBy(*keys).agg(F.sum(kernel(F.col("d1"), F.col("d2"), F.col("c"), model) * F.col("v1") * F.col("v2")).alias("v"))
    total = df.groupBy(*keys).agg(F.sum(area).alias("a"))
    return var.join(total, keys).select(*keys, (F.sqrt("v") / F.col("a")).alias("err_total"))


def growth_variance(days, i: int):
    """Variance beyond RANGES[i] that has come in ``days`` days since an observation."""
    (r, o), (ra, oa) = GROWTH[i], GROWTH[-1]
    rb, ob = GROWTH[len(GROWTH) - 1 - FOLLOWS[i]]
    c = float(ONSET[i])
    grown = F.pow(ra * days + oa, F.lit(2.0)) - F.pow(r * days + o, F.lit(2.0)) - ((oa + c * ra) ** 2 - (ob + c * rb) ** 2)
    return F.when(days >= c, grown).otherwise(0.0)


def correlated_errors(df: DataFrame, keys: list[str], days: str = "days", err: str = "err", step: float = 5.0) -> DataFrame:
    """keys, sd_0 .. sd_5: standard errors by range, longest first, from the days since each pixel's observation.

    Days are binned by ``step``; in a bin the variance of a range is what shorter lags have not
    used, and the last takes what is left of the pixels' own. Means are of standard errors, by pixels.
    """
    b = df.withColumn("_b", F.floor(F.col(days) / step)).groupBy(*keys, "_b").agg(F.count("*").alias("_n"), F.avg(F.col(err) * F.col(err)).alias("_v"))
    mid = (F.col("_b") + 0.5) * step
    used = F.lit(0.0)
    for k in range(len(RANGES)):
        b = b.withColumn(f"_s{k}", F.greatest(growth_variance(mid, len(RANGES) - 1 - k) - used, F.lit(0.0)))
        used = used + F.col(f"_s{k}")
    b = b.withColumn(f"_s{len(RANGES)}", F.greatest(F.col("_v") - used, F.lit(0.0)))
    return b.groupBy(*keys).agg(*[F.sqrt(F.sum(F.sqrt(f"_s{k}") * F.col("_n")) / F.sum("_n")).alias(f"sd_{k}") for k in range(len(RANGES) + 1)])


def integrated_errors(df: DataFrame, area: str = "area_meas") -> DataFrame:
    """Adds err_corr_<range> for each range, and num_err, the error of the mean from all of them."""
    lengths = [LONGEST, *reversed(RANGES)]
    names = [200000, *[int(r) for r in reversed(RANGES)]]
    for k, (length, name) in enumerate(zip(lengths, names, strict=True)):
        sd = F.col(f"sd_{k}")
        df = df.withColumn(f"err_corr_{name}", F.when(sd > 0, std_err(sd, neff_circ(F.col(area), [(length, "Sph", sd * sd)]))).otherwise(0.0))
    lengths[0] = LONGEST_TOTAL
    models = [(length, "Sph", F.col(f"sd_{k}") * F.col(f"sd_{k}")) for k, length in enumerate(lengths)]
    total = F.sqrt(sum((m[2] for m in models[1:]), models[0][2]))
    return df.withColumn("num_err", F.when(total > 0, std_err(total, neff_circ(F.col(area), models))).otherwise(0.0))


def integrate(obs: DataFrame, keys: list[str], pixel_area: float, t: str = "t", size: float = 100.0, percent: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(series, bins) of features from dh, err, ref and days per pixel and date.

    series: keys, t, dh, err_dh, err_corr_*, perc_area_meas, perc_area_res, dt, std_dt. bins: keys, bin, bin_mid, t, mean, all_err, lin_err.
    Pixels whose error at the feature's last date passes 500 count as void. A feature that is void everywhere has its
    dates with null dh and errors. ``percent``: bins by a share of the range, see :func:`elevation_bins`.
    """
    obs = obs.join(obs.groupBy(*keys).agg(F.max(t).alias("_last")), keys)
    end = obs.where(F.col(t) == F.col("_last")).groupBy(*keys, "pixel").agg(F.max("err").alias("_end"))
    obs = obs.join(end, [*keys, "pixel"], "left")
    obs = cut(elevation_bins(obs, keys, size=size, percent=percent).withColumn("dh", F.when(F.col("_end") <= LARGEST_ERROR, F.col("dh"))))
    pixels = obs.groupBy(*keys, "bin", "bin_mid", "bin_size", "pixel").agg(F.max(F.col("dh").isNotNull().cast("int")).alias("_has"))
    areas = pixels.groupBy(*keys, "bin", "bin_mid", "bin_size").agg((F.count("*") * pixel_area).alias("area"), (F.sum("_has") * pixel_area).alias("area_res"))
    clean = cut(drop_outliers(obs.where("dh IS NOT NULL").withColumn("_final", F.col(t) == F.col("_last")), [*keys, "bin"], "_final"))
    seen = clean.select(*keys, "bin", "pixel").distinct().groupBy(*keys, "bin").agg((F.count("*") * pixel_area).alias("area_meas"))
    feature = areas.groupBy(*keys).agg(F.sum("area").alias("feature_area"))
    areas = areas.join(seen, [*keys, "bin"], "left").fillna(0.0, ["area_meas"]).join(feature, keys)
    means = bin_means(clean, [*keys, "bin", t])
    grid = areas.join(obs.select(*keys, t).distinct(), keys).join(means, [*keys, "bin", t], "left")
    sill = F.last("std", ignorenulls=True).over(Window.partitionBy(*keys, "bin").orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    bins = cut(fill_voids(cut(bin_errors(grid.withColumn("std", sill), F.col("bin_size"))), [*keys, t]))
    geo = bins.where("n IS NOT NULL").groupBy(*keys, "bin", "bin_mid", "bin_size").agg(F.max("geo_err").alias("err"), F.first("area").alias("area"), F.pow(F.lit(10.0), 2 + F.first("feature_area") / 1e6 / 2.5).alias("crange")).withColumn("slope", F.lit(DEFAULT_SLOPE))
    geo = hypso_covariance(geo, keys, size=F.col("bin_size")).withColumnRenamed("err_total", "geo_total")
    total = bins.groupBy(*keys, t).agg(F.try_divide(F.sum(F.col("mean") * F.col("area")), F.max("feature_area")).alias("dh"), F.sum("area_meas").alias("area_meas"), F.sum("area_res").alias("area_res"), F.max("feature_area").alias("area"))
    lag = correlated_errors(obs, [*keys, t])
    days = obs.groupBy(*keys, t).agg(F.avg("days").alias("dt"), F.stddev_pop("days").alias("std_dt"))
    out = integrated_errors(total.join(lag, [*keys, t])).join(geo, keys, "left").join(days, [*keys, t])
    err = F.sqrt(F.col("num_err") * F.col("num_err") + F.coalesce(F.col("geo_total") * F.col("geo_total"), F.lit(0.0)))
    series = out.withColumn("err_dh", F.when(F.col("dh").isNotNull(), err)).withColumn("perc_area_meas", F.col("area_meas") / F.col("area")).withColumn("perc_area_res", F.col("area_res") / F.col("area"))
    return series.drop(*[f"sd_{k}" for k in range(len(RANGES) + 1)], "num_err", "geo_total", "area_res"), bins.select(*keys, "bin", "bin_mid", t, "mean", "all_err", "lin_err", "area", "area_meas")
