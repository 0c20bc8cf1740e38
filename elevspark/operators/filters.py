"""Filters of observations: elevation range, time against a reference, space against a reference, quality, extent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import YEAR_FILTER
from .neighbourhood import disk_extremes, disk_percentiles
from .regression import ls

#: The range of believable heights, and the (radius in metres, margin) passes of the spatial filter.
LOWEST, HIGHEST = -400.0, 8900.0
SPATIAL_PASSES = ((200.0, 700.0), (500.0, 500.0), (2000.0, 300.0))


def elevation_range(df: DataFrame, z: str = "z", low: float = LOWEST, high: float = HIGHEST) -> DataFrame:
    return df.where(F.col(z).between(low, high))


def near_reference(df: DataFrame, z: str, ref: str, below: float = -400.0, above: float = 1000.0) -> DataFrame:
    """Keep below < z - ref < above."""
    d = F.col(z) - F.col(ref)
    return df.where((d > below) & (d < above))


def keeps_time(z: Column, ref: Column, days: Column, base: float = 100.0, rate: float | tuple[float, float] = 50.0) -> Column:
    """Whether a height is plausible ``days`` from the reference: within ``base`` and a growth with time.

    ``rate`` is symmetric, or (lowest, highest) change a year. At the reference date everything is kept.
    """
    dt, dh = -days / YEAR_FILTER, ref - z
    if not isinstance(rate, tuple):
        return F.abs(dh) <= base + F.abs(dt) * rate
    lo, hi = rate
    past = (dt < 0) & ((dh < -base + dt * hi) | (dh > base + dt * lo))
    future = (dt > 0) & ((dh > base + dt * hi) | (dh < -base + dt * lo))
    return ~(past | future)


def time_filter(df: DataFrame, ref: str, days: str, z: str = "z", base: float = 100.0, rate=50.0) -> DataFrame:
    return df.where(keeps_time(F.col(z), F.col(ref), F.col(days), base, rate))


def spatial_filter(df: DataFrame, ref: DataFrame, size: float = 500.0, margin: float = 20.0, res: float = 100.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Keep heights within ``margin`` of the extremes of the reference (px, py, ref_z) in a disk of ``size`` metres."""
    near = disk_extremes(ref, int(size // res), "ref_z", keys)
    return df.join(near, [*keys, "px", "py"]).where(F.col("z").between(F.col("disk_min") - margin, F.col("disk_max") + margin)).drop("disk_min", "disk_max")


def prefilter(df: DataFrame, ref: DataFrame, mode: str = "both", days: str = "days", res: float = 100.0, rate=50.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """The range filter, then ``min_max`` (space), ``time``, or ``both`` (three spatial passes, then time)."""
    out = elevation_range(df)
    if mode == "min_max":
        return spatial_filter(out, ref, res=res, keys=keys)
    if mode == "both":
        for size, margin in SPATIAL_PASSES:
            out = spatial_filter(out, ref, size, margin, res, keys)
    out = out.join(ref.select(*keys, "px", "py", F.col("ref_z").alias("_ref")), [*keys, "px", "py"])
    return time_filter(out, "_ref", days, rate=rate).drop("_ref")


def rmse_filter(df: DataFrame, dem: DataFrame, limit: float = 20.0) -> DataFrame:
    """Observations of rasters whose ``uncert`` is under ``limit``; a raster without one goes."""
    return df.join(dem.where(F.col("uncert") < limit), "dem", "left_semi")


def merge_duplicate_dates(df: DataFrame, keys: list[str], t: str = "day") -> DataFrame:
    """One observation a pixel and date: mean height, mean uncertainty."""
    return df.groupBy(*keys, t).agg(F.avg("z").alias("z"), F.avg("err").alias("err"), F.count("z").alias("n"))


def clip_to_mask(df: DataFrame, mask: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The observations on the pixels of ``mask``; empty dates vanish with their rows."""
    return df.join(mask, [*keys, "px", "py"], "left_semi")


def clip_to_extent(df: DataFrame, mask: DataFrame, t: str, start, end) -> DataFrame:
    """The observations in the mask's bounding box, from ``start`` to ``end`` inclusive."""
    box = mask.agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))
    inside = F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1"))
    return df.where(F.col(t).between(start, end)).join(F.broadcast(box), inside).drop("x0", "x1", "y0", "y1")  # one row


def wls_reference_filter(df: DataFrame, ref: DataFrame, days: str = "days", bounds: tuple[float, float] = (-50.0, 50.0), base: float = 100.0, radius: int = 10, delta: float = 2.0, conf: float = 0.99, keys: tuple[str, ...] = ()) -> DataFrame:
    """Keep heights that the trends nearby make plausible.

    A filtered weighted trend per pixel, clipped to ``bounds``, gives percentiles in a disk; the larger
    of their magnitudes, m, widens the range of the reference in the disk and bounds the change since the
    reference date. ``days`` are counted from that date.
    """
    place = [*keys, "px", "py"]
    trend = ls(df.withColumn("_w", 1 / (F.col("err") * F.col("err"))).withColumn("_year", F.col(days) / YEAR_FILTER), place, "_year", "z", "_w", conf_filter=conf)
    near = disk_percentiles(trend.where(F.col("slope").between(*bounds)).select(*place, "slope"), radius, (0.2, 0.8), "slope", keys)
    rate = near.select(*place, F.greatest(F.abs("p0"), F.abs("p1")).alias("_m"))
    span = disk_extremes(ref, radius, "ref_z", keys)
    out = df.join(rate, place).join(span, place).join(ref.select(*place, F.col("ref_z").alias("_ref")), place)
    wide = F.lit(base) + 30 * F.col("_m")
    kept = F.col("z").between(F.col("disk_min") - wide, F.col("disk_max") + wide)
    change = F.abs(F.col("_ref") - F.col("z")) <= F.lit(base) + delta * F.col("_m") + F.abs(F.col(days)) / YEAR_FILTER * 2 * F.col("_m")
    return out.where(kept & change).drop("_m", "_ref", "disk_min", "disk_max")
