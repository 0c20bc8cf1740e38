"""Running trends over a stream of observations: mergeable sums, so any batch order gives the same line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_trend(stream: DataFrame, keys: list[str], ts: str, x: str, y: str, w: str, watermark: str = "30 days", window: str | None = None) -> DataFrame:
    """keys (and window), n, slope, intercept of the weighted line so far.

    ``stream`` may be a batch or a streaming DataFrame; with ``window`` late rows within the watermark
    still count and older state is dropped.
    """
    if dict(stream.dtypes)[ts] == "timestamp_ntz":  # watermarks need an instant
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if window:
        stream = stream.withWatermark(ts, watermark).withColumn("window", F.window(ts, window))
        keys = [*keys, "window"]
    c = {k: F.col(k) for k in (x, y, w)}
    g = stream.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(w).alias("_w"), F.sum(c[w] * c[x]).alias("_x"), F.sum(c[w] * c[y]).alias("_y"), F.sum(c[w] * c[x] * c[x]).alias("_xx"), F.sum(c[w] * c[x] * c[y]).alias("_xy")
    )
    slope = F.try_divide(F.col("_w") * F.col("_xy") - F.col("_x") * F.col("_y"), F.col("_w") * F.col("_xx") - F.col("_x") * F.col("_x"))
    return g.withColumn("slope", slope).withColumn("intercept", (F.col("_y") - F.col("slope") * F.col("_x")) / F.col("_w")).drop("_w", "_x", "_y", "_xx", "_xy")
