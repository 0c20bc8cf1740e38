"""Fitted cubes against independent heights: altimetry tracks, other rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import tile_name
from .timejoin import interpolate

LOWEST_POINT = -200.0


def tile_of_points(points: DataFrame) -> DataFrame:
    """Points above -200 m with their tile; a point on an edge belongs to the tile below and to the left of it."""
    return points.where(F.col("elev") > LOWEST_POINT).withColumn("tile", tile_name(F.ceil("lat") - 1, F.ceil("lon") - 1))


def compare_points(points: DataFrame, cube: DataFrame, res: float, t: str = "t") -> DataFrame:
    """points (id, t, x, y, h) with z, z_ci of the cube (px, py, t) bilinear in space and linear in time, dh and z_score.

    Only points with all four series around them at their time are returned.
    """
    gx, gy = F.col("x") / res, F.col("y") / res
    fx, fy = gx - F.floor(gx), gy - F.floor(gy)
    corners = [(0, 0, (1 - fx) * (1 - fy)), (1, 0, fx * (1 - fy)), (0, 1, (1 - fx) * fy), (1, 1, fx * fy)]
    four = F.explode(F.array(*[F.struct((F.floor(gx) + i).cast("int").alias("px"), (F.floor(gy) + j).cast("int").alias("py"), w.alias("w")) for i, j, w in corners]))
    wanted = points.select("id", t, four.alias("c")).select("id", t, "c.*").where("w > 0")
    at = interpolate(wanted.select("px", "py", t, "id", "w"), cube.select("px", "py", t, "z", "z_ci"), ["px", "py"], t, ["z", "z_ci"])
    g = at.groupBy("id").agg(F.sum(F.col("z") * F.col("w")).alias("z"), F.sum(F.col("z_ci") * F.col("w")).alias("z_ci"), F.count("z").alias("_k"), F.count("*").alias("_n"))
    out = points.join(g.where("_k = _n"), "id").drop("_k", "_n").withColumn("dh", F.col("h") - F.col("z"))
    return out.withColumn("z_score", F.try_divide("dh", "z_ci"))


def compare_raster(raster: DataFrame, cube: DataFrame, stable: DataFrame, at: float, keys: list[str], t: str = "t") -> DataFrame:
    """keys, dh, z_score of another raster against the cube at ``at`` on the pixels of ``stable``."""
    one = raster.join(stable, keys, "left_semi").withColumn(t, F.lit(at).cast(cube.schema[t].dataType)).select(*keys, t, F.col("z").alias("h"))
    j = interpolate(one, cube.select(*keys, t, "z", "z_ci"), keys, t, ["z", "z_ci"])
    return j.where("z IS NOT NULL").select(*keys, (F.col("h") - F.col("z")).alias("dh"), F.try_divide(F.col("h") - F.col("z"), F.col("z_ci")).alias("z_score"))
