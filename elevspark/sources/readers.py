"""Reading and writing: stacks, tables, statistics files, scene metadata, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import scene_date
from .schemas import FILL, FILL_CORR, SCHEMAS

STATS_ORDER = ("re-coreg", "coreg", "")
SPECTRAL_BANDS = ("1", "2", "3N", "3B", "4", "5", "6", "7", "8", "9", "10", "11", "12", "13", "14")


def read_table(spark: SparkSession, name: str, *paths: str, fmt: str = "parquet") -> DataFrame:
    """Tables of a known schema, from one or several paths; CSV with a header."""
    reader = spark.read.schema(SCHEMAS[name])
    return reader.option("header", True).csv(list(paths)) if fmt == "csv" else reader.parquet(*paths)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    """Stacks and fits are partitioned by ``tile`` and sorted by place, so that reads prune files and row groups."""
    order = [c for c in ("py", "px", "t") if c in df.columns]
    if partition_by and order:
        df = df.repartition(*partition_by).sortWithinPartitions(*partition_by, *order)
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def without_fill(df: DataFrame) -> DataFrame:
    """Fill values and NaN become null: predicates and aggregates then behave."""
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            df = df.withColumn(name, F.when(~F.isnan(name) & (F.col(name) != FILL), F.col(name)))
    return df.withColumn("corr", F.when(F.col("corr") != FILL_CORR, F.col("corr"))) if "corr" in df.columns else df


def build_stack(cells: DataFrame, dem: DataFrame, ref: DataFrame | None = None, below: float = -400.0, above: float = 1000.0, default_uncert: float = 5.0) -> DataFrame:
    """Cells (dem_id, px, py, z) of dated rasters as one stack, in order of date, with each raster's uncertainty.

    With ``ref`` (px, py, ref_z) cells far from it go. Rasters without a cell left vanish.
    """
    out = without_fill(cells).where("z IS NOT NULL").join(dem.withColumn("uncert", F.coalesce("uncert", F.lit(default_uncert))), "dem_id")
    if ref is not None:
        d = F.col("z") - F.col("ref_z")
        out = out.join(ref.select("px", "py", "ref_z"), ["px", "py"]).where((d > below) & (d < above)).drop("ref_z")
    return out


def dated(names: DataFrame, name: str = "dem_id") -> DataFrame:
    """File names with their date; those without a known one are last."""
    return names.withColumn("t", scene_date(F.col(name))).orderBy(F.col("t").asc_nulls_last(), name)


def stats_of(lines: Column) -> Column:
    """The map of a statistics file's lines: names in the first (a bracketed list), values in the last."""
    names = F.transform(F.split(F.regexp_replace(F.get(lines, F.lit(0)), r"[\[\]'\" ]", ""), ","), lambda x: F.trim(x))
    values = F.transform(F.split(F.regexp_replace(F.element_at(lines, -1), r"[\[\]]", ""), ","), lambda x: F.trim(x).try_cast("double"))
    n = F.least(F.size(names), F.size(values))
    return F.map_from_arrays(F.slice(names, 1, n), F.slice(values, 1, n))


def read_stats(spark: SparkSession, root: str) -> DataFrame:
    """(dem_id, stats): for each folder under ``root`` the first statistics file there is, by place."""
    text = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="stats.txt").select("value", F.col("_metadata.file_path").alias("path"))
    part = F.regexp_extract("path", r"/([^/]+)/(?:(re-coreg|coreg)/)?stats\.txt$", 1)
    place = F.regexp_extract("path", r"/(?:(re-coreg|coreg)/)?stats\.txt$", 1)
    rank = F.array_position(F.array(*[F.lit(p) for p in STATS_ORDER]), place)
    lines = F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n")
    best = text.select(part.alias("dem_id"), F.struct(rank.alias("rank"), lines.alias("lines")).alias("s")).groupBy("dem_id").agg(F.min("s").alias("s"))
    return best.select("dem_id", stats_of(F.col("s.lines")).alias("stats"))


def odl_value(text: Column, name: str) -> Column:
    """The quoted value after the object ``name`` in a metadata text."""
    return F.regexp_extract(text, rf"(?s)OBJECT\s*=\s*{name}\b.*?VALUE\s*=\s*\"([^\"]*)\"", 1)


def odl_numbers(text: Column, name: str) -> Column:
    """The numbers in brackets after the object ``name``."""
    inside = F.regexp_extract(text, rf"(?s)OBJECT\s*=\s*{name}\b.*?VALUE\s*=\s*\(([^)]*)\)", 1)
    return F.transform(F.split(inside, ","), lambda x: F.trim(x).try_cast("double"))


def scene_metadata(text: Column) -> Column:
    """struct(lats, lons, date, time, cloud, bands, angle) of a scene's metadata text."""
    cloud = F.regexp_extract(text, r"(?s)OBJECT\s*=\s*SCENECLOUDCOVERAGE\b.*?VALUE\s*=\s*([-0-9.]+)", 1).try_cast("double")
    bands = F.array_compact(F.array(*[F.when(odl_value(text, f"IMAGEDATAINFORMATION{b}") != "", F.lit(b)) for b in SPECTRAL_BANDS]))
    return F.struct(
        odl_numbers(text, "GRINGPOINTLATITUDE").alias("lats"), odl_numbers(text, "GRINGPOINTLONGITUDE").alias("lons"), odl_value(text, "CALENDARDATE").alias("date"), odl_value(text, "TIMEOFDAY").alias("time"),
        cloud.alias("cloud"), bands.alias("bands"), F.lit(15.0).alias("angle"),
    )


def strip_polygon(granules: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rings: a strip's granule rings (not dissolved), those over the date line split in two at it."""
    lons = F.transform("ring", lambda p: p["x"])
    crosses = (F.array_min(lons) < -160) & (F.array_max(lons) > 160)
    east = F.transform("ring", lambda p: F.struct(F.when(p["x"] < 0, F.lit(180.0)).otherwise(p["x"]).alias("x"), p["y"].alias("y")))
    west = F.transform("ring", lambda p: F.struct(F.when(p["x"] > 0, F.lit(-180.0)).otherwise(p["x"]).alias("x"), p["y"].alias("y")))
    rings = F.when(crosses, F.array(east, west)).otherwise(F.array(F.col("ring")))
    return granules.select(*keys, F.explode(rings).alias("ring")).groupBy(*keys).agg(F.collect_list("ring").alias("rings"))


def inventory(features: DataFrame) -> DataFrame:
    """The base table of outlines: ids that begin with G are of region 12 and have no flags."""
    g = F.col("rgiid").startswith("G")
    return features.select("rgiid", *[F.when(g, F.lit(0)).otherwise(F.col(c)).alias(c) for c in ("cl", "nom", "term")], F.when(g, F.lit(12)).otherwise(F.col("reg")).alias("reg"), "area", "lon", "lat")
