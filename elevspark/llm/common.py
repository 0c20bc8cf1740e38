"""What the operators of this folder share: white space, staging tables, document columns."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, as a set of characters and as a regular expression.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "path" not in _own_folder:
        _own_folder["path"] = tempfile.mkdtemp(prefix="staged-")
        atexit.register(shutil.rmtree, _own_folder["path"], ignore_errors=True)
    return "file://" + _own_folder["path"]


def staged_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, lost executors cost nothing."""
    path = staged_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col), F.lit(""))


def word_list(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; an empty array where there is none."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def word_count(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")


def fold(doc_id: Column, parts: int) -> Column:
    """``crc32(doc_id as text) mod parts``: the deterministic fold of a document; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)), F.lit(0)).cast("int")


def sliced(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20, col: str = "text") -> Iterator[pa.RecordBatch]:
    """Record batches cut so that one holds at most about ``max_bytes`` of text, or one row."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(col)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow; what a partition held goes back to the system at its end, for workers idle beside others."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def label_rows(labels: DataFrame, what: str) -> DataFrame:
    """(doc_id, y): one row per document that has a label; of contradicting rows the larger label counts."""
    return labels.where(F.col(what).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(what).cast("int")).alias("y"))


def bounded_sample(rows: DataFrame, bound: int, seed: int) -> DataFrame:
    """At most ``bound`` rows (doc_id, y), the first by a hash of the id: a top-k over two narrow columns."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(bound)


def kept_rows(docs: DataFrame, keys: dict[str, Column], stay: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are in ``stay`` (columns of the same names), each key once.

    Rows alike in all keys are interchangeable: one of them stays. They are rare (an id that occurs
    twice), so they are counted first and only they are grouped.
    """
    names = docs.columns
    on = [f"key_{i}" for i in range(len(keys))]
    rows = docs.select(F.struct(*names).alias("row"), *[c.alias(k) for k, c in zip(on, keys.values(), strict=True)])
    stay = stay.select(*[F.col(n).alias(k) for k, n in zip(on, keys, strict=True)])
    alike = staged(rows.groupBy(*on).agg(F.count("*").alias("times")).where("times > 1").select(*[F.col(k).alias("a" + k) for k in on]), "alike")
    if not alike.isEmpty():
        twice = _null_safe(rows, alike, on, "a")
        one = rows.join(alike, twice, "left_semi").groupBy(*on).agg(F.first("row").alias("row")).select("row", *on)
        rows = rows.join(alike, twice, "left_anti").unionByName(one)
    stay = stay.select(*[F.col(k).alias("s" + k) for k in on])
    return rows.join(stay, _null_safe(rows, stay, on, "s"), "left_semi").select("row.*")


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for k in on:
        out = out & left[k].eqNullSafe(right[prefix + k])
    return out
