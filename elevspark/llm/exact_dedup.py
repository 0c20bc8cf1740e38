"""Operator 2: exact deduplication by deterministic block naming.

A text without its white space is cut into blocks of ``block_chars`` code points. The distinct
blocks are sorted, by a 64-bit digest and then the block itself, and numbered: a block's name is its place
in that order, on any number of partitions. Then names of adjacent
pairs are sorted and numbered in the same way, level by level, until one name is left; the number of
levels and that name identify the text without collisions. Only texts with more than one block take
part in the levels, so the work shrinks with each.

Blocks travel once, after a map-side distinct, so a text with many copies costs one block a task.
Occurrences are mapped to names by a 64-bit digest of the block; digests that stand for more than
one block (found by counting, not assumed away) are mapped by the block itself.

Of equal texts the row with the most code points in the original text stays, then the smallest
doc_id (null last), then the first in an arbitrary but fixed order of the rows. Null texts count as
empty, and all texts of white space alone are equal. Rows may repeat; each gives a row. Empty tables
give empty results. Other columns are carried by :func:`exact_dedup`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, kept_rows, staged, text_of

BLOCK_CHARS = 4096


def squeezed(text: Column) -> Column:
    """The text without the six white-space characters."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def blocks_of(text: Column, block_chars: int) -> Column:
    """The blocks in order; one empty block for an empty text."""
    n = F.greatest(F.ceil(F.length(text) / block_chars).cast("int"), F.lit(1))
    return F.when(n == 1, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * block_chars + 1, F.lit(block_chars))))


def _numbered(keys: DataFrame, by: list[str], name: str, label: str) -> DataFrame:
    """Distinct keys with an integer name: their place in sorted order, however the rows are partitioned.

    Ranges of keys are sorted by task; the sizes of the ranges before it give a task's first name.
    """
    ranges = staged(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), label)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranges.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a range
    first = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranges.withColumn("_part", part).join(F.broadcast(sizes.select("_part", first.alias("_first"))), "_part").withColumn(name, F.col("_first") + place).drop("_part", "_first", "_at")


def block_names(texts: DataFrame, digest: Callable[[Column], Column], block_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """((h, name) of the digests of one block, (h, block, name) of those of more or None) for a table (t).

    Blocks sort by (digest, block). Only digests travel again for it; the blocks of a digest that stands for several are
    sorted by themselves and follow the name of their digest.
    """
    blocks = texts.select(F.explode(blocks_of(F.col("t"), block_chars)).alias("block")).withColumn("h", digest(F.col("block")))
    distinct = staged(blocks.groupBy("h", "block").agg(F.lit(1).alias("one")).select("h"), "block-digests")
    named = staged(_numbered(distinct, ["h"], "name", "block-order"), "block-names")
    twice = staged(named.groupBy("h").agg(F.count("*").alias("n"), F.min("name").alias("base")).where("n > 1").select("h", "base"), "block-clashes")
    if twice.isEmpty():
        return named, None
    clashing = blocks.join(twice, "h", "left_semi").distinct()
    place = _numbered(clashing, ["h", "block"], "place", "clash-order")
    start = place.groupBy("h").agg(F.min("place").alias("start"))
    told = place.join(start, "h").join(twice, "h").select("h", "block", (F.col("base") + F.col("place") - F.col("start")).alias("name"))
    return named.join(twice, "h", "left_anti"), staged(told, "block-clash-names")


def _level(seq: DataFrame, level: int) -> DataFrame:
    """Names (rid, pos, name) of the next level: pairs of adjacent names, sorted and numbered."""
    half = F.floor(F.col("pos") / 2).alias("pos")
    side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
    pairs = staged(seq.groupBy("rid", half).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b")), f"pairs-{level}")
    names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], "name", f"order-{level}")
    return staged(pairs.join(names, ["a", "b"]).select("rid", "pos", "name"), f"level-{level}")


def identities(rows: DataFrame, block_chars: int = BLOCK_CHARS, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(rid, doc_id, n_points, text_sha256, level, name): equal (level, name) means equal squeezed text."""
    base = rows.select("doc_id", text_of().alias("text")).select("doc_id", F.length("text").cast("long").alias("n_points"), squeezed(F.col("text")).alias("t"))
    found = base.select("doc_id", "n_points", F.sha2(F.encode("t", "UTF-8"), 256).alias("text_sha256"), F.transform(blocks_of(F.col("t"), block_chars), lambda b: digest(b)).alias("hs"))
    found = staged(found.withColumn("rid", F.monotonically_increasing_id()), "texts")
    names, clashes = block_names(base.select("t"), digest, block_chars)

    singles = found.where(F.size("hs") == 1).select("rid", F.lit(0).alias("pos"), F.col("hs")[0].alias("h"))
    longer = found.where(F.size("hs") > 1).select("rid", F.posexplode("hs").alias("pos", "h"))
    level = 0
    if clashes is None:
        ends = [singles.join(names, "h").select("rid", F.lit(0).alias("level"), "name")]
        seq = staged(longer.join(names, "h").select("rid", "pos", "name"), "level-0")
    else:
        seq = staged(_with_clashes(rows, names, clashes, digest, block_chars, found), "level-0")
        alone = seq.groupBy("rid").agg(F.max("pos").alias("m")).where("m = 0").select("rid")
        ends = [seq.join(alone, "rid", "left_semi").select("rid", F.lit(0).alias("level"), "name")]
        seq = seq.join(alone, "rid", "left_anti")
    while not seq.isEmpty():
        level += 1
        seq = _level(seq, level)
        many = seq.where("pos > 0").select("rid").distinct()
        ends.append(seq.join(many, "rid", "left_anti").select("rid", F.lit(level).alias("level"), "name"))
        seq = staged(seq.join(many, "rid", "left_semi"), f"left-{level}")
    ids = ends[0]
    for e in ends[1:]:
        ids = ids.unionByName(e)
    return found.drop("hs").join(ids, "rid")


def _with_clashes(rows: DataFrame, names: DataFrame, clashes: DataFrame, digest, block_chars: int, found: DataFrame) -> DataFrame:
    """(rid, pos, name) where some digests stand for several blocks: those occurrences join by the block.

    A row's digests are those of the staged rows, found again by (doc_id, sha256, code points): rows
    alike in these have equal squeezed texts, so any of them gives the right blocks.
    """
    occ = found.select("rid", F.posexplode("hs").alias("pos", "h"))
    plain = occ.join(names, "h").select("rid", "pos", "name")
    bad = clashes.select("h").distinct()
    texts = rows.select(squeezed(text_of()).alias("t")).select(F.sha2(F.encode("t", "UTF-8"), 256).alias("text_sha256"), F.posexplode(blocks_of(F.col("t"), block_chars)).alias("pos", "block"))
    texts = texts.withColumn("h", digest(F.col("block"))).join(bad, "h", "left_semi").join(clashes, ["h", "block"]).select("text_sha256", "pos", "name").distinct()
    where = found.select("rid", "text_sha256", F.posexplode("hs").alias("pos", "h")).join(bad, "h", "left_semi")
    return plain.unionByName(where.join(texts, ["text_sha256", "pos"]).select("rid", "pos", "name"))


def groups(ids: DataFrame) -> DataFrame:
    """``ids`` with keep_id, keep_rid and group_size. Copies are combined before they travel."""
    rank = F.struct(F.col("n_points"), F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("neg"), (-F.col("rid")).alias("r"))
    kept = ids.groupBy("level", "name").agg(F.max(rank).alias("best"), F.count("*").alias("group_size"))
    kept = kept.select("level", "name", (-F.col("best.neg")).alias("keep_id"), (-F.col("best.r")).alias("keep_rid"), "group_size")
    # Written first: a join beside the grouping it rests on could not split the rows of a large group.
    return ids.join(staged(kept, "kept"), ["level", "name"])


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The rows that stay, with their own columns.

    A row is found again by its id and digest of the squeezed text; of rows alike in both and in
    length one stays.
    """
    out = groups(identities(docs, block_chars, digest))
    stay = staged(out.where(F.col("rid") == F.col("keep_rid")).select("doc_id", "text_sha256", "n_points"), "stay")
    sha = F.sha2(F.encode(squeezed(text_of()), "UTF-8"), 256)
    return kept_rows(docs, {"doc_id": F.col("doc_id"), "text_sha256": sha, "n_points": F.length(text_of()).cast("long")}, stay)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = groups(identities(docs))
    return out.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
    row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY t) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""
