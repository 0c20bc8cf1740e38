"""Operator 10: mix sources to target weights by capped water-filling.

Weights repeat over the sources in code-point order (null last). The budget is shared by weight; a
source whose share passes ``max_epochs`` times its size is clamped there and its excess is reshared
by weight until no share is above its cap. The fixed point is ``min(cap, level * weight)``; the
level is the largest of the levels at which the k sources with the least cap per weight are clamped,
so one ordered pass over the (few) sources finds it.

Each document of a source is repeated ``floor(target / size)`` times; the remaining fraction takes
the documents whose seeded digest comes first, up to the prefix of words nearest to the target. The
prefix is found by summing words in digest ranges first, so that no task orders a whole source.

Null text counts 0 words; null sources are one source, the last; a source without words has target
0; rows with equal id and size share a digest and are taken together; an empty table gives an empty
result. Columns of the input that clash with those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table, text_of, word_count

WEIGHTS, BUDGET, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"
DIGEST_RANGES = 3  # hexadecimal digits: 4096 ranges


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.lit(float(weights[-1]))
    for k, x in reversed(list(enumerate(weights[:-1]))):
        w = F.when((F.row_number().over(by_name) - 1) % len(weights) == k, F.lit(float(x))).otherwise(w)
    caps = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(max_epochs)).withColumn("ratio", F.col("cap") / F.col("w"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    levels = caps.withColumn("level", (F.sum("source_size").over(everything) * F.lit(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    return levels.withColumn("level", F.max("level").over(everything)).select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows with ``size`` (words of the whole text) and ``digest`` (the seeded order of documents)."""
    out = docs.withColumn("size", word_count(text_of()))
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string"))
    return out.withColumn("digest", F.md5(name.cast("binary")))


def plan(rows: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(plan_source, source_size, target, whole, cutoff) of rows (source, size, digest); one row per source.

    A document is repeated ``whole`` times, and once more if its digest is at most ``cutoff``.
    """
    part = F.substring("digest", 1, DIGEST_RANGES)
    ranges = staged(rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("part_size")), "mix-ranges")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, budget, max_epochs)
    targets = targets.withColumn("whole", F.floor(ratio)).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = staged(targets.withColumnRenamed("source", "plan_source"), "mix-targets")

    upto = F.sum("part_size").over(Window.partitionBy("source").orderBy("part"))
    edge = ranges.withColumn("upto", upto).withColumn("held", upto - F.col("part_size"))
    edge = edge.join(targets.select("plan_source", "need"), F.col("source").eqNullSafe(F.col("plan_source")))
    edge = edge.where((F.col("upto") > F.col("need")) & (F.col("held") <= F.col("need"))).select(F.col("plan_source").alias("s"), F.col("part").alias("edge"), "need", "held")

    inner = rows.select("source", "size", "digest", part.alias("part")).join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("edge")))
    inner = inner.groupBy("s", "digest", "need", "held").agg(F.sum("size").alias("size"))
    cum = inner.withColumn("cum", F.col("held") + F.sum("size").over(Window.partitionBy("s").orderBy("digest")))
    near = (F.col("cum") <= F.col("need")) | (F.col("cum") - F.col("need") < F.col("need") - F.col("cum") + F.col("size"))
    last = cum.where(near).groupBy("s").agg(F.max("digest").alias("last"))
    cutoffs = edge.select("s", "edge").join(last.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").select("s", F.coalesce("last", "edge").alias("cutoff"))
    return targets.join(cutoffs, F.col("plan_source").eqNullSafe(F.col("s")), "left").select("plan_source", "source_size", "target", "whole", "cutoff")


def repeats(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """The rows with source_size, target and ``repeats``, how often the mix takes each document."""
    out = rows.join(by_source, F.col("source").eqNullSafe(F.col("plan_source")), "left").drop("plan_source")
    more = F.coalesce(F.col("digest") <= F.col("cutoff"), F.lit(False)).cast("long")
    return out.withColumn("repeats", F.col("whole") + more).drop("whole", "cutoff")


def mix_sources(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents of the mix: each row of ``docs`` as often as it is taken, with its own columns."""
    names = docs.columns
    by_source = staged(plan(staged(sized(docs, seed).select("source", "size", "digest"), "mix-sizes"), weights, budget, max_epochs), "mix-plan")
    rows = repeats(sized(docs.select(F.struct(*names).alias("row"), "doc_id", "source", "text"), seed).drop("text"), by_source)
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("repeats").cast("int")))).select("row.*")


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    rows = staged(sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"), "mix-sizes")
    return repeats(rows, staged(plan(rows), "mix-plan")).select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), d AS (
  SELECT *, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || CAST(size AS VARCHAR)) AS digest FROM sized
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), named AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM src
), caps AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM named
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
     - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(w) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM caps
), targets AS (
  SELECT source, source_size, least(cap, max(lv) OVER () * w) AS target FROM levels
), need AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets
), grouped AS (
  SELECT source, digest, sum(size) AS g FROM d GROUP BY source, digest
), cum AS (
  SELECT source, digest, g, sum(g) OVER (PARTITION BY source ORDER BY digest) AS c FROM grouped
), cut AS (
  SELECT n.source, max(CASE WHEN c <= target - whole * source_size OR c - (target - whole * source_size) < (target - whole * source_size) - (c - g)
     THEN digest END) AS cutoff
  FROM need n LEFT JOIN cum c ON n.source IS NOT DISTINCT FROM c.source GROUP BY n.source
)
SELECT d.doc_id, d.size, n.source_size, n.target,
  CAST((n.whole + CASE WHEN d.digest <= cut.cutoff THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN need n ON d.source IS NOT DISTINCT FROM n.source JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""
