"""Operator 1 [native]: quality rules with risk-controlled cutoffs.

Each rule rejects a document whose metric exceeds a cutoff from a fixed grid. Labelled documents
(``labels.quality``) that pass the base rules are the holdout. In each stratum (the language, one
stratum for null) a cutoff is admissible if the exact binomial tail P(Bin(n, risk) <= k), with k of
n good documents rejected, is at most ``delta`` divided by the number of sequences (rules x strata).
The cutoffs of a rule are tested from the largest down, a sequence fixed beforehand, until one fails;
k can only grow on the way, so those that pass alone are those before the first that fails. With
probability 1 - delta no admitted cutoff rejects more than ``risk`` of the good documents of its
stratum. Of the admissible cutoffs the one is taken that rejects most bad documents net of good ones,
the largest such; a rule without an admissible or useful cutoff is off.

Defined results: null and empty texts have 0 in every count and fail the base rules; strata without
labels have no rules beyond the base; repeated rows each give a row; an empty table gives an empty
result; other columns of the inputs are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import label_rows, staged, table, text_of, word_list

RISK, DELTA = 0.01, 0.05
#: metric -> the cutoffs that are tried: powers of two of a base, so that the grid does not depend on the data.
GRIDS = {"symbols_per_word": (0.05, 6), "dup_line_share": (0.1, 4), "repeat_share": (0.05, 4), "capital_share": (0.1, 4), "bangs_per_word": (0.05, 5)}
METRICS = tuple(GRIDS)
BASE_MIN_WORDS, BASE_MAX_REPEAT = 50, 50


def cutoffs(rule: str) -> list[float]:
    base, n = GRIDS[rule]
    return [base * 2**k for k in range(n)]


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    A text whose windows differ in their 64-bit digests has no repeat. In others windows are sorted by
    digest, words and place: equal neighbours are repeats, and the places of the repeats in order cover
    min(3, gap to the next) words each.
    """
    last = F.size(words) - 3
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(ordered: Column) -> Column:
        n = F.size(ordered)
        alike = lambda x, y: (x["h"] == y["h"]) & (x["w"] == y["w"])
        twice = F.filter(ordered, lambda x, i: ((i > 0) & alike(F.get(ordered, i - 1), x)) | ((i < n - 1) & alike(F.get(ordered, i + 1), x)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return _let(places, lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda acc, k: acc + F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(3)))))

    def of(hashes: Column) -> Column:
        same = F.size(F.array_distinct(hashes)) == F.size(hashes)
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("w"), i.alias("i"))))
        return F.when(same, F.lit(0)).otherwise(_let(pairs, covered))

    return F.when(last < 0, F.lit(0)).otherwise(_let(windows, of)).cast("long")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def metrics(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, base counts, base_failed, the metric of each rule) for every row."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), text_of().alias("text"))
    rows = rows.withColumn("words", word_list(text))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != "")
    rows = rows.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace(text, r"[^!]+", "")).cast("long").alias("n_bangs"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    return rows.select(
        "doc_id",
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("lines.dup").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("lines.dup") / F.greatest(F.col("lines.n"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))).alias("capital_share"),
        (F.col("n_bangs") / n).alias("bangs_per_word"),
    )


def _log_gamma(x: Column) -> Column:
    """Stirling's series after ten steps of the recurrence; 13 digits or more for x >= 1."""
    shift = sum((F.log(x + k) for k in range(1, 10)), F.log(x))
    z = x + 10
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), 1 where k >= n p (no evidence there).

    The terms from k downwards shrink at least as fast as a normal tail: those beyond 40 standard
    deviations add less than double precision shows, so the work grows with the root of n.
    """
    x, m = k.cast("double"), n.cast("double")
    top = F.exp(_log_gamma(m + 1) - _log_gamma(x + 1) - _log_gamma(m - x + 1) + x * math.log(p) + (m - x) * math.log1p(-p))
    steps = F.least(k, F.ceil(40 * F.sqrt(m * p * (1 - p)) + 40).cast("long"))
    walk = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.greatest(steps, F.lit(0)) - 1),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, j: F.struct(
            (acc["term"] * (x - j) * (1 - p) / ((m - x + j + 1) * p)).alias("term"),
            (acc["total"] + acc["term"] * (x - j) * (1 - p) / ((m - x + j + 1) * p)).alias("total"),
        ),
    )["total"]
    return F.when(x >= m * p, F.lit(1.0)).otherwise(top * F.when(steps > 0, walk).otherwise(F.lit(1.0)))


def chosen_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(s, one column of cutoffs per rule, null where the rule is off), one row per labelled stratum."""
    held = measured.where(~F.col("base_failed")).join(label_rows(labels, "quality").withColumnRenamed("doc_id", "labelled"), F.col("doc_id") == F.col("labelled"))
    counts = [F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")]
    for rule in METRICS:
        for i, c in enumerate(cutoffs(rule)):
            over = F.when(F.col(rule) > c, F.col("y"))
            counts += [F.coalesce(F.sum(over), F.lit(0)).alias(f"{rule}_{i}_good"), F.coalesce(F.sum(1 - over), F.lit(0)).alias(f"{rule}_{i}_bad")]
    wide = staged(held.groupBy("stratum").agg(*counts), "rule-counts")
    tests = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{rule}_{i}_good").alias("k"), F.col(f"{rule}_{i}_bad").alias("hit")) for rule in METRICS for i, c in enumerate(cutoffs(rule))]))
    wide = wide.withColumn("strata", F.count("*").over(Window.partitionBy()))  # before the tests multiply the rows
    long = wide.select("stratum", "good", "strata", tests.alias("t")).select("stratum", "good", "strata", "t.*")
    sequences = F.col("strata") * len(GRIDS)
    long = long.where((F.col("good") > 0) & (F.col("hit") > F.col("k")) & (binomial_tail(F.col("k"), F.col("good"), risk) <= F.lit(delta) / sequences))
    best = long.groupBy("stratum", "rule").agg(F.max(F.struct((F.col("hit") - F.col("k")).alias("net"), "cutoff"))["cutoff"].alias("cutoff"))
    return best.groupBy(F.col("stratum").alias("s")).agg(*[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"max_{rule}") for rule in METRICS])


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """A row per document: doc_id, the base counts, base_failed, kept."""
    measured = staged(metrics(docs), "rule-metrics")
    limits = staged(chosen_cutoffs(measured, labels, risk, delta), "rule-cutoffs")
    rows = measured.join(limits, F.col("stratum") == F.col("s"), "left")
    rejected = F.lit(False)
    for rule in METRICS:
        rejected = rejected | F.coalesce(F.col(rule) > F.col(f"max_{rule}"), F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _oracle() -> str:
    grid = ", ".join(f"('{rule}', {c!r}::DOUBLE)" for rule in METRICS for c in cutoffs(rule))
    chosen = " OR ".join(f"coalesce(m.{rule} > (SELECT cutoff FROM best b WHERE b.stratum = m.stratum AND b.rule = '{rule}'), false)" for rule in METRICS)
    value = "CASE g.rule " + " ".join(f"WHEN '{rule}' THEN m.{rule}" for rule in METRICS) + " END"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid
), ln AS (
  SELECT rid, [s FOR s IN string_split(text, chr(10)) IF regexp_matches(s, '[^\x20\x09-\x0D]')] AS x FROM d
), counts AS (
  SELECT d.rid, doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(x) - len(list_distinct(x)) AS BIGINT) AS n_dup_lines, CAST(len(x) AS BIGINT) AS n_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(length(regexp_replace(text, '[^!]+', '', 'g')) AS BIGINT) AS n_bangs
  FROM d JOIN ln USING (rid) LEFT JOIN covered USING (rid)
), m AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    n_symbols::DOUBLE / greatest(n_words, 1) AS symbols_per_word, n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_line_share,
    n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_share, n_capitals::DOUBLE / greatest(word_chars, 1) AS capital_share,
    n_bangs::DOUBLE / greatest(n_words, 1) AS bangs_per_word FROM counts
), lab AS (
  SELECT doc_id, max(quality) AS y FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
), grid(rule, cutoff) AS (VALUES {grid}
), t AS (
  SELECT m.stratum, g.rule, g.cutoff, sum(y) AS good, sum(CASE WHEN {value} > g.cutoff THEN y ELSE 0 END) AS k,
    sum(CASE WHEN {value} > g.cutoff THEN 1 - y ELSE 0 END) AS hit
  FROM m JOIN lab ON m.doc_id = lab.doc_id CROSS JOIN grid g WHERE NOT base_failed GROUP BY ALL
), tail AS (
  SELECT *, (SELECT count(DISTINCT stratum) FROM t) AS strata,
    CASE WHEN k >= good * {RISK!r}::DOUBLE THEN 1.0 ELSE list_sum([exp(lgamma(good + 1) - lgamma(j + 1) - lgamma(good - j + 1) + j * ln({RISK!r}::DOUBLE) + (good - j) * ln({1 - RISK!r}::DOUBLE))
      FOR j IN range(0, CAST(k AS BIGINT) + 1)]) END AS p FROM t WHERE good > 0
), best AS (
  SELECT stratum, rule, max({{'net': hit - k, 'cutoff': cutoff}}).cutoff AS cutoff FROM tail
  WHERE hit > k AND p <= {DELTA!r}::DOUBLE / (strata * {len(GRIDS)}) GROUP BY stratum, rule
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({chosen}) AS kept FROM m
"""


OP1_SQL = _oracle()
