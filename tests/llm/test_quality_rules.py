import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from elevspark.llm import mixing, quality_rules as q
from elevspark.llm.queries import QUERIES, SQL


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + o for i, w in enumerate(wins) if wins.count(w) > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed)


def texts():
    rng = random.Random(0)
    out = [None, "", " \t\n\x0b\f\r", "one", "a a a", "a a a a", "a b c a b c", "a b c d a b c", "x|y <z> ##\n\nx\n x\nx\n", "é\x1cé ü ü\n ", "a\r\nb\r\na\r\n", "w " * 60, "𝒜𝒷 ** 日本"]
    for _ in range(30):
        out.append("".join(rng.choice(["a", "b", "c", "dd", "É!"]) + rng.choice([" ", "  ", "\n", "\t", "\x0b"]) for _ in range(rng.randint(0, 120))))
    return out


def test_counts_match_brute_force(spark):
    data = [(i, t, None if i % 5 == 0 else "en", 7) for i, t in enumerate(texts())] + [(None, "a b", "x", 7), (1, None, "en", 7)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = q.quality_rules(df, labels).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=str)
    assert got == sorted(((i, *brute(t)) for i, t, _, _ in data), key=str)
    assert all(r.kept == (not r.base_failed) for r in rows)  # too few labels to admit a cutoff
    assert q.quality_rules(df.where("false"), labels).count() == 0
    assert q.quality_rules(df, labels.where("false")).count() == len(data)


def test_no_python_on_the_executors(spark):
    plan = q.quality_rules(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("p", [0.01, 0.3])
def test_binomial_tail_is_exact(spark, p):
    cases = [(0, 1), (0, 50), (3, 700), (10, 40), (40, 40), (5, 5), (80, 10000), (20000, 2_500_000)]
    rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", q.binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect()
    for r in rows:
        if r.k >= r.n * p:
            assert r.t == 1.0
            continue
        logs = [math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(p) + (r.n - j) * math.log1p(-p) for j in range(r.k + 1)]
        assert r.t == pytest.approx(sum(map(math.exp, logs)), rel=1e-6, abs=1e-300)


def test_cutoffs_reject_junk_within_the_risk(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(3000):
        bad = i % 3 == 0
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 10**6)) + ("***" if bad else "") for _ in range(60)]
        docs.append((i, " ".join(words) + (" #" if rng.random() < 0.004 and not bad else ""), rng.choice(["en", None])))
        labels.append((i, int(not bad), 0))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in q.quality_rules(df, lab).collect()}
    assert not any(kept[i] for i in range(0, 3000, 3)) and sum(not kept[i] for i in range(3000) if i % 3) <= 0.01 * 2000


def test_cutoffs_match_a_binomial_search(spark):
    """One rejected document decides: of 900 good ones a cutoff may reject 1, not 2; 600 bear none rejected, 500 nothing."""
    rng = random.Random(3)
    rows, labels = [], []
    for stratum, good, far in (("a", 900, 1), ("b", 900, 2), ("c", 600, 0), ("d", 500, 0)):
        for i in range(good + 200):
            v = dict.fromkeys(q.METRICS, 0.0)
            if i >= good:
                v["symbols_per_word"], v["bangs_per_word"], v["dup_line_share"] = rng.choice([0.07, 0.15, 0.3, 2.0]), rng.choice([0.0, 0.15, 0.5]), rng.choice([0.0, 0.9])
            elif i < far:
                v["symbols_per_word"], v["bangs_per_word"] = 0.15, 0.9
            elif i < 40:
                v["symbols_per_word"], v["capital_share"] = 0.06, 0.5
            rows.append((len(rows), stratum, False, *v.values()))
            labels.append((len(labels), int(i < good)))
    measured = spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean, " + ", ".join(f"{m} double" for m in q.METRICS))
    got = {r.s: r.asDict() for r in q.chosen_cutoffs(measured, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}

    def tail(k, n):
        return sum(math.comb(n, j) * q.RISK**j * (1 - q.RISK) ** (n - j) for j in range(k + 1))

    y = dict(labels)
    for stratum in "abcd":
        mine = [r for r in rows if r[1] == stratum]
        n = sum(y[r[0]] for r in mine)
        for at, rule in enumerate(q.METRICS):
            best = None
            for c in reversed(q.cutoffs(rule)):  # from the largest down, until one fails
                k = sum(y[r[0]] for r in mine if r[3 + at] > c)
                hit = sum(1 - y[r[0]] for r in mine if r[3 + at] > c)
                if tail(k, n) > q.DELTA / (4 * len(q.METRICS)):
                    break
                if hit > k and (best is None or hit - k > best[0]):
                    best = (hit - k, c)
            assert got.get(stratum, {}).get(f"max_{rule}") == (best and best[1]), (stratum, rule)
    assert got["a"]["max_symbols_per_word"] == 0.1 and got["b"]["max_symbols_per_word"] == 0.2 and got["a"]["max_bangs_per_word"] == 0.1
    assert "max_symbols_per_word" in got["c"] and "d" not in got


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    ours, want = QUERIES[name](spark, d).toPandas(), con.sql(SQL[name]).df()
    cols = sorted(ours.columns)
    key = lambda x: sorted(tuple(r) for r in x[cols].itertuples(index=False))
    assert cols == sorted(want.columns) and key(ours) == key(want)
    assert mixing.BUDGET == 1.5
