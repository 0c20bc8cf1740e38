import random

import numpy as np

import corpus_pipeline as p
from elevspark.llm import quality_model
from elevspark.llm.mixing import mix_sources, source_targets
from elevspark.llm.simhash import near_dedup

D = "/root/testdata/sf0.01"


def prose(rng, n):
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.choice(['', 'er', 'ing', 'al'])}" + rng.choice(["", "", "", "s", "on"]) for _ in range(n)]


def edited(rng, words, share):
    return [rng.choice("xyz") + w if rng.random() < share else w for w in words]


def jaccard(a, b):
    s = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(5)
    rows = []
    for g in range(60):
        base = prose(rng, rng.randint(60, 700))
        rows.append((1000 + 10 * g, " ".join(base), g, "en"))
        for c in range(1, 4 if g < 30 else 1):
            copy = base
            while copy == base or jaccard(base, copy) < 0.85:
                copy = edited(rng, base, 0.015)
            rows.append((1000 + 10 * g + c, " ".join(copy), g, "en"))
    rows += [(None, "two words", -1, None), (None, "two words", -1, None), (5, None, -2, None), (6, "", -2, None)]
    shared = " ".join(prose(rng, 60))  # a passage that many documents share does not make them copies
    rows += [(5000 + i, shared + " " + " ".join(prose(rng, 300)), 100 + i, "de") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, lang string")
    kept = near_dedup(df).collect()
    by = {}
    for r in kept:
        by.setdefault(r.row, []).append(r.doc_id)
    assert {g: ids for g, ids in by.items() if 0 <= g < 60} == {g: [1000 + 10 * g] for g in range(60)}
    assert by[-1] == [None] and by[-2] == [5] and sum(g >= 100 for g in by) == 20
    assert near_dedup(df.where("false")).count() == 0


def test_mix_takes_whole_rows_near_the_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice(["a", "b", "c", None, "é"]), i) for i in range(800)] + [(900, None, "empty", 1), (901, " ", "empty", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row long")
    mixed = mix_sources(df)
    assert mixed.columns == df.columns
    size = lambda t: len((t or "").split())
    total, taken, times = {}, {}, {}
    for r in rows:
        total[r[2]] = total.get(r[2], 0) + size(r[1])
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    lo, hi = 0.0, 1e9
    for _ in range(200):  # the level of the water
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(2 * total[s], level * weight[s]) for s in order) < 1.5 * sum(total.values()) else (lo, level)
    for s in order:
        assert abs(taken.get(s, 0) - min(2 * total[s], level * weight[s])) <= 60
    assert max(times.values()) <= 2
    sizes = spark.createDataFrame([(s, n) for s, n in total.items()], "source string, source_size long")
    assert abs(sum(r.target for r in source_targets(sizes).collect()) - 1.5 * sum(total.values())) < 1e-6
    assert mix_sources(df.where("false")).count() == 0


def test_quality_stage_keeps_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = p.quality(spark, docs, D)
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{D}/labels.parquet")
    share = {r.quality: r.n for r in kept.join(labels, "doc_id").groupBy("quality").agg({"doc_id": "count"}).withColumnRenamed("count(doc_id)", "n").collect()}
    every = {r.quality: r.n for r in docs.join(labels, "doc_id").groupBy("quality").agg({"doc_id": "count"}).withColumnRenamed("count(doc_id)", "n").collect()}
    assert share[1] >= 0.98 * every[1] and share.get(0, 0) <= 0.1 * every[0]
    assert quality_model.THRESHOLD == 0.7


def test_run_packs_what_the_stages_keep(spark):
    rows = p.run(spark, D).collect()
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        assert sorted(pieces)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(pieces), sorted(pieces)[1:], strict=False))
        assert sum(n for _, n in pieces) <= 4096
    assert len(seqs) <= np.ceil(sum(r.length for r in rows) / 4096) * 1.02 + 1
    assert [name for name, _ in p.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "pack"] and p.ORACLE_SQL is None


def at_similarity(rng, low, high):
    """Two texts whose sets of five-word shingles have a similarity in [low, high)."""
    while True:
        base = prose(rng, rng.randint(40, 400))
        copy = edited(rng, base, rng.uniform(0.01, 0.08))
        if low <= jaccard(base, copy) < high:
            return " ".join(base), " ".join(copy)


def test_near_dedup_decides_by_the_exact_similarity(spark):
    rng = random.Random(9)
    close, apart = [at_similarity(rng, 0.8, 0.85) for _ in range(150)], [at_similarity(rng, 0.7, 0.8) for _ in range(150)]
    rows = [(1000 + 2 * g + c, t) for g, pair in enumerate(close + apart) for c, t in enumerate(pair)]
    short = [prose(rng, 8) for _ in range(40)]  # three of five shingles alike
    rows += [(5000 + 2 * g + c, " ".join(w)) for g, base in enumerate(short) for c, w in enumerate((base, [*base[:-1], "other"]))]
    passage = prose(rng, 60)  # repeats do not count
    rows += [(9000, " ".join(passage)), (9001, " ".join(passage * 30 + passage[:4]))]
    ids = {r.doc_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {1000 + 2 * g for g in range(150)} | set(range(1300, 1600)) | set(range(5000, 5080)) | {9000}
    assert jaccard(passage, passage * 30 + passage[:4]) >= 0.8
    assert ids == want


def test_near_dedup_of_a_large_group_is_that_of_all_pairs(spark):
    rng = random.Random(3)
    base = prose(rng, 200)
    texts = [edited(rng, base, rng.uniform(0.005, 0.06)) for _ in range(150)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in near_dedup(df).collect()} == set(root) and 1 < len(set(root)) < 150
