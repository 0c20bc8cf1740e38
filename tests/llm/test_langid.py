import itertools

import numpy as np
import pytest

from elevspark.llm import langid
from elevspark.llm.langid import Words, identify, learn, viterbi


def test_words_and_offsets():
    w = Words(["Ab c1dé", "", "2", "x"])
    assert w.doc.tolist() == [0, 0, 0, 3] and w.start.tolist() == [0, 3, 5, 0] and w.size.tolist() == [2, 1, 2, 1]
    assert Words(["AB"]).feature.tolist() == Words(["ab"]).feature.tolist()
    one, two = Words(["ab", "cd"]), Words(["ab cd"])
    assert one.feature.tolist() == two.feature.tolist()


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_matches_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(0, 7, 12)
    n = n[n > 0]
    first = np.cumsum(n) - n
    scores = rng.normal(size=(n.sum(), 3)).astype(np.float32)
    got = viterbi(scores, first, n, 0.9)
    value = lambda s, path: sum(s[i, x] for i, x in enumerate(path)) - 0.9 * sum(a != b for a, b in itertools.pairwise(path))
    for f, k in zip(first, n, strict=True):
        s = scores[f : f + k]
        best = max(value(s, p) for p in itertools.product(range(3), repeat=int(k)))
        assert value(s, got[f : f + k]) == pytest.approx(best, abs=1e-5)


EN = "the quick brown fox jumps over the lazy dog and then they went with that thing through another weather "
DE = "der schnelle braune Fuchs springt über den faulen Hund und dann ging sie nicht durch das schöne Wetter zurück "
RU = "быстрая коричневая лиса прыгает через ленивую собаку и потом они ушли "


def test_mixed_text_spans(spark, monkeypatch):
    rows = [(i, t * 3, lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 8)]
    model = learn(spark.createDataFrame([*rows, (None, EN, "xx"), (99, EN, None)], "doc_id long, text string, lang string"))
    assert model["langs"] == ["de", "en", "ru"]
    test = [(1, EN + "1, 2. " + DE + RU), (2, None), (3, " 12 !"), (4, "лиса"), (5, "日本"), (6, EN), (6, EN), (None, DE)]
    df = spark.createDataFrame([(*t, "z") for t in test], "doc_id long, text string, score string")
    monkeypatch.setattr(langid, "TOGETHER", 5)
    got = {r.doc_id: r for r in identify(df, model).collect()}
    assert [s["lang"] for s in got[1].lang_spans] == ["en", "de", "ru"]
    assert test[0][1][got[1].lang_spans[1]["start"] : got[1].lang_spans[1]["end"]] == DE.strip()
    assert got[2].lang_pred == got[3].lang_pred == "und" and got[2].score == 0
    assert got[4].lang_pred == "ru" and got[5].lang_pred in model["langs"] and got[6].lang_pred == "en" and got[None].lang_pred == "de" and got[6].score == 1
    assert identify(df, model).count() == len(test)
    assert {r.lang_pred for r in identify(df, learn(df.selectExpr("doc_id", "text", "cast(null as string) lang"))).collect()} == {"und"}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = langid.op3_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
