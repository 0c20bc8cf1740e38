import itertools

import numpy as np
import pytest

from elevspark.llm import toxicity
from elevspark.llm.toxicity import features_of, label_model, learn, linear, posterior, score_toxicity, words_of


def test_features():
    assert words_of("Ab, cd1ef!") == {"ab", "cd", "ef"} and words_of(None) == set()
    assert features_of({"stupid"}) == {"stupid", "4stup", "5stupi", "6stupid"}


def test_label_model_recovers_labels_and_shares_correlated_evidence():
    rng = np.random.default_rng(1)
    y = (rng.random(3000) < 0.2).astype(int)
    fire = lambda a, b: (rng.random(3000) < np.where(y == 1, a, b)).astype(float)
    one = fire(0.6, 0.02)
    votes = np.stack([fire(0.7, 0.01), fire(0.7, 0.02), fire(0.5, 0.5), one, one, one], axis=1)
    p, model = label_model(votes)
    assert ((p > 0.5) == y).mean() > 0.93
    assert model["share"][3:].max() < 0.5 < model["share"][:3].min()
    assert abs(model["rates"][1][0] - 0.7) < 0.07


def test_posterior_is_that_of_enumeration():
    rng = np.random.default_rng(4)
    rates, prior = [rng.uniform(0.05, 0.4, 4), rng.uniform(0.5, 0.9, 4)], 0.3
    for row in itertools.product((0, 1), repeat=4):
        joint = [w * np.prod([r if v else 1 - r for v, r in zip(row, rates[c], strict=True)]) for c, w in ((0, 1 - prior), (1, prior))]
        assert posterior(np.array([row], float), prior, rates, np.ones(4))[0] == pytest.approx(joint[1] / sum(joint))


def test_estimates_are_a_fixed_point_of_enumerated_expectations():
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.3
    votes = np.stack([rng.random(4000) < np.where(y, a, b) for a, b in ((0.8, 0.05), (0.7, 0.1), (0.6, 0.02))], 1).astype(float)
    known = np.where(rng.random(4000) < 0.3, y, -1)
    p, model = label_model(votes, known, 2000)
    q1 = np.where(known >= 0, known, p)
    again = [((q[:, None] * votes).sum(0) + 0.5 * votes.mean(0) + 0.01) / (q.sum() + 0.52) for q in (1 - q1, q1)]
    assert np.allclose(again, model["rates"], atol=1e-3) and q1.mean() == pytest.approx(model["prior"], abs=1e-3)
    assert len({round(x, 9) for x in p}) <= 8  # a posterior is that of the votes, whatever the row's own label
    assert np.allclose(model["rates"][1], votes[y].mean(0), atol=0.08) and np.allclose(model["rates"][0], votes[~y].mean(0), atol=0.05)


def test_the_label_model_decides_and_not_single_labels(spark):
    rng = np.random.default_rng(6)
    insults, fillers = ["moron", "idiot", "pathetic", "worthless", "scum", "loser"], [f"word{i}" for i in range(400)]
    text = lambda bad: " ".join([*rng.choice(fillers, 40), *(rng.choice(insults, 3) if bad else [])])
    bad = rng.random(900) < 0.25
    df = spark.createDataFrame([(i, text(b)) for i, b in enumerate(bad)], "doc_id long, text string")
    flipped = np.where(rng.random(900) < 0.1, ~bad, bad)
    scores = []
    for y in (bad, flipped):
        labels = spark.createDataFrame([(i, int(y[i])) for i in range(500)], "doc_id long, y int")
        scores.append(np.array([r.score for r in score_toxicity(df, learn(df, labels)).orderBy("doc_id").collect()]))
    for s in scores:
        assert ((s > 0.5) == bad).mean() > 0.98
    assert np.abs(scores[0] - scores[1]).mean() < 0.1


def test_linear_fits_and_survives_empty_rows():
    rows = [np.array([0, 1]), np.array([1]), np.array([], int), np.array([0])] * 20
    w, b = linear(rows, np.array([1.0, 0.0, 0.0, 1.0] * 20), 2)
    assert w[0] > 3 and b < 0


def test_scores_of_odd_rows(spark):
    rows = [(i, ("you stupid moron " if i % 3 == 0 else "a fine day ") + f"w{i % 7} " * 20, "x") for i in range(90)]
    df = spark.createDataFrame([*rows, (None, None, "x"), (200, "", "x"), (200, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, y int")
    out = score_toxicity(df, learn(df, labels))
    got = {r.doc_id: r.score for r in out.collect()}
    assert out.count() == 93 and got[87] > 0.7 and got[88] < 0.3 and 0 <= got[200] == got[None] < 0.7
    none = score_toxicity(df, learn(df, labels.where("y = 0")))
    assert {round(r.score, 6) for r in none.collect()} == {0.0}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = toxicity.op7_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.toxic == r.predicted for r in rows) >= 0.95 * len(rows)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.01 * len(rows)
