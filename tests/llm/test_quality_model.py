import numpy as np

from elevspark.llm import quality_model as q


def test_tokens_mark_shape_repetition_and_lines():
    t = q.Tokens()
    assert t.of("") is not None and len(t.of(None)) == 0
    plain, shout = t.of("the word"), t.of("THE word")
    assert set(shout) - set(plain) == {q.CAPITALS}
    assert list(t.of("the the the")).count(q.SAME) == 2
    assert list(t.of("a b\nc\na b")).count(q.AGAIN) == 2
    assert set(t.of("this***")) >= {q._bucket("this"), q._bucket("***")}


def test_contexts_match_a_plain_sum():
    index, ids = q.index_vectors(50, 8), np.random.default_rng(0).integers(0, 50, 200)
    total, want = np.zeros((50, 8)), np.zeros((50, 8))
    q.add_contexts(total, ids, index, chunk=17)
    for i in range(200):
        for j in range(max(0, i - q.WINDOW), min(200, i + q.WINDOW + 1)):
            if i != j:
                want[ids[i]] += index[ids[j]]
    assert np.allclose(total, want) and (np.count_nonzero(index, axis=1) == q.NONZERO).all()


def test_network_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(2000) < 0.1)).astype(float)
    net = q.Network(x[:1500], y[:1500])
    before = np.logaddexp(0, np.where(y[1500:] > 0, -1, 1) * net.logit(x[1500:])).mean()
    net.calibrate(x[1500:], y[1500:])
    p = net.score(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.8
    assert -np.log(np.where(y[1500:] > 0, p, 1 - p) + 1e-12).mean() <= before + 1e-9


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (2, "", 0.0), (None, "a b", 0.0)], "doc_id long, text string, quality_score double")
    empty = spark.createDataFrame([], "doc_id long, y int")
    rows = q.score_quality(df, q.learn(df, empty)).collect()
    assert [r.quality_score for r in rows] == [0.0] * 4
    one = spark.createDataFrame([(2, 1)], "doc_id long, y int")
    assert {r.quality_score for r in q.score_quality(df, q.learn(df, one)).collect()} == {1.0}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = q.op9_quality_model(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
