"""Operator 9: a quality classifier on random-indexing word vectors.

Every whitespace-separated word gives tokens: its letters in lower case, the run of other characters
around it, and marks of its shape (capitals, digits, the same word again, a line seen before). Tokens
are hashed into ``BUCKETS``. Each bucket has a sparse random index vector; a bucket's context vector
is the sum of the index vectors of its neighbours within ``WINDOW`` tokens. A token's vector is its
index vector beside its context vector, both of length one. A document is the mean of its token
vectors with its length and its share of distinct tokens, the input of a network with one hidden
layer whose probabilities are calibrated by a temperature on documents it was not trained on.

Context vectors and network are fitted on at most ``SAMPLE`` labelled documents from the folds that
may be learned from. Context sums are made on the executors, in at most ``PARTS`` pieces of fixed
size.

Null and empty texts are documents without tokens and get the network's answer to zeros. Without
labels, or with one class only, every score is the share of label 1 (0 without labels). Repeated
rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, label_rows, lean, sliced, staged, table

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
SAMPLE, PARTS, SEED = 12000, 16, 31
BUCKETS, DIMS, NONZERO, WINDOW = 1 << 14, 40, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-4
#: Words that a worker remembers the tokens of.
REMEMBERED = 100_000

_PART = re.compile(r"[^\W\d_]+|\d+|[\W_]+")
#: Buckets of the shape marks.
CAPITALS, TITLE, SAME, AGAIN, LINE, DIGITS = range(6)


def _bucket(token: str) -> int:
    return 6 + zlib.crc32(token.encode("utf-8", "surrogatepass")) % (BUCKETS - 6)


def word_tokens(word: str) -> bytes:
    """The buckets of a word, as little-endian 32-bit numbers."""
    out = []
    for part in _PART.findall(word):
        if part.isalpha():
            out.append(_bucket(part.lower()))
            if len(part) > 1 and part.isupper():
                out.append(CAPITALS)
            elif part[0].isupper():
                out.append(TITLE)
        else:
            out.append(DIGITS if part.isdigit() else _bucket(part[:3]))
    return np.array(out, "<i4").tobytes()


class Tokens:
    """Tokens of whole texts, with a bounded memory of words."""

    def __init__(self):
        self.known: dict[str, bytes] = {}
        self.marks = {m: np.array([m], "<i4").tobytes() for m in (SAME, AGAIN, LINE)}

    def of(self, text: str | None) -> np.ndarray:
        known, out, seen = self.known, [], set()
        if len(known) > REMEMBERED:
            known.clear()
        for line in (text or "").split("\n"):
            words = line.split()
            if not words:
                continue
            if line in seen:
                out.append(self.marks[AGAIN] * len(words))
            seen.add(line)
            out.append(self.marks[LINE])
            new = set(words).difference(known)
            known.update((w, word_tokens(w)) for w in new)
            out += map(known.__getitem__, words)
            same = sum(map(str.__eq__, words, words[1:]))
            if same:
                out.append(self.marks[SAME] * same)
        return np.frombuffer(b"".join(out), "<i4")


def index_vectors(buckets: int = BUCKETS, dims: int = DIMS) -> np.ndarray:
    """A few entries of plus and minus one in each row, seeded."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((buckets, dims), np.float32)
    place = rng.random((buckets, dims)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    np.put_along_axis(out, place, rng.choice(np.array([-1, 1], np.float32), (buckets, NONZERO)), axis=1)
    return out


def add_contexts(total: np.ndarray, ids: np.ndarray, index: np.ndarray, chunk: int = 1 << 16) -> None:
    """Add to ``total`` the index vectors of each token's neighbours in one document."""
    for gap in range(1, WINDOW + 1):
        for at, near in ((ids[:-gap], ids[gap:]), (ids[gap:], ids[:-gap])):
            for i in range(0, len(at), chunk):
                a, b = at[i : i + chunk], near[i : i + chunk]
                order = np.argsort(a, kind="stable")
                first = np.flatnonzero(np.diff(a[order], prepend=-1))
                total[a[order][first]] += np.add.reduceat(index[b[order]], first, axis=0)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the sums over a partition, as bytes."""
    tokens, index, total = Tokens(), index_vectors(), np.zeros((BUCKETS, DIMS), np.float64)
    for batch in sliced(batches):
        for text in batch.column("text").to_pylist():
            add_contexts(total, tokens.of(text), index)
    yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary())], ["sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the sum of all rows. Entries are whole numbers, so their order is immaterial."""
    total = np.zeros(BUCKETS * DIMS, np.float64)
    for batch in batches:
        for sums in batch.column("sums"):
            total += np.frombuffer(sums.as_buffer(), "<f4")
    yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary())], ["sums"])


def token_vectors(sums: np.ndarray, index: np.ndarray) -> np.ndarray:
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return np.concatenate([unit(index), unit(sums)], axis=1).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The document's vector; zeros for one without tokens."""
    out = np.zeros(vectors.shape[1] + 8, np.float32)
    n = len(ids)
    if n:
        total = np.zeros(vectors.shape[1], np.float64)
        for i in range(0, n, 1 << 16):
            total += vectors[ids[i : i + (1 << 16)]].sum(0)
        out[: vectors.shape[1]] = 4 * total / n
        out[-8] = np.log1p(n) / 10
        out[-7] = len(np.unique(ids)) / n
        out[-6:] = np.bincount(ids[ids < 6], minlength=6) / n
    return out


def _pool(sent, keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, vectors = Tokens(), sent.value
        for batch in sliced(batches):
            rows = [pooled(tokens.of(t), vectors).astype("<f4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(rows, pa.binary())], [keep, "x"])

    return run


class Network:
    """Inputs (standardised), tanh units, one logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        n, d = x.shape
        p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))]
        z, m, v, t = (x - self.mean) / self.scale, [0.0] * 4, [0.0] * 4, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(n)
            rate = RATE * (1 - epoch / EPOCHS) + 1e-5
            for i in range(0, n, BATCH):
                b = order[i : i + BATCH]
                h = np.tanh(z[b] @ p[0] + p[1])
                err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[b]) / len(b)
                back = np.outer(err, p[2]) * (1 - h * h)
                grads = [z[b].T @ back + DECAY * p[0], back.sum(0), h.T @ err + DECAY * p[2], err.sum()]
                t += 1
                for k, g in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature under which the labels are likeliest."""
        z = self.logit(x)
        loss = lambda t: np.logaddexp(0, np.where(y > 0, -z, z) / t).mean()
        grid = np.geomspace(0.25, 8, 121)
        self.temperature = float(grid[np.argmin([loss(t) for t in grid])])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """{"vectors", "network"} or, without two classes, {"share"}; from labelled rows of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    chosen = staged(bounded_sample(labels, sample, SEED).withColumnRenamed("doc_id", "chosen"), "chosen")  # at most ``sample`` rows
    rows = staged(docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).select("doc_id", "y", "text"), "sample")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return {"share": counts.get(1, 0) / max(sum(counts.values()), 1)}
    sums = np.zeros((BUCKETS, DIMS))
    parts = staged(rows.select("text").repartition(PARTS).mapInArrow(lean(_contexts), "sums binary"), "context-sums")
    for r in parts.coalesce(1).mapInArrow(lean(_added), "sums binary").collect():  # one row of BUCKETS x DIMS numbers
        sums = np.frombuffer(bytes(r["sums"]), "<f4").reshape(BUCKETS, DIMS)
    vectors = token_vectors(sums, index_vectors())
    sent = spark.sparkContext.broadcast(vectors)
    data = rows.select("y", "text").mapInArrow(lean(_pool(sent, "y")), "y int, x binary")
    data = data.toPandas().sort_values(["x", "y"])  # at most ``sample`` rows, in an order that does not depend on the tasks
    x, y = np.stack([np.frombuffer(b, "<f4") for b in data["x"]]).astype(float), data["y"].to_numpy(float)
    order = np.random.default_rng(SEED).permutation(len(y))
    x, y = x[order], y[order]
    held = np.arange(len(y)) % 5 == 0
    net = Network(x[~held], y[~held])
    if len(set(y[held])) == 2:
        net.calibrate(x[held], y[held])
    return {"vectors": vectors, "network": net}


def _scores(model: dict, tokens: Tokens, texts: list) -> np.ndarray:
    if "share" in model or not texts:
        return np.full(len(texts), model.get("share", 0.0))
    return model["network"].score(np.stack([pooled(tokens.of(t), model["vectors"]) for t in texts]).astype(float))


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(sent.value, tokens, batch.column("text").to_pylist()), pa.float64())], ["doc_id", "quality_score"])

    return run


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and quality_score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(lean(_score(sent)), f"doc_id {dict(docs.dtypes)['doc_id']}, quality_score double")


def keep_good(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches ``threshold``, with all their columns; all rows if there were no two classes to learn from."""
    if "share" in model:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = Tokens()
        for batch in batches:
            parts = sliced(iter([pa.RecordBatch.from_arrays([batch], ["text"])]))
            yield pa.array(np.concatenate([_scores(sent.value, tokens, part.column("text").to_pylist()) for part in parts] or [np.zeros(0)]), pa.float64())

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:  # only the text travels to Python
        yield from lean(run)(texts)

    return docs.where(scored(F.col("text")) >= threshold)


def fitted(docs: DataFrame, labels: DataFrame) -> dict:
    """The model learned from the folds that may be learned from."""
    return learn(docs.select("doc_id", "text"), label_rows(labels.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT), "quality"))


def op9_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, fitted(docs, table(spark, sf_dir, "labels")))
    held = (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    return out.select("doc_id", held, F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
