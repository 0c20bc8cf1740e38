"""Operator 3: language of a text and of its spans.

Words are runs of letters. The script of a word, told by the range its first letter lies in, narrows
the candidates to the languages that were seen in that script. A word's score for a language is the
log-probability of its letter trigrams (edges included). Viterbi over the words of the whole text,
with a penalty for each switch, gives every word a language; runs of one language are the spans, and
the language with the most letters is the text's. ``score`` is its share of the letters.

Trigram counts are learned from at most ``SAMPLE`` whole documents that have a label, chosen by a
hash of the id, from the folds that may be learned from; they are summed on the cluster and only
the ``BUCKETS`` sums a language reach the driver. A word in a script that no language was seen in
takes any of them.

Null texts and texts without letters get ``und`` with score 0; with nothing to learn from every text
does. Ties go to the language first in order. Repeated rows each give a row; other columns are
ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, lean, sliced, table

FOLDS, HELD_OUT = 4, 2
SAMPLE, BUCKETS, SWITCH, SEED = 6000, 1 << 15, 8.0, 11
#: Letters in one script by fewer than this share do not make it a script of the language.
SCRIPT_SHARE = 0.01
#: Bytes of scores and choices, by words and languages, whose labels are found together; a longer text is alone.
TOGETHER = 64 << 20

#: First code points of script ranges; each lasts to the next.
SCRIPTS = {
    0x0000: "latin", 0x0370: "greek", 0x0400: "cyrillic", 0x0530: "armenian", 0x0590: "hebrew", 0x0600: "arabic", 0x0900: "devanagari",
    0x0980: "bengali", 0x0A00: "indic", 0x0E00: "thai", 0x0E80: "lao", 0x0F00: "tibetan", 0x1000: "burmese", 0x10A0: "georgian",
    0x1100: "hangul", 0x1200: "other", 0x1E00: "latin", 0x1F00: "greek", 0x2000: "other", 0x2C60: "latin", 0x2C80: "other",
    0x3040: "kana", 0x3100: "han", 0xA000: "other", 0xA720: "latin", 0xA800: "other", 0xAC00: "hangul", 0xD800: "other", 0xF900: "han",
    0xFB00: "latin", 0xFB1D: "hebrew", 0xFB50: "arabic", 0xFE00: "other", 0xFF21: "latin", 0xFF66: "kana", 0x10000: "other", 0x20000: "han",
}
SCRIPT_NAMES = sorted(set(SCRIPTS.values()))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(letter?, lower case) of every code point. A lower case of several letters leaves the letter as it is."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        if len(s := chr(c).lower()) == 1:
            lower[c] = ord(s)
    return letter, lower


class Words:
    """The words of several texts: features per letter, and where words and texts begin."""

    def __init__(self, texts: list[str]):
        letter, lower = _tables()
        self.lengths = np.array([len(t) for t in texts])
        edges = np.concatenate([[0], np.cumsum(self.lengths)])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letter[codes]
        self.at = np.flatnonzero(is_letter)  # of each letter, its place
        doc = np.searchsorted(edges, self.at, "right") - 1
        begin = np.ones(len(self.at), bool)
        begin[1:] = (np.diff(self.at) > 1) | (np.diff(doc) > 0)
        low = lower[codes[self.at]].astype(np.uint64)
        before, after = np.where(begin, 0, np.roll(low, 1)), np.where(np.roll(begin, -1), 0, np.roll(low, -1))
        mixed = (before.astype(np.uint64) * np.uint64(0x9E3779B1) + low * np.uint64(0x85EBCA77) + after.astype(np.uint64) * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
        self.feature = (((mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x2C1B3C6D) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - 15)).astype(np.int64)
        self.begin = np.flatnonzero(begin)  # of each word, its first letter
        self.size = np.diff(np.append(self.begin, len(self.at)))
        self.doc = doc[self.begin] if len(self.begin) else np.zeros(0, int)
        self.start = (self.at[self.begin] - edges[self.doc]).astype(np.int64)  # in its text
        firsts = np.array(list(SCRIPTS))
        place = np.searchsorted(firsts, codes[self.at[self.begin]], "right") - 1
        self.script = np.array([SCRIPT_NAMES.index(s) for s in SCRIPTS.values()])[place]


def _count(langs: list[str]):
    """Rows (lang, key, n): counts of features, and of letters by script at keys from BUCKETS on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)), np.int64)
        index = {x: i for i, x in enumerate(langs)}
        for batch in sliced(batches, 4 << 20):
            words = Words([t or "" for t in batch.column("text").to_pylist()])
            lang = np.array([index[x] for x in batch.column("y").to_pylist()])[words.doc]
            np.add.at(total, (np.repeat(lang, words.size), words.feature), 1)
            np.add.at(total, (lang, BUCKETS + words.script), words.size)
        i, key = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([langs[x] for x in i], pa.string()), pa.array(key, pa.int64()), pa.array(total[i, key], pa.int64())], ["y", "key", "n"])

    return run


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model from rows (doc_id, text, lang) of a documented bound; None if none has a label."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    chosen = labelled.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample)
    chosen = F.broadcast(chosen.withColumnRenamed("doc_id", "chosen"))  # at most ``sample`` ids
    rows = labelled.join(chosen, F.col("doc_id") == F.col("chosen"), "left_semi").select(F.col("lang").alias("y"), "text")
    langs = sorted(r["y"] for r in rows.select("y").distinct().collect())
    if not langs:
        return None
    sums = rows.mapInArrow(lean(_count(langs)), "y string, key long, n long").groupBy("y", "key").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)))
    for r in sums:
        counts[langs.index(r["y"]), r["key"]] = r["n"]
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    weights = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)
    seen = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
    allowed = seen.T & (scripts.T > 0)
    allowed[~allowed.any(1)] = True
    return {"langs": langs, "weights": weights, "allowed": allowed}


def word_scores(words: Words, model: dict) -> np.ndarray:
    """(words, languages); languages outside the candidates of a word's script are far below."""
    out = np.empty((len(words.begin), len(model["langs"])), np.float32)
    for i, w in enumerate(model["weights"]):
        out[:, i] = np.add.reduceat(w[words.feature], words.begin) if len(words.begin) else 0
    out[~model["allowed"][words.script]] -= 1e4
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, n: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; text d has the words first[d]..first[d] + n[d]. All texts step at once, the longest longest."""
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    live = len(n) - np.searchsorted(n[::-1], np.arange(1, (n[0] if len(n) else 0) + 1), "left")  # texts with more than t words
    stays, best = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    value = np.zeros((len(n), scores.shape[1]), np.float32)
    for t, k in enumerate(live.tolist()):
        at, v = first[:k] + t, value[:k]
        top = v.argmax(1)
        out = (v[np.arange(k), top] - (penalty if t else 0))[:, None]
        stays[at], best[at] = v >= out, top
        value[:k] = np.maximum(v, out) + scores[at]
        if t % 256 == 255:
            value[:k] -= value[:k].max(1, keepdims=True)
    label, state = np.zeros(len(scores), np.int16), value.argmax(1) if len(n) else np.zeros(0, int)
    for t in range(len(live) - 1, -1, -1):
        k = live[t]
        at, now = first[:k] + t, state[:k]
        label[at] = now
        state[:k] = np.where(stays[at, now], now, best[at])
    return label


def _label(texts: int, held: list[Words], scores: list[np.ndarray], model: dict, penalty: float):
    """(prediction, score, spans) of the texts in ``held``, in order."""
    base = np.cumsum([0, *(len(w.lengths) for w in held)])
    doc = np.concatenate([w.doc + b for w, b in zip(held, base, strict=False)])
    size, start = np.concatenate([w.size for w in held]), np.concatenate([w.start for w in held])
    n = np.bincount(doc, minlength=texts)
    first = np.cumsum(n) - n
    every = np.concatenate(scores)
    label = viterbi(every, first[n > 0], n[n > 0], penalty)
    langs = np.array(model["langs"], object)
    letters = np.zeros((texts, len(langs)))
    np.add.at(letters, (doc, label), size)
    pred, total = letters.argmax(1), letters.sum(1)
    score = letters[np.arange(texts), pred] / np.maximum(total, 1)
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(label) != 0)
    opens = np.flatnonzero(new)
    closes = np.append(opens[1:], len(doc)) - 1 if len(opens) else opens
    spans = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[opens], minlength=texts))]), pa.int32()),
        pa.StructArray.from_arrays([pa.array(start[opens], pa.int32()), pa.array(start[closes] + size[closes], pa.int32()), pa.array(langs[label[opens]], pa.string())], ["start", "end", "lang"]),
    )
    return pa.array(np.where(total > 0, langs[pred], "und"), pa.string()), pa.array(np.where(total > 0, score, 0.0), pa.float64()), spans


def _predict(model, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, ids, held, scores, n = model.value, [], [], [], 0

        def flush():
            keys = pa.chunked_array(ids).combine_chunks()
            return pa.RecordBatch.from_arrays([keys, *_label(len(keys), held, scores, m, penalty)], ["doc_id", "lang_pred", "score", "lang_spans"])

        for batch in sliced(batches, 4 << 20):
            if m is None:
                k = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(["und"] * k), pa.array([0.0] * k), pa.array([[]] * k, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))], ["doc_id", "lang_pred", "score", "lang_spans"])
                continue
            words = Words([t or "" for t in batch.column("text").to_pylist()])
            scores.append(word_scores(words, m))
            words.at = words.feature = words.begin = words.script = None  # labelling needs the rest
            ids.append(batch.column("doc_id"))
            held.append(words)
            n += len(words.doc)
            if n * len(m["langs"]) * 5 >= TOGETHER:
                yield flush()
                ids, held, scores, n = [], [], [], 0
        if ids:
            yield flush()

    return run


def identify(docs: DataFrame, model: dict | None, penalty: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and lang_spans (start, end, lang; code points) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lean(_predict(sent, penalty)), f"doc_id {kind}, lang_pred string, score double, lang_spans array<struct<start:int,end:int,lang:string>>")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
