"""Operator 7: toxicity by weak supervision.

Features of a text are its distinct lower-case words and their first ``STEMS`` letters. From at most
``SAMPLE`` labelled and as many unlabelled documents of the folds that may be learned from:

1. Counts of features by label, summed on the cluster, give a vocabulary of at most ``VOCABULARY``
   features that point to label 1. The fixed lexicons are one feature each.
2. Voters fire or not on each sampled document: lexicon voters over fixed lists, lexicon voters over
   words and stems found in the *other* half of the labelled rows, by the weight of the words found, and
   pattern voters over the raw text. Voters that the labels do not confirm are left out.
3. A generative label model estimates, by expectation maximisation over labelled and unlabelled rows,
   how often each voter fires on either class, and from the residuals which voters are correlated; a
   voter's evidence is divided by one plus its positive correlations. Labels count in these estimates
   only: a row's posterior comes from its votes, labelled or not. (Without any labels the larger class
   that voters tell apart can be a language.)
4. A linear classifier is trained on those posteriors; its probability is the score.

Null and empty texts have no features and get the score of the intercept. Without labels, or with
only one class, every score is the share of label 1 (0 without labels); so it is where no voter fires.
Repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, label_rows, lean, sliced, staged, table

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
SAMPLE, VOCABULARY, MIN_DOCS, SEED = 12000, 6000, 4, 23
STEMS = (4, 5, 6)
#: log odds from which a feature of the other half is in a voter's lexicon; such voters fire where the log odds of the words found add up to these.
STRONG, WEIGHTS = 2.0, (3.0, 6.0, 12.0)
#: How much oftener a voter must fire on label 1 than on label 0 to be heard.
CONFIRMED = 6
#: log odds from which a feature is in the vocabulary: common words, of which long texts have many, are not.
POINTS = 1.5

#: Lexicons of insults and threats, by theme.
LEXICONS = {
    "insult": "idiot idiots moron morons stupid dumb dumbass imbecile fool loser losers clown clowns jerk freak creep scum trash garbage filth pig rat vermin",
    "contempt": "worthless pathetic disgusting ugly useless hopeless repulsive vile despicable contemptible hideous shameful",
    "profane": "fuck fucking shit bullshit bitch bastard asshole damn crap whore slut cunt dick",
    "threat": "kill die murder hang beat destroy hate hurt burn rape shoot",
    "german": "idiot dumm trottel arschloch scheisse scheiße depp vollidiot abschaum dreck hurensohn widerlich erbärmlich wertlos versager",
    "french": "idiot imbécile con connard connasse salaud merde putain stupide crétin ordure dégoûtant minable pathétique",
    "spanish": "idiota imbécil estúpido estúpida pendejo cabrón mierda puta basura asqueroso patético inútil escoria maldito",
}
PATTERNS = {
    "second person": re.compile(r"\b(?:you|du|tu|eres|vous|usted)\b\W+(?:\w+\W+){0,3}?(?:idiot|moron|stupid|loser|clown|trash|scum|pathetic|worthless|disgusting)", re.IGNORECASE),
    "bangs": re.compile(r"[!?]{3,}"),
    "shouting": re.compile(r"(?:\b[A-Z]{3,}\b\W+){4,}"),
}
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(words: set[str]) -> set[str]:
    """Words as they are; stems with their length before them (a digit is in no word)."""
    out = set(words)
    for k in STEMS:
        out.update(f"{k}{w[:k]}" for w in words if len(w) >= k)
    return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, y, half, n): documents that have the feature."""
    for batch in sliced(batches, 8 << 20):
        count: Counter = Counter()
        for text, y, half in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "half")), strict=True):
            count.update((f, y, half) for f in features_of(words_of(text)))
        keys = list(count)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(count.values()), pa.int64())], ["feature", "y", "half", "n"])


def _votes(sent):
    """(y, half, features in the vocabulary, votes of the fixed voters) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        lexicons = [set(v.split()) for v in LEXICONS.values()]
        for batch in sliced(batches, 8 << 20):
            found, votes = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found.append(sorted(index[f] for f in features_of(words) & index.keys()))
                votes.append([int(bool(words & x)) for x in lexicons] + [int(bool(p.search(text or ""))) for p in PATTERNS.values()])
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("half"), pa.array(found, pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.int32()))], ["y", "half", "found", "votes"])

    return run


def label_model(votes: np.ndarray, known: np.ndarray | None = None, rounds: int = 100) -> tuple[np.ndarray, dict]:
    """Posterior of label 1 for each row of 0/1 ``votes``, and the estimates it rests on.

    The two rates of each voter are estimated with the posterior, in turn; where ``known`` has a label (else -1) the estimate
    counts that. The posterior itself comes from the votes alone, of every row. Evidence of voters that err together is
    shared out by their residual correlation.
    """
    n, m = votes.shape
    p = np.clip(votes.mean(1) * 2, 0.02, 0.98)
    for _ in range(rounds):
        q = p if known is None else np.where(known >= 0, known, p)
        prior = np.clip(q.mean(), 1e-4, 1 - 1e-4)
        rates = [np.clip(((w[:, None] * votes).sum(0) + 0.5 * votes.mean(0) + 0.01) / (w.sum() + 0.52), 1e-5, 1 - 1e-5) for w in (1 - q, q)]
        left = votes - ((1 - q)[:, None] * rates[0] + q[:, None] * rates[1])
        spread = left.std(0) + 1e-9
        share = 1 / (1 + np.clip((left / spread).T @ (left / spread) / n - np.eye(m), 0, None).sum(1))
        new = posterior(votes, prior, rates, share)
        done = np.abs(new - p).max() < 1e-5
        p = new
        if done:
            break
    return p, {"prior": prior, "rates": rates, "share": share}


def posterior(votes: np.ndarray, prior: float, rates: list[np.ndarray], share: np.ndarray) -> np.ndarray:
    """Bayes' rule over voters that are independent given the class, each with its share of the evidence."""
    fired, silent = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
    z = np.log(prior / (1 - prior)) + votes @ (fired * share) + (1 - votes) @ (silent * share)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def linear(rows: list[np.ndarray], target: np.ndarray, m: int, rounds: int = 400, l2: float = 2e-5, rate: float = 0.2) -> tuple[np.ndarray, float]:
    """Logistic regression of soft targets on sets of features, by Adam over all rows."""
    n = len(rows)
    doc, col = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, int)]).astype(int)
    w, b = np.zeros(m), float(np.log((target.mean() + 1e-4) / (1 - target.mean() + 1e-4)))
    mean, var = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(doc, w[col], n)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        grad = np.append(np.bincount(col, err[doc], m) + l2 * w, err.sum())
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        step = rate * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The classifier: {"weights": {feature: weight}, "intercept"}, from ``docs`` (doc_id, text), some of which have ``labels`` (doc_id, y)."""
    spark = docs.sparkSession
    others = docs.select("doc_id").where("doc_id IS NOT NULL").join(labels.select("doc_id"), "doc_id", "left_anti").distinct().withColumn("y", F.lit(-1))
    chosen = bounded_sample(labels, sample, SEED).unionByName(bounded_sample(others, sample, SEED))
    chosen = staged(chosen.withColumnRenamed("doc_id", "chosen"), "chosen")  # at most twice ``sample`` rows
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).select("text", "y", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"))
    rows = staged(rows, "sample")
    sizes = {(r["y"], r["half"]): r["n"] for r in rows.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    ones, zeros = (sum(n for (y, _), n in sizes.items() if y == k) for k in (1, 0))
    if not ones or not zeros:
        share = ones / max(ones + zeros, 1)
        return {"weights": {}, "intercept": float(np.log((share + 1e-9) / (1 - share + 1e-9)))}
    tally = rows.where("y >= 0").mapInArrow(lean(_tally), "feature string, y int, half int, n long").groupBy("feature")
    seen = lambda y, h: F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("half") == h), F.col("n"))), F.lit(0))
    counts = tally.agg(*[seen(y, h).alias(f"n{y}{h}") for y in (0, 1) for h in (0, 1)])
    a, c = F.col("n10") + F.col("n11"), F.col("n00") + F.col("n01")
    odds = F.log((a + 0.5) / F.lit(ones + 1.0)) - F.log((c + 0.5) / F.lit(zeros + 1.0))
    top = counts.where((a + c >= MIN_DOCS) & (odds >= POINTS)).withColumn("gain", F.abs(odds) * F.sqrt(F.least(a + c, F.lit(200)))).orderBy(F.desc("gain"), "feature").limit(VOCABULARY).collect()
    vocabulary = [r["feature"] for r in top]
    half_odds = np.zeros((2, len(top)))
    for h in (0, 1):
        t1, t0 = sizes.get((1, h), 0) + 1.0, sizes.get((0, h), 0) + 1.0
        half_odds[h] = [np.log((r[f"n1{h}"] + 0.3) / t1) - np.log((r[f"n0{h}"] + 0.3) / t0) if r[f"n1{h}"] >= 2 else 0 for r in top]
    sent = spark.sparkContext.broadcast({f: i for i, f in enumerate(vocabulary)})
    data = rows.mapInArrow(lean(_votes(sent)), "y int, half int, found array<int>, votes array<int>").toPandas()
    found = [np.asarray(x, int) for x in data["found"]]
    kind = np.array([int(f[0]) if f[0].isdigit() else 0 for f in vocabulary], int)
    y, half = data["y"].to_numpy(), data["half"].to_numpy()
    fixed = np.array(list(data["votes"]), float).reshape(len(data), -1)
    voters = [fixed]
    for k in (0, *STEMS):
        weight = [np.where((kind == k) & (half_odds[h] >= STRONG), half_odds[h], 0) for h in (1, 0)]  # for half h, from the other
        held = np.array([weight[h][x].sum() for x, h in zip(found, half, strict=True)])
        voters += [(held >= least)[:, None].astype(float) for least in WEIGHTS]
    votes = np.concatenate(voters, axis=1)
    votes = votes[:, votes[y == 1].mean(0) > CONFIRMED * votes[y == 0].mean(0)]
    if not votes.shape[1]:
        return {"weights": {}, "intercept": float(np.log(ones / zeros))}
    soft, model = label_model(votes, y)
    themes = np.array(list(data["votes"]))[:, : len(LEXICONS)]
    found = [np.append(x, len(vocabulary) + np.flatnonzero(t)) for x, t in zip(found, themes, strict=True)]
    vocabulary = [*vocabulary, *(f"0{theme}" for theme in LEXICONS)]
    w, b = linear(found, soft, len(vocabulary))
    keep = np.abs(w) > 1e-3
    return {"weights": {f: float(x) for f, x, k in zip(vocabulary, w, keep, strict=True) if k}, "intercept": b, "label_model": {k: np.asarray(v).tolist() for k, v in model.items()}}


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, b = sent.value["weights"], sent.value["intercept"]
        plain = {f: w for f, w in weights.items() if not f[0].isdigit()}
        themes = [(set(LEXICONS[f[1:]].split()), w) for f, w in weights.items() if f[0] == "0"]
        stems = [(k, {f[1:]: w for f, w in weights.items() if f[0] == str(k)}) for k in STEMS]
        for batch in sliced(batches):
            z = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                s = b + sum(plain[f] for f in words & plain.keys())
                s += sum(w for lexicon, w in themes if not lexicon.isdisjoint(words))
                for k, known in stems:
                    s += sum(known[f] for f in {w[:k] for w in words} & known.keys() if len(f) == k)
                z.append(s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(np.array(z), -500, 500))), pa.float64())], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("weights", "intercept")})
    return docs.select("doc_id", "text").mapInArrow(lean(_score(sent)), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    may = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    model = learn(docs.where(may), label_rows(table(spark, sf_dir, "labels").where(may), "toxic"))
    out = score_toxicity(docs, model)
    return out.select("doc_id", (~may).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
