"""Tokenizers of public vocabulary files, and operator 6: token counts through a digest cache.

A text's ids are the ids of its pieces between ASCII white space, in order: the vocabularies used
here drop white space before any merge, so no token spans it. Each Python worker keeps the ids of
the pieces it has met and asks the library for those it has not; when it holds too many it forgets
those that the last slice of texts did not have. Vocabularies for which this does not hold are asked
for whole texts.

The digest cache is a Parquet folder (content, tokenizer, n_tokens). ``content`` is the SHA-256 of
the normalised text: runs of ASCII white space as one blank, none at the ends, for vocabularies that
cannot tell these apart; the text itself for all others. ``tokenizer`` is that of the vocabulary
file, the settings and the kind of normalisation. Counting joins the digests of all documents with the
cache, encodes one text of each digest that misses, appends, and joins again. Appending twice is
harmless: equal keys have equal counts. The query's cache is the folder that the setting
``spark.elevspark.tokenCache`` names; where it is unset a new one is begun with each call.

Null and empty texts have 0 tokens; special strings inside texts become special tokens as is the
library's default; nothing is truncated. Rows may repeat; each gives a row. Other columns are
ignored.
"""

from __future__ import annotations

import array
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, lean, sliced, staged, staged_path, table, text_of

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Pieces that a worker remembers, and the longest piece worth remembering; bytes of text encoded together.
REMEMBERED, LONGEST, SLICE = 600_000, 64, 4 << 20
CACHE_SETTING = "spark.elevspark.tokenCache"
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.path, self.known, self.remembered = path, {}, remembered
        if path.endswith(".json"):
            import json

            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(path)
            self.tok.no_truncation()
            self.tok.no_padding()
            pre, norm = (json.loads(x.__getstate__()) if x else {} for x in (self.tok.pre_tokenizer, self.tok.normalizer))
            specials = self.tok.get_added_tokens_decoder()
            self.specials = [t.content.lower() for t in specials.values()]
            added = all(not (t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content)) for t in specials.values())
            steps, tail = [n["type"] for n in norm.get("normalizers", [])], pre.get("pretokenizers", [])
            split = next((p for p in tail if p["type"] == "Split"), None)
            self.mark = next(((t.content, i) for i, t in sorted(specials.items()) if t.special and not t.normalized), None)
            # Words and closing marks are separate and case is dropped: what ``encode`` needs to hold of the rule.
            added = added and "Lowercase" in steps and "NFC" in steps and [p["type"] for p in tail] == ["Split", "ByteLevel"] and type(self.tok.model).__name__ == "BPE"
            self.by_piece = added and split["behavior"] == "Removed" and split["invert"] and r"[^\s" in split["pattern"].get("Regex", "")
        else:
            import sentencepiece

            self.mark = None
            self.tok, self.by_piece = sentencepiece.SentencePieceProcessor(model_file=path), False

    def _ask(self, texts: list[str]) -> list[bytes]:
        if self.path.endswith(".json"):
            ids = (e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False))
        else:
            ids = self.tok.encode(texts, num_threads=1)
        return [array.array("I", x).tobytes() for x in ids]

    def _ask_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece. Many are asked for at once, with a special token between them, whose id tells them apart."""
        if self.mark is None:
            return dict(zip(pieces, self._ask(pieces), strict=True))
        out, plain = {}, []
        for p in pieces:
            (out.setdefault(p, b"") if self.mark[0] in p else plain.append(p))
        out = dict(zip(out, self._ask(list(out)), strict=True))
        for i in range(0, len(plain), 256):
            part = plain[i : i + 256]
            ids = self.tok.encode_batch_fast([f" {self.mark[0]} ".join(part)], add_special_tokens=False)[0].ids
            at = 0
            for p in part[:-1]:
                end = ids.index(self.mark[1], at)
                out[p] = array.array("I", ids[at:end]).tobytes()
                at = end + 1
            out[part[-1]] = array.array("I", ids[at:]).tobytes()
        return out

    def _plain(self, text: str) -> str:
        """The text in lower case, closing marks that follow a letter apart: the same ids from fewer pieces. Only where each letter has
        one lower case and none makes a special token."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        low = text.lower()
        return text if any(x in low for x in self.specials) else _CLOSING.sub(r" \g<0>", low)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_piece:
            return self._ask(texts)
        known, pieces = self.known, [_split(self._plain(t)) for t in texts]
        here = set().union(*pieces)
        new = here.difference(known)
        ask, lows, made = set(), set(), []
        for p in new:
            if p.isascii() and p.isalpha() and p.islower():
                lows.add(p)
                continue
            word = p.rstrip(".,;:!?")
            # Letters up to U+012F have one lower-case letter each and no part in composition: such a word and its
            # closing marks are separate tokens, and the word's case is immaterial.
            if word.isalpha() and (word.isascii() or max(word) < "\u0130"):
                low, marks = word.lower(), p[len(word) :]
                lows.add(low)
                if marks:
                    ask.add(marks)
                if p != low:
                    made.append((p, low, marks))
            else:
                ask.add(p)
        ask.difference_update(known)
        tokenize = self.tok.model.tokenize
        for low in lows.difference(known):  # normalised and split already: straight to the merges
            form = low if low.isascii() else low.encode("utf-8").decode("latin-1").translate(_BYTE_LEVEL)
            known[low] = array.array("I", [t.id for t in tokenize(form)]).tobytes()
        known.update(self._ask_pieces(list(ask)))
        for p, low, marks in made:
            known[p] = known[low] + known[marks] if marks else known[low]
        out = [b"".join(map(known.__getitem__, ps)) for ps in pieces]
        for p in [p for p in new if len(p) > LONGEST]:
            known.pop(p)
            known.pop(p.rstrip(".,;:!?").lower(), None)
        if len(known) > self.remembered:
            self.known = {p: known[p] for p in here if p in known}
        return out


def _byte_level() -> dict[int, int]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


_BYTE_LEVEL = _byte_level()


def _split(text: str) -> list[str]:
    """Pieces between ASCII white space. str.split() also cuts at other white space; those texts take the slow way."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return _WORD.findall(text)


_CLOSING = re.compile(r"[.,;:!?](?<=[a-z\u00df-\u00f6\u00f8-\u00ff].)[.,;:!?]*(?![^\x20\x09-\x0D])")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@functools.lru_cache(maxsize=2)
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, remembered)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|no special tokens added|" + (b"1" if encoder(path).by_piece else b"whole texts")).hexdigest()


def normalised(text, by_piece: bool = True):
    """The content that the cache knows."""
    if not by_piece:
        return text
    return F.regexp_replace(F.btrim(text, F.lit(SPACES)), r"[\x20\x09-\x0D]+", " ")


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE):
            ids = encoder(path).encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array([len(x) // 4 for x in ids], pa.int64())], ["content", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; none where the folder does not exist yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "content binary, tokenizer string, n_tokens long")
    return spark.read.schema("content binary, tokenizer string, n_tokens long").parquet(cache)


def token_counts(docs: DataFrame, cache: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; new counts are appended to the folder ``cache``."""
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path()
    cache, version = cache or staged_path(spark, "token-cache"), tokenizer_digest(path)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("row_id"), text_of().alias("text"))
    plain = normalised(F.col("text"), encoder(path).by_piece)
    content = F.unhex(F.sha2(F.encode(plain, "UTF-8"), 256))
    digests = staged(rows.select("doc_id", "row_id", F.octet_length("text").cast("long").alias("n_bytes"), content.alias("content")), "digests")
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version)
    # One row of each digest that misses. Texts then travel by (row, digest), so many copies of one are no task's alone.
    misses = staged(digests.groupBy("content").agg(F.min("row_id").alias("row_id")).join(stored, "content", "left_anti"), "misses")
    texts = rows.select("row_id", content.alias("content"), plain.alias("text"))
    misses = texts.join(misses, ["row_id", "content"], "left_semi").groupBy("row_id", "content").agg(F.first("text").alias("text")).select("content", "text")
    counted = misses.mapInArrow(lean(_count(path)), "content binary, n_tokens long")
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    found = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    # Written first: a join beside the grouping it rests on could not split the rows of a digest with many copies.
    return digests.join(staged(found, "counts"), "content").select("doc_id", "n_bytes", "n_tokens")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), spark.conf.get(CACHE_SETTING, None)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
