import numpy as np
import pytest
from tokenizers import Tokenizer

from elevspark.llm.tokens import Encoder, read_cache, token_counts, vocabulary_path

TEXTS = ["", None, "Hello  world", "hello world ", "don't <|endoftext|>now<|startoftext|>", "été naïve", "a\x1cb c\x1dd", "a\xa0b  c\x85d", "日本語 текст 123 $%^ \U0001f600", "x" * 500, " \t\n\x0b\f\r", "İstanbul ß", "a ́b", "it's we'll I'M", "Été, Hello! ĲSSEL... Ñandú;; word.word a.b, 1st. x2! It's. Don't, q' 'T. ¡Hola! \u01c5x. \u0130x, K\u212a. e\u0301t. \u0345a", "Word word, WORD. word", "<|endoftext|> <| endoftext |>"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_library_ids(name):
    path = vocabulary_path(name)
    tok, texts = Tokenizer.from_file(path), [t or "" for t in TEXTS]
    got = Encoder(path).encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_sentencepiece_model():
    import sentencepiece

    path = vocabulary_path("piece_bpe_32k.model")
    want = sentencepiece.SentencePieceProcessor(model_file=path).encode(["a b", "", "é  x"])
    assert [np.frombuffer(b, "<u4").tolist() for b in Encoder(path).encode(["a b", "", "é  x"])] == want


def test_counts_and_cache(spark, tmp_path):
    data = [(i, t, "clash") for i, t in enumerate(TEXTS * 2)] + [(None, "Hello world", "z")]
    df = spark.createDataFrame(data, "doc_id long, text string, n_tokens string")
    cache = f"file://{tmp_path}/cache"
    tok = Tokenizer.from_file(vocabulary_path())
    want = sorted(((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in data), key=str)
    for _ in range(2):
        assert sorted((tuple(r) for r in token_counts(df, cache).collect()), key=str) == want
    stored = read_cache(spark, cache)
    assert stored.count() == stored.select("content").distinct().count()
    assert token_counts(df.where("false"), cache).count() == 0


def test_vocabularies_that_see_white_space_count_whole_texts(spark):
    path = vocabulary_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["a  b\n\n\nc ", " a b c", "a b c", "x\t\ty", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, vocabulary=path).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)} and got[0] != got[2]


def test_a_second_run_encodes_only_new_digests(spark, tmp_path):
    cache = f"file://{tmp_path}/lasting"
    first = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "doc_id long, text string")
    token_counts(first, cache).collect()
    more = first.unionByName(spark.createDataFrame([(100 + i, f"another {i % 3}") for i in range(9)] + [(200, "text  number 1 ")], "doc_id long, text string"))
    assert token_counts(more, cache).count() == 30
    stored = [r.content for r in read_cache(spark, cache).collect()]
    assert len(stored) == len(set(map(bytes, stored))) == 23


def test_a_worker_forgets_and_still_agrees():
    path = vocabulary_path()
    tok, small = Tokenizer.from_file(path), Encoder(path, remembered=5)
    for texts in (["One two three, four!", "x" * 100 + " seven"], ["four three " + "Y" * 90 + ".", "one Two"], ["x" * 100, "eight nine"]):
        assert [np.frombuffer(b, "<u4").tolist() for b in small.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(small.known) <= 12
