"""Token counts against the libraries; what the cache holds and what is encoded."""

import pytest

from flightline.llm import token_counts
from flightline.llm.queries import QUERIES, tokenizer_file
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
ROWS = [(1, "one text"), (2, "one text"), (2, "one text"), (3, None), (4, ""), (None, "null id"), (None, "null id"), (5, "x<|endoftext|>y </s> <s>"), (6, "wörd " * 9000), (7, "\0 \n"), (8, "One Text")]


def library(path):
    if path.endswith(".model"):
        import sentencepiece
        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(pieces.encode(t))
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(path)
    return lambda t: len(whole.encode(t, add_special_tokens=False).ids)


def expected(rows, count):
    return sorted(((i, len((t or "").encode()), count(t or ""), count(t or "") > 4096) for i, t in rows), key=repr)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_same_as_the_library(spark, tmp_path, name):
    path = tokenizer_file(name)
    frame = spark.createDataFrame([(i, t, 9, b"d") for i, t in ROWS], "doc_id long, text string, n_tokens int, digest binary")
    got = token_counts.token_counts(frame, path, str(tmp_path / "cache"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(ROWS, library(path))


def test_only_misses_are_encoded_and_appended(spark, tmp_path, monkeypatch):
    path, cache = tokenizer_file("piece_bpe_32k.model"), str(tmp_path / "cache")
    first = spark.createDataFrame(ROWS[:5], "doc_id long, text string")
    token_counts.token_counts(first, path, cache).collect()
    table = spark.read.parquet(cache)
    assert table.count() == 2  # "one text" and the empty text
    asked = []
    real = token_counts.encoded_counts

    def watched(texts, raw, kind):
        asked.append(sorted({r["text"] for r in texts.collect()}))
        return real(texts, raw, kind)

    monkeypatch.setattr(token_counts, "encoded_counts", watched)
    both = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = token_counts.token_counts(both, path, cache)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(ROWS, library(path))
    assert asked == [sorted({t for _, t in ROWS if t} - {"one text"})]
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in ROWS})
    token_counts.token_counts(both, path, cache).collect()
    assert asked[-1] == []
    # another tokenizer starts a part of its own
    token_counts.token_counts(first, tokenizer_file(), cache).collect()
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_normalised_content(spark, tmp_path):
    """A tokenizer that lower-cases encodes texts that differ in case once."""
    path, cache = tokenizer_file("word_bpe_49k.json"), str(tmp_path / "cache")
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = token_counts.token_counts(frame, path, cache, normal=F.lower("text"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(ROWS, library(path))
    assert spark.read.parquet(cache).count() == len({(t or "").lower() for _, t in ROWS})


def test_query_and_empty_table(spark, tmp_path):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    path = tokenizer_file("piece_bpe_32k.model")
    assert sorted((tuple(r) for r in QUERIES["op13_token_counts"](spark, FOLDER).collect()), key=repr) == expected(docs, library(path))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(empty, path, str(tmp_path / "none")).collect() == []
