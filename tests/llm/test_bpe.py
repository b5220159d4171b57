"""Encoding against the tokenizers library, decoding as an exact round trip."""

import hashlib
import random

import pytest

from flightline.llm import bpe
from flightline.llm.queries import QUERIES, tokenizer_file

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_file())


def odd_texts():
    rng = random.Random(5)
    letters = list("aabbcde  \t\n\r'sdmt.,!0123456789äöüßéñçÇſİ中文字ーあ🙂👍🏽  ​\x1c\x1f\x85﻿ǅ²½٣")
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return made + ["", " ", "   a", "a   ", "aaaaaaaaaaaaa", "a" * 5000, "it's we'll I'd", "x<|endoftext|>y <|endoftext|>", "<|endoftext|>", " " * 3000, "no\0special", "ab" * 3001,
                   "the " * 20000]


@pytest.mark.parametrize("chars, kept", [(bpe.BATCH_CHARS, bpe.KEPT_IDS), (300, 200)])
def test_same_as_the_library(spark, library, monkeypatch, chars, kept):
    """Also where a batch is split often, and the words kept from earlier texts are forgotten and learned again."""
    monkeypatch.setattr(bpe, "BATCH_CHARS", chars)
    monkeypatch.setattr(bpe, "KEPT_IDS", kept)
    texts = odd_texts()
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(len(texts), None, "y")], "doc_id long, text string, ids string")
    path = tokenizer_file()
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(frame, path), path).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate([*texts, ""]):
        want = library.encode(t, add_special_tokens=False).ids
        assert got[i]["ids"] == want, repr(t[:80])
        assert got[i]["text"] == library.decode(want, skip_special_tokens=False)


def test_query_on_the_table(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op6_bpe_round_trip"](spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_no_rows(spark):
    path = tokenizer_file()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.decode(bpe.encode(empty, path), path)).collect() == []
