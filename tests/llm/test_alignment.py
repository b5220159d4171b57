"""Alignment of two tokenizers against a plain walk over both token lists."""

import hashlib
import random
from collections import Counter

import pytest

from flightline.llm import alignment
from flightline.llm.bpe import byte_letters
from flightline.llm.queries import QUERIES, tokenizer_file

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(tokenizer_file())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    back = {c: i for i, c in enumerate(byte_letters())}
    a_bytes = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in a.get_vocab().items()}
    b_bytes = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
    return a, b, a_bytes, b_bytes


def ends(ids, spelt):
    at, out = 0, []
    for i in ids:
        out.append((at, at := at + len(spelt[i])))
    return out


def plain(rows, libraries):
    a, b, a_bytes, b_bytes = libraries
    counts, told = Counter(), []
    for key, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[i] for i in ids_a) != want or b"".join(b_bytes[i] for i in ids_b) != want:
            told.append((key, [], [], [], []))
            continue
        span_a, span_b = ends(ids_a, a_bytes), ends(ids_b, b_bytes)
        links, j = [], 0
        for i, (lo, hi) in enumerate(span_a):
            while span_b[j][1] <= lo:
                j += 1
            k = j
            while k < len(span_b) and span_b[k][0] < hi:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        both = sorted({e for _, e in span_a} & {e for _, e in span_b})
        groups = [(",".join(str(i) for i, s in zip(ids_a, span_a) if lo <= s[0] < hi), ",".join(str(i) for i, s in zip(ids_b, span_b) if lo <= s[0] < hi))
                  for lo, hi in zip([0, *both], both)] if len(want) < 3000 else None
        counts.update(links)
        told.append((key, ids_a, ids_b, both, links) if groups is None else (key, ids_a, ids_b, groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for key, ids_a, ids_b, groups, links in told:
        text = ";".join("|".join(g) for g in groups) if groups and isinstance(groups[0], tuple) else None
        out.append((key, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
                    "" if not links else hashlib.sha256(text.encode()).hexdigest() if text is not None else None))
    return out


def same(got, want):
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:7] == w[:7]
        assert w[7] is None or g[7] == w[7]


def odd_texts():
    rng = random.Random(7)
    letters = list("aabbcde   \t\n\r'sdmt.,!0123456789äöüßéñçÇſİ中文字ーあ🙂👍🏽  ​\x1c\x1f\x85﻿ǅ²½٣▁_\0")
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    return made + ["", " ", "   a", "a   ", "it's we'll I'd", "x<|endoftext|>y <|endoftext|> <s> </s><unk>", " " * 300, "no\0special", "a▁b c", "the " * 2000, "ab" * 1500, "the same text", "the same text"]


def test_same_as_plain(spark, libraries, monkeypatch):
    """Also over several blocks of a task, and where encoded stretches are forgotten and learned again."""
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, None), (None, "null id"), (3, "twice"), (3, "twice")]
    want = plain(rows, libraries)
    frame = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_a int, block string").repartition(3)
    for chars, kept in ((alignment.BLOCK_CHARS, alignment.KEPT), (400, 100)):
        monkeypatch.setattr(alignment, "BLOCK_CHARS", chars)
        monkeypatch.setattr(alignment, "KEPT", kept)
        got = alignment.aligned(frame, tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))
        same([tuple(r) for r in got.collect()], want)


def test_query_on_the_table(spark, libraries):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    same([tuple(r) for r in QUERIES["op12_token_alignment"](spark, FOLDER).collect()], plain(docs, libraries))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(empty, tokenizer_file(), tokenizer_file("piece_bpe_32k.model")).collect() == []


def test_only_texts_without_tokens(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    got = alignment.aligned(frame, tokenizer_file(), tokenizer_file("piece_bpe_32k.model")).collect()
    assert sorted(tuple(r) for r in got) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]
