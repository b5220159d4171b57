import hashlib
import random

import numpy as np

from flightline.llm.queries import QUERIES
from flightline.llm.suffix_dedup import digests, repeated_bytes, suffix_ranks


def brute(rows, length=50):
    texts = [((i is not None, i or 0), (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for p in range(len(b) - length + 1):
            k = b[p:p + length]
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, b), (name, _) in zip(texts, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((repr(name), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def compare(rows, found):
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect()) == brute(rows)


def test_suffix_order():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 5, 17, 200, 1000):
        s = rng.integers(1, 3, n)
        rank = suffix_ranks(s, 4)
        order = np.argsort(rank)
        cut = [tuple(s[i:i + 60]) for i in order]
        assert cut == sorted(cut) and sorted(rank.tolist()) == list(range(n))


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    compare(rows, QUERIES["op7_suffix_dedup"](spark, folder))


def test_random_passages(spark, monkeypatch):
    from flightline.llm import common
    monkeypatch.setattr(common, "SHARD_BYTES", 20_000)
    rng = random.Random(4)
    passages = ["".join(rng.choice("abä ") for _ in range(rng.randint(40, 150))) for _ in range(15)]
    rows = []
    for i in range(150):
        parts = [rng.choice(passages)[rng.randint(0, 9):] if rng.random() < .6 else "".join(rng.choice("klmnop") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 5))]
        rows.append((rng.randint(0, 120) if i % 12 else None, "".join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "z" * 5000), (1003, "z" * 49), (1004, "z" * 50), (1005, "z" * 700), rows[5], rows[5]]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    compare(rows, digests(repeated_bytes(frame)))
    assert repeated_bytes(frame.limit(0)).collect() == []


def test_hashes_of_two_sizes_and_lookups():
    from flightline.llm.common import BYTE, covered
    from flightline.llm.substring_dedup import among
    from flightline.llm.suffix_dedup import string_hashes
    rng = np.random.default_rng(5)
    for n in (0, 1, 17, 18, 49, 50, 51, 400):
        raw = rng.integers(0, 3, n).astype(np.uint8)
        for size, h in zip((18, 50), string_hashes(BYTE[raw], 18, 50)):
            texts = [raw[i:i + size].tobytes() for i in range(n - size + 1)]
            assert h.tolist() == string_hashes(BYTE[raw], size)[0].tolist() and len(h) == len(texts)
            assert len(set(zip(texts, h.tolist()))) == len(set(texts)) == len(set(h.tolist()))
    values = rng.integers(0, 1 << 63, 5000).astype(np.uint64) >> rng.integers(0, 60, 5000).astype(np.uint64)
    for known in (values[:0], values[::7], values.view(np.int64)[:3].view(np.uint64)):
        assert among(values, known).tolist() == [v in set(known.tolist()) for v in values.tolist()]
    starts = rng.integers(0, 90, 5)
    assert covered(starts, 7, 92).tolist() == [any(a <= i < a + 7 for a in starts) for i in range(92)]
