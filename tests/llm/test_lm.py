"""The model against a plain dictionary version of the same formulas."""

import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from flightline.llm.lm import perplexity
from flightline.llm.queries import QUERIES


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def discounts(counts):
    n = Counter(counts)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
    return [min(max(r - (r + 1) * y * n[r + 1] / n[r] if n[1] and n[r] else 0.5, 0.01), r) for r in (1, 2, 3)]


def brute(train, texts):
    one, two = Counter(), Counter()
    for t in train:
        ws = words_of(t)
        one.update(ws)
        two.update(zip(["<begin>", *ws], ws))
    n, v = sum(one.values()), len(one)
    before = Counter(w for _, w in two)
    d1, d2 = discounts(before.values()), discounts(two.values())
    off = lambda d, c: d[min(c, 3) - 1] if c else 0
    after = defaultdict(list)
    for (h, _), c in two.items():
        after[h].append(c)
    spare1 = sum(off(d1, c) for c in before.values())
    result = []
    for t in texts:
        ws = words_of(t)
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        score = 0
        for h, w in zip(["<begin>", *ws], ws):
            p = (before[w] - off(d1, before[w])) / len(two) + spare1 / len(two) / (v + 1) if two else 1 / (v + 1)
            if after[h]:
                c = two[h, w]
                p = (c - off(d2, c) + sum(off(d2, x) for x in after[h]) * p) / sum(after[h])
            score += math.log10(p)
        result.append((len(ws), sum(one[w] > 0 for w in ws), n, base, score))
    return result


def same(got, want):
    assert got[:3] == want[:3]
    assert got[3:] == pytest.approx(want[3:], rel=1e-9, abs=1e-9)


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    held = [crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    want = brute([t for (_, t), h in zip(docs, held) if not h], [t for _, t in docs])
    got = sorted(QUERIES["op10_lm_scores"](spark, folder).collect())
    assert [r["doc_id"] for r in got] == [i for i, _ in docs] and [r["held_out"] for r in got] == held
    for r, w in zip(got, want):
        same((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]), w)
    outside = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in outside) > sum(r["base_score"] for r in outside)


def test_small_cases(spark):
    rows = [(0, "a b a B", 1), (1, None, 1), (2, "", 0), (None, "a  b\tc", 1), (4, "x y", 0), (4, "x y", 0), (5, "a b " * 60_000, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score int")
    want = brute([t for _, t, s in rows if s], [t for _, t, _ in rows])
    got = perplexity(frame, F.col("score") == 1).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for r, (_, w) in zip(sorted(got, key=key), sorted(zip([r[0] for r in rows], want), key=lambda x: key(x))):
        same(tuple(r)[1:], w)
    nothing = perplexity(frame, F.col("score") == 7).collect()
    assert {r["score"] for r in nothing} == {0.0} and {r["n_known"] for r in nothing} == {0}
    assert perplexity(frame.limit(0), F.col("score") == 1).collect() == []
