import hashlib
import random
import re

from flightline.llm.queries import QUERIES
from flightline.llm.substring_dedup import digests, repeated_passages


def brute(rows, length=20):
    """rows: (doc_id, text); a null id sorts first, rows of one id count as one document."""
    texts = [((i is not None, i or 0), re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, ws in texts:
        for p in range(len(ws) - length + 1):
            k = tuple(ws[p:p + length])
            first[k] = min(first.get(k, (i, p)), (i, p))
    out = []
    for i, ws in texts:
        gone = set()
        for p in range(len(ws) - length + 1):
            if first[tuple(ws[p:p + length])] < (i, p):
                gone.update(range(p, p + length))
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def compare(spark, rows, found):
    want = sorted((repr(r[0]), *b) for r, b in zip(rows, brute(rows)))
    got = sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect())
    assert got == want


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    compare(spark, rows, QUERIES["op1_repeated_passages"](spark, folder))


def test_random_passages(spark, monkeypatch):
    from flightline.llm import common
    monkeypatch.setattr(common, "SHARD_BYTES", 3000)
    rng = random.Random(3)
    passages = [" ".join(rng.choice("abcdefgh") + rng.choice("xyzÄ") for _ in range(rng.randint(15, 60))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += [rng.choice(passages)] if rng.random() < .6 else ["".join(rng.choice("klmn") for _ in range(4)) + " " for _ in range(rng.randint(1, 30))]
        rows.append((rng.randint(0, 90) if i % 10 else None, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "la " * 3000), (1003, "la " * 19), (1004, "la " * 20), (1005, " \n "), rows[5], rows[5]]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    compare(spark, rows, digests(repeated_passages(frame)))
    assert repeated_passages(frame.limit(0)).collect() == []
