import hashlib
from collections import Counter

from flightline.llm.exact_dedup import exact_groups
from flightline.llm.mixing import mix


def test_exact_groups(spark):
    rows = [(1, "Aa"), (2, "aA"), (3, "ÄA"), (4, "äa"), (5, None), (6, ""), (7, "x" * 200_000), (7, "x" * 200_000), (None, "aa"), (None, "q"), (None, "q")]
    frame = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, keep_id string, run int")
    got = exact_groups(frame, runs=4, fan_in=2).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    want = Counter(low(t) for _, t in rows)
    assert set(by) == {hashlib.sha256(t.encode()).hexdigest() for t in want}
    for t, n in want.items():
        group = by[hashlib.sha256(t.encode()).hexdigest()]
        ids = [i for i, x in rows if low(x) == t and i is not None]
        assert len(group) == n and {r["group_size"] for r in group} == {n} and {r["keep_id"] for r in group} == {max(ids) if ids else None}
        assert sum(r["kept"] for r in group) == 1
    assert exact_groups(frame.limit(0)).collect() == []


def test_mix_limits(spark):
    rows = [(i, "w " * (i % 40), "ab"[i % 2] if i % 7 else None) for i in range(400)] + [(400, None, "a"), (401, "w " * 60_000, "c"), (7, "w " * 7, "b"), (7, "w " * 7, "b"), (402, "", "d")]
    frame = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, source string, target double")
    got = mix(frame).collect()
    again = mix(frame.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    sizes, took, target, source_size = Counter(), Counter(), {}, {}
    for r in got:
        sizes[r["source"]] += r["size"]
        took[r["source"]] += r["taken"]
        target[r["source"]], source_size[r["source"]] = r["target"], r["source_size"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert source_size == dict(sizes)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    for s in sizes:
        assert target[s] <= 3 * sizes[s] and abs(took[s] - target[s]) <= 64 * 3
    assert mix(frame.limit(0)).collect() == []
    assert {r["taken"] for r in mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()} == {0}
