import random
import re
from collections import defaultdict

from flightline.llm.jaccard_join import component_ids, similar_sets
from flightline.llm.queries import QUERIES


def brute(rows, percent=85):
    sets = []
    for _, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        ws = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append(frozenset(tuple(ws[i:i + 4]) for i in range(max(1, len(ws) - 3))) if ws else frozenset())
    having = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            having[x].append(i)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    first = {}
    for i, s in enumerate(sets):
        if s and first.setdefault(s, i) != i:
            up[root(i)] = root(first[s])
    for i in first.values():
        common = defaultdict(int)
        for x in sets[i]:
            for j in having[x]:
                if j < i:
                    common[j] += 1
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                up[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    return sorted(((d, len(sets[i]), min((x for x in ids[root(i)] if x is not None), default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def check(rows, found):
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=repr) == brute(rows)


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(rows, QUERIES["op9_jaccard_components"](spark, folder))


def test_chains_and_hot_groups(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    rows = []
    for n in (6, 12, 25, 40, 90, 300):
        base = [word() for _ in range(n)]
        for _ in range(60):  # a chain of small edits, so that neighbours link and far members don't
            at = rng.randrange(len(base))
            base = [*base[:at], word(), *base[at + 1:]] if rng.random() < .6 else [*base, word()]
            rows.append((len(rows), rng.choice([" ", "\n"]).join(base)))
    frequent = [word() for _ in range(30)]
    for _ in range(150):  # a third of the rows share a passage
        rows.append((len(rows), " ".join([*frequent, *(word() for _ in range(rng.choice([2, 30])))])))
    rows += [(5000, None), (5001, ""), (5002, "a b"), (5003, "A B"), (5004, "a"), (5005, "a b c"), (None, "a b"), (5006, " \t"), rows[3], (5007, "x " * 100_000), (5008, "x " * 90_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    check(rows, component_ids(similar_sets(frame, hot=10)))
    assert similar_sets(frame.limit(0)).collect() == []
