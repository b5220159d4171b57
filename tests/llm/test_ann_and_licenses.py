import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from flightline.llm.ann import neighbours
from flightline.llm.licenses import LICENCES, TEMPLATES, THRESHOLD, licences, stated, weights, words
from flightline.llm.queries import QUERIES


def test_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), np.float64)
    got = {}
    for r in QUERIES["op5_nearest_vectors"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) == set(ids[ids % 100 == 0].tolist())
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        hits += len(set(want.tolist()) & {v for v, _, _ in found})
        assert [r for _, _, r in found] == list(range(1, 11))
        assert all(abs(d[ids == v][0] - s) < 1e-12 for v, s, _ in found)
    assert hits >= 0.9 * 10 * len(got)


def test_odd_vectors(spark):
    rows = [(i, [float(i), 1.0, -1.0]) for i in range(12)] + [(100, None), (200, [0.0, 0.0, 0.0]), (300, [1.0, None, 1.0]), (400, [float("nan"), 1.0, 1.0]), (500, [1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (3, [3.0, 1.0, -1.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = neighbours(frame, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, i + 1, v, float(v)) for i, v in enumerate([1, 2, 3, 3, 4, 5, 6, 7, 8, 9])]
    assert neighbours(frame.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert len(neighbours(frame.filter("vec_id < 3"), F.col("vec_id") % 100 == 0).collect()) == 2


def test_licences(spark):
    rows = [("a/LICENSE", TEMPLATES["MIT"]), ("a/b/x.py", "code\nmore"), ("a/b/c/y", None), ("a/b/c/LICENSE", "text\n" + TEMPLATES["GPL-3.0"] + "\nmore"), ("z", "the license of the apache and the public"),
            ("a/b/own", "x\nlicensed under CC by-nc 4.0"), (None, TEMPLATES["MIT"]), (None, ""), ("q/r", ""), ("a/b/x.py", "code\nmore"), ("a/long", ("of the license " * 3000 + "\n") * 3)]
    got = {r["path"]: (r["licence"], r["inherited_from"]) for r in licences(spark.createDataFrame([(*r, 0) for r in rows], "path string, text string, dir int")).collect()}
    assert got["a/LICENSE"] == ("MIT", None) and got["a/b/x.py"] == ("CC-BY-NC-4.0", "a/b") and got["a/b/c/y"] == ("GPL-3.0", "a/b/c") and got["a/b/own"] == ("CC-BY-NC-4.0", None)
    assert got["z"] == (None, None) and got["q/r"] == (None, None) and got[None] == ("MIT", None) and got["a/long"] == ("MIT", "a")
    frame = licences(spark.createDataFrame([(*r, 0) for r in rows], "path string, text string, dir int"))
    assert frame.count() == len(rows)
    twice = licences(spark.createDataFrame([("a/x", TEMPLATES["MIT"] + "\n" + TEMPLATES["MIT"])] * 2 + [("a/y", "under the mit of it all, released to no one in the end")], "path string, text string")).collect()
    assert sorted((r["path"], r["licence"], r["score"]) for r in twice) == [("a/x", "MIT", 1.0)] * 2 + [("a/y", "MIT", 1.0)]


def test_every_stated_licence_is_found(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: {n for n, t in TEMPLATES.items() if t in (r["text"] or "").split("\n")} for r in docs}
    rows = QUERIES["op3_license_scan"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = want[int(r["path"].split("/")[-1])]
        if own:
            assert r["licence"] in own and r["inherited_from"] is None and r["score"] > 0.999


def test_headers_whole_licences_and_wrapped_statements(spark):
    from flightline.llm.licence_texts import PASSAGES
    rows = [(f"{n}/{i}", "Copyright 2020 Somebody\n\n" + "\n".join(f" * {x}" for x in p.split("\n"))) for n, t in PASSAGES.items() for i, p in enumerate(t)]
    want = {path: path.split("/")[0] for path, _ in rows}
    odd = {"w1": ("MIT", "Code released under the MIT License."), "w2": ("MIT", "This file is released\n# under the MIT\n# License. See below."),
           "w3": ("MIT", PASSAGES["MIT"][0].replace("AUTHORS OR COPYRIGHT HOLDERS", "Example Corporation")), "w4": ("BSD-3-Clause", PASSAGES["BSD-3-Clause"][0].replace("copyright holder", "University")),
           "w5": ("GPL-3.0", "word " * 300 + PASSAGES["GPL-3.0"][0] + " word" * 300), "w6": (None, "permission to license a redistribution of words " * 40)}
    files = spark.createDataFrame(rows + [(f"{k}/f", t) for k, (_, t) in odd.items()], "path string, text string")
    want.update({f"{k}/f": n for k, (n, _) in odd.items()})
    got = {r["path"]: (r["licence"], r["inherited_from"]) for r in licences(files).collect()}
    assert got == {p: (n, None) for p, n in want.items()}


def plain(text, idf, other, units, bags):
    """The best (score, licence) over every window of every template: counts, inner product and squared length moved on word by word."""
    w, best = words(text or ""), (0.0, None)
    for key in sorted(units):
        u, size = units[key], min(len(bags[key]), len(w))
        count, dot, square = Counter(), 0.0, 0.0
        for e, x in enumerate(w):
            for y, by in ((x, 1), (w[e - size], -1)) if e >= size else ((x, 1),):
                f = idf.get(y, other)
                square += f * f * ((count[y] + by) ** 2 - count[y] ** 2)
                dot += by * f * u.get(y, 0.0)
                count[y] += by
            if e >= size - 1 and dot > 0:
                score = round(dot / math.sqrt(square), 9)
                if score > best[0] + 1e-9 or abs(score - best[0]) <= 1e-9 and best[1] and key[0] < best[1]:
                    best = (score, key[0])
    return best if best[0] >= THRESHOLD else None


def test_statements_equal_a_plain_cosine_of_all_windows(spark):
    from flightline.llm.licence_texts import PASSAGES
    docs = [(str(r["doc_id"]), r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    mit, bsd = PASSAGES["MIT"][0], PASSAGES["BSD-3-Clause"][0]
    reworded = mit.replace("ermission", "llowance").replace("sublicense", "relet")
    docs += [("reworded", reworded), ("deep", "some words of a text " * 500 + reworded + " and so on" * 700), ("edge", "word " * 505 + bsd + " word" * 511), ("both", mit + "\n" + bsd),
             ("half", mit[:len(mit) // 2]), ("stop", "the of and to or in software " * 400), ("dots", "... a.b ..c.. 4.0. " * 300), ("null", None), ("empty", "")]
    passages = {(n, i): p for n, t in LICENCES.items() for i, p in enumerate(t)}
    idf, other, units = weights(passages)
    bags = {k: words(p) for k, p in passages.items()}
    want = {k: plain(t, idf, other, units, bags) for k, t in docs}
    got = {r["path"]: (r["score"], r["licence"]) for r in stated(spark.createDataFrame(docs, "path string, text string"), "path", "text", LICENCES, THRESHOLD).collect()}
    assert {k for k, v in want.items() if v} == set(got) and {"reworded", "deep", "edge", "both"} <= set(got)
    for k, (score, licence) in got.items():
        assert abs(score - want[k][0]) < 2e-9 and licence == want[k][1]


def test_licence_ties_and_no_templates(spark):
    files = spark.createDataFrame([("x/a", "one two three"), ("x/b", None)], "path string, text string")
    same = {"B": "one two three", "A": "one two three"}
    assert {r["path"]: (r["licence"], r["inherited_from"]) for r in licences(files, templates=same).collect()} == {"x/a": ("A", None), "x/b": ("A", "x")}
    assert [r["licence"] for r in licences(files, templates={}).collect()] == [None, None]
