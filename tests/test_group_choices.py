"""Choices made in each picture: many pictures in one batch of arrays give what a plain loop over pictures gives."""

import random

import pytest
from pyspark.sql import functions as F

from flightline.operators import detectors
from flightline.operators import matching as mt

REACH, CONFS = 1.5, (0.2, 0.6)


def test_recall_equals_the_loop(spark):
    rnd = random.Random(6)
    place = lambda: None if rnd.random() < 0.05 else float(rnd.randint(0, 9))
    make = lambda n: [(rnd.choice([None, *range(40)]), i, place(), place(), rnd.choice([0.0, 1.0, 2.0, 3.0]), rnd.random()) for i in range(n)]
    labels, boxes = make(150), make(200)
    schema = "image int, turn int, x double, y double, w double, conf double"
    want = {}
    for c in CONFS:
        errors, extra = [], 0
        for image in {r[0] for r in labels}:
            free = [b for b in boxes if b[0] == image is not None and b[5] >= c]
            for _, _, x, y, w, _ in sorted((r for r in labels if r[0] == image), key=lambda r: r[1]):
                near = [(((b[2] - x) ** 2 + (b[3] - y) ** 2) ** 0.5 / max(w, 0.01), i) for i, b in enumerate(free) if None not in (x, y, b[2], b[3])]
                if near and min(near)[0] <= REACH:
                    errors.append(min(near)[0])
                    free.pop(min(near)[1])
            extra += len(free)
        want[c] = (len(errors), len(labels), extra, sorted(errors)[len(errors) // 2])
    got = detectors.recall_at(spark.createDataFrame(labels, schema), spark.createDataFrame(boxes, schema), "image", ["turn"], CONFS, REACH)
    assert {r.conf: (r.hits, r.labels, r.false_boxes, r.median_error) for r in got.collect()} == want
    # one pass over the pictures, stored before it is counted and ranked
    assert "MapInPandas" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("walk", [50_000, 12])
def test_groups_equal_the_walk(spark, walk):
    rnd = random.Random(7)
    pairs = sorted({(rnd.choice("ab" + "c" * 6), rnd.randint(0, 9), rnd.randint(0, 9)): float(rnd.randint(0, 4)) for _ in range(200)}.items(), key=lambda p: (p[1], p[0][1:]))
    taken, want = set(), set()
    for (g, a, b), _ in pairs:
        if not {(g, "a", a), (g, "b", b)} & taken:
            taken |= {(g, "a", a), (g, "b", b)}
            want.add((g, a, b))
    df = spark.createDataFrame([(*k, d) for k, d in pairs], "g string, a long, b long, d double")
    got = mt.greedy_in_groups(df, ["g"], ["a"], ["b"], [F.col("d"), F.col("a"), F.col("b")], walk)
    assert sorted((r.g, r.a, r.b) for r in got.collect()) == sorted(want)
    assert mt.greedy_in_groups(df.limit(0), ["g"], ["a"], ["b"], [F.col("d"), F.col("a"), F.col("b")], walk).collect() == []
