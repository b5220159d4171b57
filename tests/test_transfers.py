"""Anchored scans by composed maps against the plain loop, and how their steps grow."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flightline.operators import transfers as tr
from flightline.operators.blocks import Series
from flightline.operators.segments import spaced


def loop(rows, gap, strict):
    last, kept = {}, set()
    for k, t, q in sorted(rows):
        before = last.get(k)
        if before is None or (t - before > gap if strict else t - before >= gap):
            kept.add((k, t, q))
            last[k] = t
    return kept


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400).map(lambda v: v / 10), min_size=1, max_size=60), st.sampled_from([0.0, 0.3, 1.7, 7.0, 25.0]), st.booleans(), st.sampled_from([0.5, 3.0, 10.0]))
def test_composed_maps_are_the_loop(times, gap, strict, width):
    times = sorted(times)
    blocks = {}
    for t in times:
        blocks.setdefault(int(t // width), []).append(t)
    maps = [tr.StepMap.of_rows(np.array(b), gap, strict) for _, b in sorted(blocks.items())]
    last, want = None, None
    for t in times:
        if last is None or (t - last > gap if strict else t - last >= gap):
            last = t
    want = last
    for cut in range(1, len(maps) + 1):  # however the blocks are grouped
        parts = [tr.StepMap.composed(maps[i:i + cut], gap, strict) for i in range(0, len(maps), cut)]
        anchor = np.array([tr.NONE])
        for m in parts:
            anchor = m(anchor, gap, strict)
        assert anchor[0] == want


@pytest.mark.parametrize("gap, strict, width", [(7.3, False, 10.0), (7.3, True, 10.0), (25.0, False, 2.0), (0.0, True, 10.0), (0.0, False, 10.0), (500.0, False, 10.0)])
def test_rows_kept_are_those_of_the_loop(spark, monkeypatch, gap, strict, width):
    rnd = random.Random(9)
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice("abc"), round(rnd.uniform(-50, 300), 1), i) for i in range(500)]
    rows += [("hot", 5.0, 1000 + i) for i in range(20)]  # equal times
    df = spark.createDataFrame(rows + [("a", None, 5000)], "k string, t double, seq long")
    for fan in (2, 64):
        monkeypatch.setattr(tr, "FAN", fan)
        got = {tuple(r) for r in spaced(df, Series(("k",), "t", "seq", width), gap, strict).collect()}
        assert got == loop(rows, gap, strict)


def test_regular_rows_take_as_many_steps_on_many_blocks(spark):
    """Rows at even distances, whose chains from different starts never meet: 4 and 64 blocks need one step up and one down."""
    assert [tr.levels(n) for n in (1, 4, 64, 65, 4096)] == [0, 1, 1, 2, 2]
    rows = [("k", float(i), i) for i in range(640)]
    df = spark.createDataFrame(rows, "k string, t double, seq long")
    got = {tuple(r) for r in spaced(df, Series(("k",), "t", "seq", 10.0), 3.0).collect()}
    assert got == loop(rows, 3.0, False)


def test_no_rows(spark):
    assert spaced(spark.createDataFrame([], "k string, t double, seq long"), Series(("k",), "t", "seq", 10.0), 3.0).collect() == []
