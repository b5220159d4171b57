"""Blocks put together by rows: short keys are one block that runs once; with few rows to a block the results stay those of the plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from flightline.operators import arcs as ar
from flightline.operators import blocks
from flightline.operators import events as ev
from flightline.operators import segments as seg
from flightline.operators import tracking as tk
from flightline.operators.blocks import Series, scan_blocks


def sightings(spark, seed, n=240, keys="aaab"):
    rnd = random.Random(seed)
    rows = [(rnd.choice(keys), i // 2, i, rnd.uniform(0, 200), rnd.uniform(0, 200), rnd.random(), 60.0) for i in range(n)]
    return spark.createDataFrame(rows, "v string, frame long, seq long, x double, y double, conf double, radius double")


def test_short_keys_run_once(spark):
    df = spark.range(3000).select((F.col("id") % 300).alias("k"), (F.col("id") * 1.0).alias("t"), F.col("id").alias("seq"))
    calls = spark.sparkContext.accumulator(0)

    def step(rows, state):
        calls.add(1)
        return rows[["k", "seq"]].assign(at=(state or 0) + rows["t"].cumsum()), float(rows["t"].sum()) + (state or 0)

    got = scan_blocks(df, Series(("k",), "t", "seq", 1.0), step, "k long, seq long, at double").collect()
    assert {(r.seq, r.at) for r in got} == {(i, float(sum(range(i % 300, i + 1, 300)))) for i in range(3000)}
    assert calls.value == 300


@pytest.mark.parametrize("arrays", [True, False])
def test_state_goes_from_pack_to_pack(spark, arrays):
    rnd = random.Random(5)
    data = [(rnd.choice([None, "a", "b", "hot", "hot", "hot"]), float(i // 3), i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, t double, seq long")

    def step(rows, state):
        sums, total = [], state or 0
        for q in rows["seq"]:
            total = (total * 7 + int(q)) % 1009
            sums.append(total)
        return ((range(len(sums)), {"sum": sums}) if arrays else rows[["k", "seq"]].assign(sum=sums)), total

    got = scan_blocks(df.filter("k IS NOT NULL"), Series(("k",), "t", "seq", 2.0), step, "k string, seq long, sum long", arrays=arrays, pack=80)
    want, total = set(), {}
    for k, _, q in data:
        if k:
            total[k] = (total.get(k, 0) * 7 + q) % 1009
            want.add((k, q, total[k]))
    assert {tuple(r) for r in got.collect()} == want


def test_blocks_longer_than_a_batch(spark):
    df = spark.range(50_000).select(F.when(F.col("id") < 45_000, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    out = blocks.map_blocks(df, ["k"], ["id"], lambda b: ([0], {"n": [len(b["id"])], "last": [int(b["id"][-1])]}), "k string, id long, n long, last long", 2)
    got = {r.k: (r.id, r.n, r.last) for r in out.collect()}
    assert got["hot"] == (0, 45_000, 44_999) and len(got) == 5_001 and got["k45000"] == (45_000, 1, 45_000)


@pytest.mark.parametrize("make", [
    lambda df, s: tk.build_tracks(df, s).select("v", "seq", "track_id"),
    lambda df, s: tk.link_people(df, s, 3.0, 3.0, 30.0).select("v", "seq", "track_id"),
    lambda df, s: tk.link_by_scale(df.withColumn("sw", F.lit(10.0)), s).select("v", "seq", "person"),
    lambda df, s: ev.near_merge(df.select("v", F.col("seq").alias("seq0"), (F.col("frame") * 1.0).alias("t0"), (F.col("frame") + F.col("x") / 40).alias("t1"),
                                          F.when(F.col("y") > 60, "l").otherwise("r").alias("site")), ["v"], "site", 2.5, 5.0).select("v", "seq0", "merged_id", "end_so_far"),
    lambda df, s: ar.best_arcs(df.withColumn("t", F.col("seq") / 5.0).withColumn("y", (F.col("t") - 20) ** 2 * 0.4 + F.col("y") / 20).withColumn("x", F.col("t") * 6),
                               Series(("v",), "t", "seq", 1.0), halo=2).select("v", "n", F.round("rms", 6)),
    lambda df, s: seg.spaced(df, s, 7.0).select("v", "seq"),
    lambda df, s: seg.arc_counts(df, s, "y", 6.0),
])
def test_packs_of_any_size_agree(spark, monkeypatch, make):
    df, s = sightings(spark, 9), Series(("v",), "frame", "seq", 5.0)
    results = []
    for size in (80, 4096):
        monkeypatch.setattr(blocks, "PACK", size)
        results.append({tuple(r) for r in make(df, s).collect()})
    assert results[0] and results[0] == results[1]
