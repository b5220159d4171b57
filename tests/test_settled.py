"""Series of short keys: whole keys for blocks give what blocks of time give, with one shuffle."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from flightline.operators import blocks
from flightline.operators import events as ev
from flightline.operators import matching as mt
from flightline.operators.blocks import Series, islands, neighbours, running, settled
from flightline.plans import catalog
from flightline.plans.event_queries import G, sites
from flightline.runtime import prepare


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Sightings with ties in time, sightings of nobody and one busy user."""
    rnd, start = random.Random(3), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(i, start + dt.timedelta(hours=rnd.randrange(0, 900)), rnd.choice([None, 1, 2, 3, 4, 5, 5, 5, 5]),
             rnd.choice(["purchase", "click", "error", "signup", "view"]), rnd.uniform(0, 120)) for i in range(700)]
    path = str(tmp_path_factory.mktemp("settled"))
    prepare(spark).createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return path


def test_whole_keys_equal_blocks(spark):
    df = spark.createDataFrame([(random.Random(i).choice([None, "a", "b", "c"]), float(i // 3), i, i % 7) for i in range(90)], "k string, t double, seq long, v long")
    s = Series(("k",), "t", "seq", 5.0)
    short = settled(s, df.filter("k is not null"))
    assert short.whole and not settled(s, df, 10).whole
    for make in (lambda d, x: neighbours(d, x, {"p": ("v", -2), "n": ("v", 1)}), lambda d, x: running(d, x, {"m": ("max", F.col("v"))}, False),
                 lambda d, x: islands(d, x, F.col("v") > 4)):
        got, want = (make(df.filter("k is not null"), x) for x in (short, s))
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select(*got.columns).collect()}


def test_events_of_short_sites_take_one_shuffle(spark, folder):
    s = sites(spark, folder)
    kept = catalog.QUERIES["g08_bounce_merge"](spark, folder)
    assert s.whole and kept._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange ") == 1


@pytest.mark.parametrize("name", ["g13_event_index", "g16_merged_pairs", "e09_zone_grow_sweep", "m06_named_false_positives"])
def test_queries_agree_whatever_the_longest_key(spark, folder, monkeypatch, name):
    results = []
    for size in (4096, 20):
        monkeypatch.setattr(blocks, "PACK", size)
        results.append(sorted(map(str, catalog.QUERIES[name](spark, folder).collect())))
    assert results[0] and results[0] == results[1]


def test_site_frames_equal_the_join(spark, folder, monkeypatch):
    from flightline.plans.event_queries import MAX_GAP, JITTER, KEYS, run_points
    from flightline.plans.inputs import DAY, by_site, detections
    s = sites(spark, folder)
    points = run_points(spark, folder, s).filter("video is not null")
    det = detections(spark, folder).filter("video is not null")
    got = ev.run_features(ev.over_site(points, s, G), s, G).select(*KEYS, "run_id", "top", "scale")
    want = ev.add_window_top(ev.run_features(ev.mark_runs(points.drop("run_id"), by_site(), MAX_GAP, JITTER), by_site(), G), det, by_site(), G, 2 * DAY)
    want = want.join(ev.frame_scale(det, by_site(), G), KEYS).select(*KEYS, "run_id", "top", "scale")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_ids_shared_by_recordings_are_matched_in_each(spark):
    """Whole recordings or parts of them: a mark taken in one recording is free in another."""
    pairs = spark.createDataFrame([(v, m, c, float(abs(m - c)), float(min(m, c)), float(max(m, c))) for v in "ab" for m in range(8) for c in range(8) if abs(m - c) < 3],
                                  "v string, mark long, call long, dt double, f double, e double").withColumn("q", F.struct("mark", "call"))
    for walk in (50_000, 10):
        got = mt.greedy_in_parts(pairs, Series(("v",), "f", "q", 4.0), ["mark"], ["call"], [F.col("dt"), F.col("mark"), F.col("call")], F.col("e"), walk)
        assert sorted((r.v, r.mark, r.call) for r in got.collect()) == [(v, i, i) for v in "ab" for i in range(8)]
