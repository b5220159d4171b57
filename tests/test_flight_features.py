"""Flight features of whole sites: frames over a flight give what the joins give, from one marking of the runs and one shuffle."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightline.operators import blocks
from flightline.operators import events as ev
from flightline.operators import grouped_fits as gf
from flightline.operators import models as md
from flightline.operators.features import FEATURES
from flightline.plans import feature_queries, score_queries
from flightline.runtime import prepare


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Sightings with ties in time and height, without a user, a height or a site, and one busy user."""
    rnd, start = random.Random(8), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(i, start + dt.timedelta(hours=rnd.randrange(0, 900)), rnd.choice([None, 1, 2, 3, 4, 5, 5, 5, 5]), rnd.choice(["purchase"] + ["click", "error", "view", None] * 12),
             rnd.choice([None, 0.0, 30.0, 35.0, 50.0] + [rnd.uniform(0, 120) for _ in range(40)])) for i in range(2500)]
    path = str(tmp_path_factory.mktemp("flights"))
    prepare(spark).createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return path


def test_features_take_one_shuffle(spark, folder):
    plan = feature_queries.run_features(spark, folder)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_long_recordings_of_short_sites_take_one_shuffle(spark, folder, monkeypatch):
    det = feature_queries.detections(spark, folder)
    longest = [det.groupBy(*k).count().agg(F.max("count")).first()[0] for k in (["video", "site"], ["video"])]
    assert longest[0] < longest[1]
    monkeypatch.setattr(blocks, "PACK", longest[0])
    test_features_take_one_shuffle(spark, folder)


def test_features_agree_whatever_the_longest_key(spark, folder, monkeypatch):
    found = []
    for size in (4096, 20):
        monkeypatch.setattr(blocks, "PACK", size)
        rows = feature_queries.run_features(spark, folder).collect()
        found.append({(r["video"], r["site"], r["run_id"]): [r[c] for c in ("mt", *FEATURES)] for r in rows})
        assert len(found[-1]) == len(rows)
    frames, joins = found
    assert len(joins) > 50 and frames.keys() == joins.keys() and any(v[1 + FEATURES.index("crossed")] for v in joins.values())
    for key, want in joins.items():
        assert frames[key] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_runs_are_marked_once(spark, folder, monkeypatch):
    calls, mark = [], ev.mark_runs
    monkeypatch.setattr(ev, "mark_runs", lambda *a: calls.append(1) or mark(*a))
    rows = score_queries.model_rows(spark, folder)
    assert len(calls) == 1 and rows.columns == ["video", "site", "rid", "y", "features"]
    buys = feature_queries.detections(spark, folder).filter("site = 'purchase'").select("video", F.col("t").alias("bt"))
    starts = feature_queries.run_points(spark, folder).groupBy("video", "site", "run_id").agg(F.min("t").alias("mt"))
    made = starts.join(buys, "video").filter(F.abs(F.col("bt") - F.col("mt")) <= 86400).select(F.concat_ws("/", "video", "site", "run_id").alias("rid"))
    want = {r["rid"] for r in made.distinct().collect()}
    got = {r["rid"]: r["y"] for r in rows.collect()}
    assert {0.0, 1.0} == set(got.values()) and all(y == (rid in want) for rid, y in got.items())


def test_curve_predicts_once(spark, monkeypatch):
    """What the scores read, several times over, are stored predictions."""
    seen, scores = [], md.scores
    monkeypatch.setattr(md, "scores", lambda pred, keys: seen.append(pred) or scores(pred, keys))
    df = md.assemble(spark.range(60).select("id", (F.col("id") % 2).cast("double").alias("y"), F.rand(1).alias("a")), ["a"])
    assert md.learning_curve(df, ["id"], md.logistic, (0.5, 1.0), 2, 3).count() == 2
    plan = seen[0]._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Scan ExistingRDD" in plan and "Join" not in plan and "Generate" not in plan


def test_fits_read_their_rows_once(spark):
    """However many passes the models take, over batches that hold every row and model once."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    src = spark.range(0, 500, 1, 3).select("id", F.randn(1).alias("a"), F.randn(2).alias("b"), (F.rand(3) < 0.4).cast("double").alias("y")).localCheckpoint()
    rows = md.assemble(src.mapInPandas(counted, src.schema), ["a", "b"]).withColumn("t", F.array((F.col("id") % 3).cast("int"), F.lit(3)))
    fitted = gf.grouped_logistic(rows, "t", 4)
    assert read.value == 500 and fitted.count() == 4
    batches = gf.bundled(rows.select(F.array("a", "b").alias("_x"), F.col("y").alias("_y"), F.col("t").alias("_models"))).drop("n", "total")
    got = gf.sums(batches, {0, 1, 3}, lambda m, x, y: np.array([len(y), y.sum(), *x.sum(0)]))
    for m, v in got.items():
        r = src.filter("true" if m == 3 else f"id % 3 = {m}").agg(F.count("*"), F.sum("y"), F.sum("a"), F.sum("b")).first()
        assert np.allclose(v, list(r))
    assert got.keys() == {0, 1, 3}
