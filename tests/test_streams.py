"""Streaming runs against the batch result, for tables of one file and of many, and folds."""

from pyspark.sql import functions as F

from flightline.operators import models as md
from flightline.plans.stream_queries import event_table
from flightline.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


def test_streams_do_not_depend_on_files(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/events.parquet").repartition(40).write.parquet(f"{tmp_path}/events.parquet")
    mark = event_table(spark, FOLDER).agg(F.max("ts") - F.expr("INTERVAL 1 DAY")).first()[0]
    for make in (lambda d: jobs.session_events(d, "user_id", "6 hours", "1 day"), lambda d: jobs.window_counts(d, "event_type", "6 hours", "3 hours", "1 day")):
        whole = {tuple(r) for r in make(event_table(spark, FOLDER)).collect()}
        closed = {r for r in whole if r[2] <= mark}  # what lies behind the last watermark stays open in a stream
        for folder in (FOLDER, str(tmp_path)):
            got = [tuple(r) for r in jobs.run_to_table(make(jobs.read_events(spark, folder)), "t").collect()]
            assert len(got) == len(set(got)) and set(got) == closed
    assert event_table(spark, str(tmp_path)).count() == event_table(spark, FOLDER).count()


def test_folds_are_stratified(spark):
    rows = spark.range(1003).withColumn("y", (F.col("id") % 7 == 0).cast("double"))
    n = {(r["y"], r["fold"]): r["count"] for r in md.folds(rows, ["id"], 5).groupBy("y", "fold").count().collect()}
    for y in (0.0, 1.0):
        sizes = [n[y, k] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    assert sum(n.values()) == 1003


def test_streaming_tracks_equal_the_batch_tracker(spark, tmp_path):
    """Flushed at the end of the input, in one run or stopped and taken up again; before the end only closed frames count."""
    from flightline.operators.tracking import build_tracks
    from flightline.plans.catalog import QUERIES
    from flightline.plans.stream_queries import sightings
    from flightline.plans.track_queries import FAST, FRAMES, RADIUS
    hour = 3_600_000
    d = sightings(event_table(spark, FOLDER)).withColumn("radius", F.lit(RADIUS))
    links = lambda rows: {tuple(r) for r in build_tracks(rows, FRAMES, FAST).select("video", "seq", "track_id").collect()}
    want = links(d)
    got = [tuple(r) for r in QUERIES["t02_streaming_tracks"](spark, FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # half of the time first, then the rest, then the end
    table, home = f"{tmp_path}/events.parquet", str(tmp_path / "home")
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    middle = events.agg(F.expr("timestamp_micros(cast((min(unix_micros(cast(ts AS timestamp))) + max(unix_micros(cast(ts AS timestamp)))) / 2 AS bigint))")).first()[0]
    early = F.col("ts").cast("timestamp") < F.lit(middle)
    run = lambda end: {tuple(r) for r in jobs.run_tracks(sightings(jobs.read_events(spark, str(tmp_path))), RADIUS, "2 hours", FAST, hour, home, end).collect()}
    events.filter(early).write.parquet(table)
    part = run(False)
    newest = events.filter(early).agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0]
    closed = d.filter((F.col("frame") + 1) * hour <= newest - 2 * hour)
    assert part == links(closed)
    events.filter(~early).write.mode("append").parquet(table)
    assert run(False) >= part
    assert run(True) == want


class Lists:
    """A state handle that keeps lists and timers in memory."""

    def __init__(self):
        self.lists, self.timers = {}, set()

    def getListState(self, name, kind):
        lists = self.lists

        class One:
            exists = staticmethod(lambda: bool(lists.get(name)))
            get = staticmethod(lambda: iter(lists.get(name, [])))
            put = staticmethod(lambda rows: lists.__setitem__(name, list(rows)))
            appendList = staticmethod(lambda rows: lists.setdefault(name, []).extend(rows))
            clear = staticmethod(lambda: lists.pop(name, None))

        return One

    listTimers = lambda self: iter(set(self.timers))
    registerTimer = lambda self, t: self.timers.add(t)
    deleteTimer = lambda self, t: self.timers.discard(t)


def test_tracks_leave_the_state(spark):
    """Single sightings far apart: each opens a track that is soon missed too often; the state holds the last few only, however long the stream."""
    from types import SimpleNamespace

    import pandas as pd

    from flightline.operators.tracking import Tracker
    p, handle = Tracker(max_miss=3, min_track=2), Lists()
    one = jobs.TrackProcessor(50.0, p)
    one.init(handle)
    told, most = [], 0
    for frame in range(400):
        far_off = [(frame, 2 * frame, 5000.0 * (frame % 50), 0.0, 0.5, frame + 1), (frame, 2 * frame + 1, 7.0, -9000.0 - frame % 3, 0.5, frame + 1)]
        rows = pd.DataFrame(far_off, columns=["frame", "seq", "x", "y", "conf", "closes_ms"])
        list(one.handleInputRows(("v",), iter([rows]), None))
        while any(t <= frame for t in handle.timers):
            handle.timers -= {t for t in handle.timers if t <= frame}
            told += [tuple(r) for out in one.handleExpiredTimer(("v",), SimpleNamespace(getCurrentWatermarkInMs=lambda: frame), None) for r in out.itertuples(index=False)]
        most = max(most, sum(len(v) for v in handle.lists.values()))
    assert most <= 2 * (p.max_miss + 2) + 4
    assert told == [("v", 2 * f + 1, 1) for f in range(399)]
