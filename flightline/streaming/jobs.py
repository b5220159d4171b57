"""Streaming twins of the batch operators, written to a table by an ``availableNow`` run or a long-lived one."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from flightline.operators.tracking import Tracker, advance_tracks
from flightline.runtime import workspace


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table, one file or a folder of them, as a stream of detections with an event-time column.

    What is there at the start is one batch, so the number of files does not decide which rows count as late.
    """
    path = f"{folder}/events.parquet"
    table = spark.read.parquet(path)
    one = table.select("_metadata.file_path").first()
    stream = spark.readStream.schema(table.schema)
    # a stream's path is a folder: that of the table, or the one the table's single file lies in
    single = one is not None and one[0].endswith("/events.parquet")
    raw = stream.option("pathGlobFilter", "events.parquet").parquet(folder) if single else stream.parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Process everything available, append it to a parquet table, and return that table."""
    spark = stream.sparkSession
    out = out or workspace(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", checkpoint or workspace(spark, f"{name}-state")).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def session_events(stream: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    """Bursts of one key: a new event after ``gap`` of silence."""
    return (stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key)
            .agg(F.count("*").alias("n"), F.max("value").alias("peak")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "peak"))


def window_counts(stream: DataFrame, key: str, size: str, slide: str, delay: str) -> DataFrame:
    """Sightings per key and (sliding) window; rows later than ``delay`` are dropped."""
    return (stream.withWatermark("ts", delay).groupBy(F.window("ts", size, slide).alias("w"), key).agg(F.count("*").alias("n"))
            .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n"))


def first_per_key(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Drop repeats of a key arriving within the watermark: the streaming form of an idempotent append."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def config_key(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def guarded_scan(stream: DataFrame, base: str, config: dict) -> DataFrame:
    """Resume a scan only under the very same settings: output and progress live in a folder named after them."""
    home = f"{base}/{config_key(config)}"
    return run_to_table(stream, "scan", f"{home}/progress", f"{home}/rows")


LINKS = "video long, seq long, track_id long"
OPEN = "id long, frame long, x double, y double, vx double, vy double, missed long"
WAITING = "frame long, seq long, x double, y double, conf double, closes_ms long"
SHORT = "id long, seq long"


class TrackProcessor(StatefulProcessor):
    """The tracker of one recording: its open tracks, the sightings of frames that may still grow, and the points of tracks still too short to tell.

    A frame is used once the watermark has passed its end, by a timer, so rows out of order within the delay land in their frame.  Tracks missed more
    than ``max_miss`` times leave the state with all they held, so it never outgrows the open tracks and the frames within the delay.
    """

    def __init__(self, radius: float, params: Tracker):
        self.radius, self.params = radius, params
        self.kinds = {name: StructType.fromDDL(ddl) for name, ddl in (("tracks", OPEN), ("waiting", WAITING), ("short", SHORT))}  # tasks cannot parse DDL

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks, self.waiting, self.short = (handle.getListState(name, kind) for name, kind in self.kinds.items())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for batch in rows if key[0] is not None else ():  # the row that ends the input only moves the watermark
            fresh += list(batch[["frame", "seq", "x", "y", "conf", "closes_ms"]].itertuples(index=False, name=None))
        if not fresh:
            return
        self.waiting.appendList(fresh)
        soonest, planned = min(w[5] for w in fresh), list(self.handle.listTimers())
        if not planned or soonest < min(planned):
            for t in planned:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(soonest)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready, later = sorted((w for w in held if w[5] <= mark), key=lambda w: (w[0], -w[4], w[1])), [w for w in held if w[5] > mark]
        frames: dict[int, list] = {}
        for frame, seq, x, y, conf, _ in ready:
            frames.setdefault(int(frame), []).append((int(seq), x, y, conf))
        before = [list(t) for t in self.tracks.get()] if self.tracks.exists() else []
        links, after = advance_tracks(frames.items(), before, self.radius, self.params)
        points: dict[int, list[int]] = {}
        for track, seq in self.short.get() if self.short.exists() else ():
            points.setdefault(int(track), []).append(int(seq))
        told = []
        for seq, track in links:
            if track == seq:
                points[track] = []
            if track not in points:
                told.append((seq, track))
                continue
            points[track].append(seq)
            if len(points[track]) >= self.params.min_track:
                told += [(q, track) for q in points.pop(track)]
        live = {int(t[0]) for t in after}
        for state, rows in ((self.waiting, later), (self.tracks, [(int(t[0]), int(t[1]), *map(float, t[2:6]), int(t[6])) for t in after]),
                            (self.short, [(t, q) for t, seqs in points.items() if t in live for q in seqs])):
            if rows:
                state.put(rows)
            else:
                state.clear()
        if later:
            self.handle.registerTimer(min(w[5] for w in later))
        yield pd.DataFrame([(key[0], q, t) for q, t in told], columns=["video", "seq", "track_id"])

    def close(self) -> None:
        pass


def stream_tracks(stream: DataFrame, radius: float, delay: str, params: Tracker | None = None, frame_ms: int = 1) -> DataFrame:
    """Tracks as (video, seq, track_id), sent out when a track has ``min_track`` points; ``frame_ms`` is how much event time one frame covers.

    Runs on the RocksDB state store (:func:`run_tracks` sets it).  Frames that end after the last watermark wait for more rows.
    """
    closes = (F.floor(F.unix_millis("ts") / frame_ms) + 1) * frame_ms
    rows = stream.withColumn("closes_ms", closes).select("video", "ts", "frame", "seq", F.col("x").cast("double"), F.col("y").cast("double"), F.col("conf").cast("double"), "closes_ms")
    return (rows.withWatermark("ts", delay).groupBy("video")
            .transformWithStateInPandas(TrackProcessor(radius, params or Tracker()), StructType.fromDDL(LINKS), "Append", "EventTime"))


STORE = "spark.sql.streaming.stateStore.providerClass"


def run_tracks(stream: DataFrame, radius: float, delay: str, params: Tracker | None = None, frame_ms: int = 1, home: str | None = None, finish: bool = True) -> DataFrame:
    """Run the tracker over all that is there and return its table; ``finish`` says that no more will come, so the frames still waiting are used too.

    Progress, state and links live in the folder ``home``, so a later call goes on where this one stopped.  The end is a row of no recording,
    as late as a nanosecond clock can tell, which moves the watermark past every frame; rows without a recording are left out.
    """
    spark = stream.sparkSession
    home = home or workspace(spark, "tracks")
    columns = stream.select("video", "ts", "frame", "seq", "x", "y", "conf")
    ends = f"{home}/ends"
    spark.createDataFrame([], columns.schema).write.mode("append").parquet(ends)
    whole = columns.unionByName(spark.readStream.schema(columns.schema).parquet(ends))
    had = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        links = stream_tracks(whole, radius, delay, params, frame_ms)
        out = run_to_table(links, "tracks", f"{home}/progress", f"{home}/rows")
        if finish:
            mark = spark.sql("SELECT timestamp'2262-01-01' AS ts")
            missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in columns.schema if f.name != "ts"]
            mark.select("ts", *missing).select(*columns.columns).write.mode("append").parquet(ends)
            out = run_to_table(links, "tracks", f"{home}/progress", f"{home}/rows")
    finally:
        spark.conf.set(STORE, had)
    return out.filter(F.col("video").isNotNull())
