"""From runs to events: the gate cascade, the merges, the approach gate and the clip windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightline.functions import clock
from flightline.functions.geometry import dilate, dist, inside_polygon
from flightline.operators.blocks import Series, islands, neighbours, running, scan_blocks
from flightline.operators.joins import point_in_interval
from flightline.runtime import cut


@dataclass(frozen=True)
class Gates:
    """Thresholds of the cascade; the defaults are the published values (fixed values)."""

    min_dets: int = 3
    carry_lo: int = 5
    carry_hi: int = 20
    peak_fall: float = 1200.0
    fps_cap: float = 1.2
    max_dt: float = 0.2
    base_fps: float = 60.0
    lookback: float = 1.2
    min_drop: float = 250.0
    end_near: float = 3.2
    ring_near: float = 0.6
    ring_fall: float = 450.0
    zone_grow: float = 2.0
    bounce_gap: float = 0.7
    near_merge: float = 2.5
    approach: float = 0.40
    carry_approach: float = 0.10
    at_rim: float = 0.8
    strong_conf: float = 0.85
    strong_fall: float = 290.0
    lead: float = 1.2
    tail: float = 2.2
    neighbour_pad: float = 0.35
    min_lead: float = 0.3
    min_tail: float = 1.5

    def but(self, **changes) -> Gates:
        return replace(self, **changes)


def carried(n: Column, g: Gates) -> Column:
    return n.between(g.carry_lo, g.carry_hi)


def frame_scale(df: DataFrame, s: Series, g: Gates) -> DataFrame:
    """Per key the frame interval relative to the base rate: least step between distinct times under ``max_dt``."""
    rows = neighbours(df.select(*s.keys, *s.order), s, {"_p": (s.time, -1)})
    step = F.col(s.time) - F.col("_p")
    least = F.min(F.when((step > 0) & (step < F.lit(g.max_dt)), step))
    return rows.groupBy(*s.keys).agg(least.alias("frame_dt")).withColumn(
        "scale", F.coalesce(F.col("frame_dt") * F.lit(g.base_fps), F.lit(1.0)))


def match_radius(scale: Column, base: float = 150.0, cap: float = 1.5) -> Column:
    return F.lit(base) * F.greatest(F.lit(1.0), F.least(F.lit(cap), scale))


def over_site(runs: DataFrame, s: Series, g: Gates) -> DataFrame:
    """Marked points of a series of whole keys with ``_top`` and ``_scale``, by frames over their site; rows without a key or time have no top.

    Rows of a run follow each other, so what their frames of ``lookback`` reach is what lies between the run's start less ``lookback`` and its end.
    """
    site = ", ".join(f"`{k}`" for k in s.keys)
    top = F.expr(f"min(`y`) OVER (PARTITION BY {site} ORDER BY `{s.time}` RANGE BETWEEN CAST({float(g.lookback)!r} AS DOUBLE) PRECEDING AND CURRENT ROW)")
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*s.keys, s.time)])
    rows = neighbours(runs, s, {"_p": (s.time, -1)})
    step = F.col(s.time) - F.col("_p")
    least = F.min(F.when((step > 0) & (step < F.lit(g.max_dt)), step)).over(Window.partitionBy(*s.keys))
    return rows.withColumns({"_top": F.when(known, top), "_scale": F.coalesce(least * F.lit(g.base_fps), F.lit(1.0))}).drop("_p")


def run_features(runs: DataFrame, s: Series, g: Gates, zone: Sequence[tuple[Column, Column]] | None = None) -> DataFrame:
    """Everything the gates look at, one row per run.  ``runs`` carries rim columns x1, y1, x2, y2 and run_id; after :func:`over_site` also top and scale."""
    rcx, rcy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    rw = F.greatest(F.lit(1.0), F.col("x2") - F.col("x1"))
    order = F.struct(*s.order)
    gap = F.col(s.time) - F.col("prev_t")
    # prev_* are null at the first point of a run, so no speed is measured across runs
    speed = F.when(gap > 0, (F.col("y") - F.col("prev_y")) / gap)
    hit_zone = inside_polygon(dilate(zone, g.zone_grow), F.col("x"), F.col("y")) if zone else F.lit(False)
    d = dist(F.col("x"), F.col("y"), rcx, rcy)
    # nearest of this point and the two before it in the run; read off at the run's last point
    tail = F.least(d, dist(F.col("prev_x"), F.col("prev_y"), rcx, rcy), dist(F.col("prev2_x"), F.col("prev2_y"), rcx, rcy))
    rows = runs.withColumns({"_d": d, "_rw": rw, "_in": hit_zone, "_v": speed, "_tail": tail})
    told = [F.min(c).alias(c[1:]) for c in ("_top", "_scale", "_need") if c in runs.columns]
    agg = rows.groupBy(*s.keys, "run_id").agg(
        F.count("*").alias("n"), F.min(s.time).alias("t0"), F.max(s.time).alias("t1"), F.min_by(s.seq, order).alias("seq0"),
        F.min_by("y", order).alias("y0"), F.max_by("y", order).alias("y1"), F.min("y").alias("y_min"),
        F.max("y").alias("y_max"), F.max("_v").alias("peak_speed"), F.min_by("_d", order).alias("d0"),
        F.min("_d").alias("d_min"), F.max("_rw").alias("rw"), F.max("conf").alias("peak_conf"),
        F.bool_or("_in").alias("in_zone"), F.max_by("_tail", order).alias("_near"), *told)
    return agg.withColumns({
        "end_near": F.col("_near") / F.col("rw"),
        "through_ring": (F.col("d_min") / F.col("rw") <= g.ring_near) & (F.col("y_max") - F.col("y_min") >= g.ring_fall),
    }).drop("_near")


def mark_runs(points: DataFrame, s: Series, max_gap: float, jitter: float) -> DataFrame:
    """Descent runs with what the features need: up to two earlier points of the same run beside each point."""
    rows = neighbours(points, s, {"_t1": (s.time, -1), "_y1": ("y", -1), "_x1": ("x", -1),
                                  "_t2": (s.time, -2), "_y2": ("y", -2), "_x2": ("x", -2)})

    def breaks(t0: Column, y0: Column, t1: Column, y1: Column) -> Column:
        return t0.isNull() | (t1 - t0 > F.lit(max_gap)) | (y1 < y0 - F.lit(jitter))

    starts = breaks(F.col("_t1"), F.col("_y1"), F.col(s.time), F.col("y"))
    before = starts | breaks(F.col("_t2"), F.col("_y2"), F.col("_t1"), F.col("_y1"))
    rows = rows.withColumns({
        "prev_t": F.when(~starts, F.col("_t1")), "prev_y": F.when(~starts, F.col("_y1")),
        "prev_x": F.when(~starts, F.col("_x1")), "prev2_y": F.when(~before, F.col("_y2")),
        "prev2_x": F.when(~before, F.col("_x2"))})
    return islands(rows, s, F.col("prev_t").isNull(), "run_id").drop("_t1", "_y1", "_x1", "_t2", "_y2", "_x2")


def add_window_top(features: DataFrame, hits: DataFrame, s: Series, g: Gates, width: float) -> DataFrame:
    """Highest sighting of the whole site from ``lookback`` before the run's start to its end."""
    features = cut(features)  # one row per run; both sides of the join below start from it
    spans = features.select(*s.keys, "run_id", (F.col("t0") - g.lookback).alias("_lo"), F.col("t1").alias("_hi"))
    slim = hits.select(*s.keys, s.time, "y")
    top = point_in_interval(slim, spans, s.keys, s.time, "_lo", "_hi", width).groupBy(*s.keys, "run_id").agg(
        F.min("y").alias("top"))
    return features.join(top, [*s.keys, "run_id"], "left")


def gate_runs(features: DataFrame, g: Gates) -> DataFrame:
    """Add ``reason``: the first gate a run fails, null when it passes them all."""
    carry = carried(F.col("n"), g)
    drop = F.col("y1") - F.col("y0")
    fell = F.greatest(drop, F.col("y1") - F.coalesce(F.col("top"), F.col("y0")))
    scale = F.col("scale") if "scale" in features.columns else F.lit(1.0)
    floor = F.lit(g.peak_fall) / F.greatest(F.lit(1.0), F.least(F.lit(g.fps_cap), scale))
    through = F.col("through_ring") | F.col("in_zone")
    reason = (F.when((F.col("n") < g.min_dets) & ~carry, "too few detections")
              .when(F.coalesce(F.col("peak_speed") < floor, F.lit(True)), "never fell at the speed of a dropped ball")
              .when((fell < g.min_drop) & ~carry, "did not fall far enough")
              .when((F.col("end_near") > g.end_near) & ~through, "ended too far from the rim"))
    return features.withColumns({"fell": fell, "reason": reason})


EVENT_STATS = ("n", "t0", "t1", "seq0", "d0", "d_min", "rw", "peak_conf", "y_min", "y_max")


def _merge(df: DataFrame, by: Sequence[str], end: Column) -> DataFrame:
    order = F.struct("t0", "seq0")
    return df.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("t0").alias("t0"), end.alias("t1"), F.min_by("seq0", order).alias("seq0"),
        F.min_by("d0", order).alias("d0"), F.min("d_min").alias("d_min"), F.max("rw").alias("rw"),
        F.max("peak_conf").alias("peak_conf"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"))


def bounce_merge(kept: DataFrame, keys: Sequence[str], gap: float, width: float, whole: bool = False) -> DataFrame:
    """Join runs of one track whose pause, end to start, is at most ``gap``: a plain chain.  ``whole``: no key is long (see :func:`settled`)."""
    kept = kept if whole else cut(kept)  # few rows by now, and read several times below
    s = Series(tuple(keys), "t0", "seq0", width, "_rb", whole)
    rows = neighbours(kept, s, {"_pend": ("t1", -1)})
    rows = islands(rows, s, F.col("_pend").isNull() | (F.col("t0") - F.col("_pend") > F.lit(gap)), "event_id")
    return _merge(rows, [*keys, "event_id"], F.max_by("t1", F.struct("t0", "seq0")))


def merge_pairs(kept: DataFrame, keys: Sequence[str], gap: float, width: float, whole: bool = False) -> DataFrame:
    """The joins bounce_merge makes, with the pause and how far the ball climbed in between."""
    s = Series(tuple(keys), "t0", "seq0", width, "_rb", whole)
    rows = neighbours(kept, s, {"prev_end": ("t1", -1), "prev_y_end": ("y1", -1)})
    pause = F.col("t0") - F.col("prev_end")
    return rows.filter(pause <= F.lit(gap)).select(
        *keys, "run_id", F.col("t0"), "prev_end", pause.alias("pause"), (F.col("prev_y_end") - F.col("y0")).alias("rise"))


def near_merge(events: DataFrame, video: Sequence[str], site: str, near: float, width: float) -> DataFrame:
    """Join calls of one site that start close to, or overlap, the *last* event over all sites.

    Compared with the event's first start, which never moves, so an event cannot grow step by step; a call at
    another site in between ends it.  Returns the events with ``merged_id`` (time and seq of the anchor).
    """
    events = cut(events)
    s = Series(tuple(video), "t0", "seq0", width, "_mb")
    slim = events.select(*video, site, "t0", "t1", "seq0")

    def step(rows, last):
        out = []
        for v_site, t0, t1, q in zip(*[rows[c].tolist() for c in (site, "t0", "t1", "seq0")]):
            if last is not None and last[0] == v_site and t0 - last[1] <= near:
                last = [v_site, last[1], float(t1), last[3]]
            elif last is not None and last[0] == v_site and t0 <= last[2]:
                last = [v_site, last[1], max(last[2], float(t1)), last[3]]
            else:
                last = [v_site, float(t0), float(t1), int(q)]
            out.append((last[3], last[1], last[2]))
        return (range(len(out)), dict(zip(("merged_id", "anchor_t", "end_so_far"), zip(*out)))), last

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*video, "seq0")) + ", merged_id long, anchor_t double, end_so_far double"
    return events.join(scan_blocks(slim, s, step, schema, arrays=True), [*video, "seq0"])


def merge_events(events: DataFrame, video: Sequence[str], site: str, near: float, width: float) -> DataFrame:
    tagged = near_merge(events, video, site, near, width)
    return _merge(tagged, [*video, site, "merged_id"], F.max_by("end_so_far", F.struct("t0", "seq0")))


def approach_gate(events: DataFrame, g: Gates) -> DataFrame:
    """Add ``closed``, ``nearest`` (in rim widths) and ``at_hoop``: did the ball go at the hoop?"""
    closed = (F.col("d0") - F.col("d_min")) / F.greatest(F.lit(1.0), F.col("d0"))
    bar = F.when(carried(F.col("n"), g), g.carry_approach).otherwise(g.approach)
    strong = (F.col("peak_conf") >= g.strong_conf) & (F.col("y_max") - F.col("y_min") >= g.strong_fall)
    return events.withColumns({
        "closed": closed, "nearest": F.col("d_min") / F.col("rw"),
        "at_hoop": (closed >= bar) | (F.col("d_min") <= g.at_rim * F.col("rw")) | strong})


def event_windows(events: DataFrame, keys: Sequence[str], g: Gates, width: float, whole: bool = False) -> DataFrame:
    """Clip bounds: trimmed against neighbours of the same site, the outcome always kept on screen."""
    events = events if whole else cut(events)
    s = Series(tuple(keys), "t0", "seq0", width, "_wb", whole)
    rows = neighbours(events, s, {"_pend": ("t1", -1), "_next": ("t0", 1)})
    t0, t1 = F.col("t0"), F.col("t1")
    start = F.greatest(t0 - g.lead, F.col("_pend") + g.neighbour_pad)  # greatest skips nulls
    stop = F.least(t1 + g.tail, F.col("_next") - g.neighbour_pad)
    return rows.withColumns({
        "clip_start": F.greatest(F.lit(0.0), F.least(start, t0 - g.min_lead)),
        "clip_stop": F.greatest(stop, t1 + g.min_tail)}).drop("_pend", "_next")


def event_index(events: DataFrame, video: Sequence[str], site: str, width: float, whole: bool = False) -> DataFrame:
    """The published rows: numbered per recording in time order."""
    events = events if whole else cut(events)
    s = Series(tuple(video), "t0", "seq0", width, "_ib", whole)
    rows = running(events, s, {"_n": ("sum", F.lit(1).cast("long"))})
    return rows.select(
        *video, F.col("_n").alias("n"), F.col(site), F.round("t0", 2).alias("t"), F.round("t1", 2).alias("t_end"),
        F.round("clip_start", 2).alias("clip_start"), F.round("clip_stop", 2).alias("clip_stop"),
        clock.format_clock(F.col("t0")).alias("clock"), F.col("n").alias("dets"),
        F.round("peak_conf", 3).alias("peak_conf"))


def free_fall(min_points: int = 6, min_span: float = 0.25, min_curve: float = 40.0,
              min_speed: float = 500.0) -> Column:
    """Free-fall test on a fit joined with ``max_speed``; off by default in the cascade."""
    return ((F.col("n") >= min_points) & (F.col("t1") - F.col("t0") >= min_span)
            & F.coalesce(F.col("a") >= min_curve, F.lit(False)) & F.coalesce(F.col("max_speed") >= min_speed, F.lit(False)))
