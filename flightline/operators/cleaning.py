"""Cleaning detections: parked objects, duplicate boxes, windows of interest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightline.functions.geometry import dist


def cell(df: DataFrame, size: float) -> DataFrame:
    return df.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})


def parked_cells(df: DataFrame, keys: Sequence[str], frame: str = "frame", size: float = 40, frac: float = 0.25,
                 frames: DataFrame | None = None) -> DataFrame:
    """Grid cells holding a detection in more than ``frac`` of the frames.

    Frames are those with a detection, or all rows of ``frames`` (keys, frame) when given.  Distinct frames are
    counted after a distinct, so a hot key spreads over its cells and frames.
    """
    k = list(keys)
    seen = cell(df, size).select(*k, "cx", "cy", frame).distinct().groupBy(*k, "cx", "cy").agg(F.count("*").alias("seen"))
    source = df if frames is None else frames
    total = source.select(*k, frame).distinct().groupBy(*k).agg(F.count("*").alias("total"))
    return seen.join(total, k).filter(F.col("seen") > F.lit(frac) * F.col("total"))


def drop_parked(df: DataFrame, keys: Sequence[str], frame: str = "frame", size: float = 40, frac: float = 0.25,
                frames: DataFrame | None = None) -> DataFrame:
    dead = parked_cells(df, keys, frame, size, frac, frames).select(*keys, "cx", "cy")
    return cell(df, size).join(dead, [*keys, "cx", "cy"], "left_anti").drop("cx", "cy")


def best_per_frame(df: DataFrame, keys: Sequence[str], order: Sequence[str], frame: str = "frame", conf: str = "conf") -> DataFrame:
    """The most confident detection of each frame, the first in ``order`` on a tie."""
    cols = [c for c in df.columns if c not in (*keys, frame)]
    best = df.groupBy(*keys, frame).agg(F.min_by(F.struct(*cols), F.struct((-F.col(conf)).alias("_c"), *order)).alias("_b"))
    return best.select(*keys, frame, "_b.*")


def moving_ball(df: DataFrame, frames: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Parked cells of 45 px over *all* frames dropped, then one detection per frame."""
    return best_per_frame(drop_parked(df, keys, size=45, frames=frames), keys, order)


def suppress(df: DataFrame, group: Sequence[str], order: Sequence[Column], clash, columns: Sequence[str]) -> DataFrame:
    """Keep boxes in ``order``, dropping one that ``clash(candidate, kept)`` with any box already kept.

    A group is one picture or instant, whose boxes fit in one array.
    """
    entry = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*columns).alias("b"))
    packed = df.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    boxes = F.transform("_all", lambda e: e["b"])
    empty = F.filter(boxes, lambda _: F.lit(False))
    kept = F.aggregate(boxes, empty, lambda acc, c: F.when(
        F.exists(acc, lambda k: clash(c, k)), acc).otherwise(F.array_append(acc, c)))
    return packed.select(*group, F.explode(kept).alias("_k")).select(*group, "_k.*")


def one_box_per_ball(df: DataFrame, keys: Sequence[str], seq: str, reach: float = 1.2, t: str = "t") -> DataFrame:
    """Merge the boxes of one ball in one instant: a box nearer than ``reach`` of its own widths to a kept one goes."""
    def clash(c: Column, k: Column) -> Column:
        return dist(c["x"], c["y"], k["x"], k["y"]) < reach * F.greatest(F.lit(1.0), F.coalesce(c["w"], F.lit(60.0)))

    rows = df.withColumn("_t", F.bround(t, 3))
    cols = [c for c in df.columns if c not in keys]
    return suppress(rows, [*keys, "_t"], [-F.col("conf"), F.col(seq)], clash, cols).drop("_t")


def overlap_suppression(df: DataFrame, frame: Sequence[str], order: Sequence[Column], share: float, columns: Sequence[str]) -> DataFrame:
    """Drop a box sharing more than ``share`` of the smaller area with a kept one, or with a centre inside the other."""
    def clash(c: Column, k: Column) -> Column:
        w = F.least(c["x2"], k["x2"]) - F.greatest(c["x1"], k["x1"])
        h = F.least(c["y2"], k["y2"]) - F.greatest(c["y1"], k["y1"])
        inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
        small = F.least((c["x2"] - c["x1"]) * (c["y2"] - c["y1"]), (k["x2"] - k["x1"]) * (k["y2"] - k["y1"]))
        mid = lambda a, b: ((a["x1"] + a["x2"]) / 2).between(b["x1"], b["x2"]) & ((a["y1"] + a["y2"]) / 2).between(b["y1"], b["y2"])
        return (inter > share * F.greatest(small, F.lit(1e-9))) | mid(c, k) | mid(k, c)

    return suppress(df, frame, order, clash, columns)


def default_end(t: Column, t_end: Column, length: float = 1.4) -> Column:
    return F.when(t_end > t, t_end).otherwise(t + length)


def within_horizon(t: Column, until: Column) -> Column:
    """True up to the recording's attribution limit; no limit when it is null."""
    return until.isNull() | (t <= until)


def identity_transfer(boxes: DataFrame, picks: DataFrame, frame: Sequence[str], min_share: float) -> DataFrame:
    """Give each pick's id to the box it overlaps most (share of the smaller area); picks on nothing are appended."""
    side = ["x1", "y1", "x2", "y2"]
    p = picks.select(*frame, "pid", *[F.col(c).alias(f"p{c}") for c in side])
    j = boxes.join(p, list(frame))
    w = F.least(F.col("x2"), F.col("px2")) - F.greatest(F.col("x1"), F.col("px1"))
    h = F.least(F.col("y2"), F.col("py2")) - F.greatest(F.col("y1"), F.col("py1"))
    small = F.least((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), (F.col("px2") - F.col("px1")) * (F.col("py2") - F.col("py1")))
    share = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)) / F.greatest(small, F.lit(1e-9))
    best = j.withColumn("share", share).filter(F.col("share") > min_share).groupBy(*frame, "pid").agg(
        F.min(F.struct((-F.col("share")).alias("s"), F.col("bid"))).alias("_b")).select(*frame, "pid", F.col("_b.bid").alias("bid"))
    owner = best.groupBy(*frame, "bid").agg(F.min("pid").alias("pid"))
    named = boxes.join(owner, [*frame, "bid"], "left").select(*frame, "bid", "pid", *side)
    lone = picks.join(best, [*frame, "pid"], "left_anti").select(*frame, F.lit(None).cast("long").alias("bid"), "pid", *side)
    return named.unionByName(lone)
