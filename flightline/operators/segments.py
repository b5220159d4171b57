"""Cutting series into runs, descents, stretches and streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightline.operators.blocks import HALO, Series, drop_halo, gap_flag, islands, neighbours, packed, running, with_halo
from flightline.operators.joins import nearest_within, point_in_interval
from flightline.operators.transfers import spaced_rows

EPS = 1e-9  # means of the same points summed in another order are equal


def descent_runs(df: DataFrame, s: Series, y: str = "y", max_gap: float = 0.6, jitter: float = 25.0) -> DataFrame:
    """Number the falling stretches: a run ends at a blackout or when y rises by more than the jitter.

    Image y grows downward, so falling means y does not get smaller.
    """
    rows = neighbours(df, s, {"prev_t": (s.time, -1), "prev_y": (y, -1)})
    starts = gap_flag("prev_t", s.time, max_gap) | (F.col(y) < F.col("prev_y") - F.lit(jitter))
    return islands(rows, s, starts, "run_id")


def run_summary(runs: DataFrame, s: Series, y: str = "y", extra: Sequence[Column] = ()) -> DataFrame:
    """One row per run: size, end points and range, plus any further aggregates given."""
    order = F.struct(*s.order)
    return runs.groupBy(*s.keys, "run_id").agg(
        F.count("*").alias("n"), F.min(s.time).alias("t0"), F.max(s.time).alias("t1"),
        F.min_by(y, order).alias("y0"), F.max_by(y, order).alias("y1"), F.min(y).alias("y_min"), F.max(y).alias("y_max"),
        *extra)


def descents(summary: DataFrame, min_points: int = 3, min_drop: float = 250.0) -> DataFrame:
    return summary.filter((F.col("n") >= min_points) & (F.col("y1") - F.col("y0") >= F.lit(min_drop)))


def anchor_descent(labels: DataFrame, found: DataFrame, keys: Sequence[str], label_id: Sequence[str], t: str,
                   reach: float = 1.0) -> DataFrame:
    """The descent whose start is nearest each label, none when it is further than ``reach`` away."""
    return nearest_within(labels, found, keys, label_id, t, "t0", reach, ["t0", "run_id"])


def whole_flight(descent_points: DataFrame, track_points: DataFrame, keys: Sequence[str], lead: float = 2.0,
                 tail: float = 1.5, width: float = 10.0) -> DataFrame:
    """Per descent the part of its track around it, or the descent itself when that part is shorter.

    ``descent_points``: keys, run_id, frame, x, t; ``track_points``: keys, track_id, frame, x, t.  A track
    belongs to a descent when they share a sighting; the lowest track id is taken.
    """
    mine = descent_points.groupBy(*keys, "run_id").agg(
        F.count("*").alias("n_descent"), F.min("t").alias("d0"), F.max("t").alias("d1"))
    point = [*keys, "frame", "_x"]
    a = descent_points.select(*keys, "run_id", "frame", F.bround("x", 1).alias("_x")).distinct()
    b = track_points.select(*keys, "track_id", "frame", F.bround("x", 1).alias("_x")).distinct()
    owner = a.join(b, point).groupBy(*keys, "run_id").agg(F.min("track_id").alias("track_id"))
    spans = mine.join(owner, [*keys, "run_id"]).select(
        *keys, "run_id", "track_id", (F.col("d0") - lead).alias("_lo"), (F.col("d1") + tail).alias("_hi"))
    inside = point_in_interval(track_points, spans, [*keys, "track_id"], "t", "_lo", "_hi", width)
    flight = inside.groupBy(*keys, "run_id").agg(
        F.count("*").alias("n_span"), F.min("t").alias("f0"), F.max("t").alias("f1"))
    whole = F.coalesce(F.col("n_span") >= F.col("n_descent"), F.lit(False))
    return mine.join(flight, [*keys, "run_id"], "left").select(
        *keys, "run_id", whole.alias("whole"), F.when(whole, F.col("n_span")).otherwise(F.col("n_descent")).alias("n_flight"),
        F.when(whole, F.col("f0")).otherwise(F.col("d0")).alias("flight_t0"),
        F.when(whole, F.col("f1")).otherwise(F.col("d1")).alias("flight_t1"))


def passes_through(df: DataFrame, s: Series, hoop: dict[str, Column], max_pass: float = 45, above: float = 0.0,
                   below: float = 0.0, tolerance: float = 8.0, x: str = "x", y: str = "y") -> DataFrame:
    """Falls through a box: below it now, above it at most ``max_pass`` frames ago, never rising in between.

    ``s.time`` is the frame.  Gaps in the track are fine.  One row per exit point, before de-duplication.
    """
    in_x = F.col(x).between(hoop["x1"], hoop["x2"])
    rows = neighbours(df, s, {"_py": (y, -1)})
    rise = F.when(F.col("_py") - F.col(y) > F.lit(tolerance), 1).otherwise(0).cast("long")
    rows = running(rows, s, {"_rises": ("sum", rise)})
    # steps inside one frame belong to every span touching that frame
    frame = Window.partitionBy(*s.part, s.time)
    rows = rows.withColumns({"_rises_hi": F.max("_rises").over(frame), "_rises_lo": F.min("_rises").over(frame)})
    is_above = in_x & (F.col(y) < hoop["y1"] - F.lit(above))
    entry = F.when(is_above, F.struct(F.col(s.time).alias("at"), F.col("_rises_lo").alias("rises")))
    rows = running(rows, s, {"_entry": ("last", entry)}, inclusive=False)
    ok = in_x & (F.col(y) > hoop["y2"] + F.lit(below)) & (F.col(s.time) - F.col("_entry.at") <= F.lit(max_pass)) & (
        F.col("_rises_hi") == F.col("_entry.rises"))
    return rows.filter(ok).select(*s.keys, s.seq, F.col(s.time).alias("exit_frame"),
                                  F.col("_entry.at").alias("entry_frame"))


def spaced(df: DataFrame, s: Series, gap: float, strict: bool = False) -> DataFrame:
    """Keep a row when it is at least (``strict``: more than) ``gap`` after the last row *kept*, not the previous row."""
    return df.join(spaced_rows(df, s, gap, strict), [*s.keys, *s.order], "left_semi")


def true_stretches(df: DataFrame, s: Series, on: Column, min_len: int = 1, value: str | None = None) -> DataFrame:
    """Maximal stretches of consecutive rows where ``on`` holds, of at least ``min_len`` rows."""
    rows = df.withColumn("_on", F.coalesce(on, F.lit(False)))
    rows = neighbours(rows, s, {"_was": ("_on", -1)})
    rows = islands(rows, s, F.col("_on") & ~F.coalesce(F.col("_was"), F.lit(False)), "stretch")
    peak = [F.max(value).alias("peak")] if value else []
    return (rows.filter("_on").groupBy(*s.keys, "stretch")
            .agg(F.count("*").alias("n"), F.min(s.time).alias("t0"), F.max(s.time).alias("t1"), *peak)
            .filter(F.col("n") >= min_len))


def smoothed_peaks(df: DataFrame, s: Series, y: str = "y") -> DataFrame:
    """Rows where the five-point centred mean of y is a valley of the image, that is, a high point of the flight."""
    rows, several, _ = packed(df, s)
    # keys of one block have no neighbours to copy rows from
    wide = with_halo(rows, s, 4, 4, [y]) if several is not None else rows.withColumn(HALO, F.lit(False))
    w = s.window()
    wide = wide.withColumn("_sm", F.avg(y).over(w.rowsBetween(-2, 2)))
    wide = wide.withColumns({"_b": F.lag("_sm", 2).over(w), "_a": F.lead("_sm", 2).over(w)})
    return drop_halo(wide).filter((F.col("_sm") < F.col("_b") - EPS) & (F.col("_sm") < F.col("_a") - EPS))


def first_drop_below(df: DataFrame, s: Series, value: str, fractions: Sequence[float]) -> DataFrame:
    """For each fraction the first time the series is under that share of its first value."""
    first = df.groupBy(*s.keys).agg(F.min_by(value, F.struct(*s.order)).alias("_first"))
    rows = df.join(first, list(s.keys))
    hits = [F.min(F.when(F.col(value) < F.col("_first") * F.lit(f), F.col(s.time))).alias(f"f{i}")
            for i, f in enumerate(fractions)]
    wide = rows.groupBy(*s.keys).agg(*hits)
    pairs = F.explode(F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.col(f"f{i}").alias("t"))
                                for i, f in enumerate(fractions)]))
    return wide.select(*s.keys, pairs.alias("_p")).select(*s.keys, "_p.fraction", "_p.t")


def survival(df: DataFrame, keys: Sequence[str], frame: str = "frame", x: str = "x", seq: str = "seq") -> DataFrame:
    """How long each id is seen and where it moves: frames, first, last, start x, end x."""
    order = F.struct(frame, seq)
    return df.groupBy(*keys).agg(
        F.count("*").alias("frames"), F.min(frame).alias("first"), F.max(frame).alias("last"),
        F.min_by(x, order).alias("x_start"), F.max_by(x, order).alias("x_end"))


def arc_counts(df: DataFrame, s: Series, y: str, gap: float) -> DataFrame:
    """Smoothed high points per key, counted when more than ``gap`` after the last counted one; at least 1."""
    peaks = smoothed_peaks(df.select(*s.keys, *s.order, y), s, y).select(*s.keys, *s.order)
    counted = spaced(peaks, s, gap, strict=True).groupBy(*s.keys).agg(F.count("*").alias("_p"))
    n = df.groupBy(*s.keys).agg(F.count("*").alias("points"))
    arcs = F.when(F.col("points") < 6, F.lit(1)).otherwise(F.greatest(F.lit(1), F.coalesce("_p", F.lit(0))))
    return n.join(counted, list(s.keys), "left").select(*s.keys, "points", arcs.cast("long").alias("arcs"))
