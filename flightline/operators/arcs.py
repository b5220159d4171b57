"""Flights: the longest ballistic stretch of a track, its release, and choosing among tracks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightline.functions.geometry import dist
from flightline.functions.kinematics import arc_x, arc_y
from flightline.operators.blocks import HALO, Series, map_blocks, neighbours, packed, with_halo
from flightline.operators.joins import point_in_interval
from flightline.runtime import cut

MIN_SAG = 14.0
ARC_SCHEMA = ("n long, t0 double, t1 double, a double, b double, c double, d double, e double, rms double, sag double, "
              "end_t double, end_x double, end_y double, truncated boolean")
FIELDS = [f.split()[0] for f in ARC_SCHEMA.split(", ")]


def ballistic(t: np.ndarray, x: np.ndarray, y: np.ndarray):
    """(a, b, c, d, e, rms) with time from the first point; None when singular."""
    if len(t) < 4:
        return None
    tt = t - t[0]
    if len(t) * float(tt @ tt) - float(tt.sum()) ** 2 < 1e-9 or len(np.unique(tt)) < 3:
        return None
    d, e = np.polyfit(tt, x, 1)
    a, b, c = np.polyfit(tt, y, 2)
    res = (d * tt + e - x) ** 2 + (a * tt * tt + b * tt + c - y) ** 2
    return a, b, c, d, e, float(np.sqrt(res.mean()))


class Stretches:
    """Fits of all stretches of one block that end at the same point, from sums of powers up to each point: a fit costs the same however long it is."""

    def __init__(self, t: np.ndarray, x: np.ndarray, y: np.ndarray, tol: float):
        self.t, self.x, self.y, self.tol = t, x, y, tol
        self.u, self.v, self.w = (c - c.mean() for c in (t, x, y))
        u, v, w = self.u, self.v, self.w
        terms = [np.ones_like(u), u, u**2, u**3, u**4, v, u * v, v**2, w, u * w, u**2 * w, w**2]
        self.sums = np.concatenate([np.zeros((len(terms), 1)), np.cumsum(terms, axis=1)], axis=1)
        self.moment = np.concatenate([[0], np.cumsum(np.diff(t) > 0)])  # number of the point's moment

    def ending(self, end: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each start: does the parabola hold, does it also reach the point before, its curvature and its residual."""
        s = self.sums[:, end, None] - self.sums[:, starts]
        n = s[0]
        m, m2, m3, m4, mx, mtx, mxx, my, mty, mtty, myy = s[1:] / n
        c2, c3 = m2 - m**2, m3 - 3 * m * m2 + 2 * m**3
        c4 = m4 - 4 * m * m3 + 6 * m**2 * m2 - 3 * m**4 - c2**2
        tx, ty = mtx - m * mx, mty - m * my
        tty = mtty - 2 * m * mty + m**2 * my - c2 * my
        sound = (n * n * c2 >= 1e-9) & (self.moment[end - 1] - self.moment[starts] >= 2)
        with np.errstate(all="ignore"):
            det = c2 * c4 - c3**2
            speed, slope, bend = tx / c2, (ty * c4 - c3 * tty) / det, (c2 * tty - c3 * ty) / det
            rms = np.sqrt(np.maximum(0.0, mxx - mx**2 - speed * tx + myy - my**2 - slope * ty - bend * tty))
            before = np.maximum(starts - 1, 0)
            ahead = self.u[before] - m
            off = np.hypot(mx + speed * ahead - self.v[before], my + slope * ahead + bend * (ahead**2 - c2) - self.w[before])
            return sound & (bend > 0) & (rms <= self.tol), off <= self.tol, bend, rms


def longest_arc(t, x, y, first_end: int, more_before: bool, tol: float, min_pts: int):
    """Best arc among those ending at index ``first_end`` or later; says when one ran out of earlier points.

    An arc grows backwards while each wider stretch still is a falling parabola and the narrower one had foreseen the point it took in, so its
    length is that of the leading run of such stretches, looked up some dozens at a time.  Longest first, then the smaller residual, then the later end.
    """
    fits, best, cut_short = Stretches(t, x, y, tol), None, False
    for end in range(len(t), max(first_end, min_pts - 1), -1):
        grown, last, foreseen = 0, None, True
        for hi in range(end - min_pts, -1, -64):
            starts = np.arange(hi, max(hi - 64, -1), -1)
            holds, reaches, bend, rms = fits.ending(end, starts)
            go = holds & np.concatenate([[foreseen], reaches[:-1]])
            run = len(go) if go.all() else int(np.argmin(go))
            if run:
                grown, last, foreseen = grown + run, (bend[run - 1], rms[run - 1]), bool(reaches[run - 1])
            if run < len(go):
                break
        if last is None:
            continue
        start = end - min_pts - grown + 1
        cut_short |= more_before and start == 0
        if abs(last[0]) * (t[end - 1] - t[start]) ** 2 / 8.0 >= MIN_SAG:
            best = min([b for b in (best, (-(end - start), last[1], -end)) if b is not None])
    if best is None:
        return None, cut_short
    end = -best[2]
    start = end + best[0]
    fit = ballistic(t[start:end], x[start:end], y[start:end])
    span = t[end - 1] - t[start]
    return [end - start, t[start], t[end - 1], *fit, abs(fit[0]) * span * span / 8.0, t[end - 1], x[end - 1], y[end - 1]], cut_short


def best_arcs(df: DataFrame, s: Series, tol: float = 34.0, min_pts: int = 5, halo: int = 32) -> DataFrame:
    """One row per track that flies: the longest stretch staying within ``tol`` of its own parabola.

    Ends are tried block by block, with some earlier points carried in where a track has several blocks.  Blocks in which an arc reached the
    first carried point are tried again with four times as many, so the result does not depend on the blocks.
    """
    rows, several, _ = packed(df.select(*s.keys, *s.order, "x", "y"), s)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    part = s.part
    schema = ", ".join(f"{c} {types[c]}" for c in part) + ", " + ARC_SCHEMA

    def try_ends(depth: int):
        def fn(block):
            t, x, y = (block[c].astype(float) for c in (s.time, "x", "y"))
            carried = int(block[HALO].sum()) if HALO in block else 0
            if len(t) < min_pts:
                return [], {}
            arc, short = longest_arc(t, x, y, carried, carried >= depth, tol, min_pts)
            if arc is None and not short:
                return [], {}
            arc = [0] + [float("nan")] * (len(FIELDS) - 2) if arc is None else arc
            return [0], {c: [v] for c, v in zip(FIELDS, [*arc, short])}
        return fn

    if several is None:
        found = map_blocks(rows, part, s.order, try_ends(halo), schema)
        done = found.filter(~F.col("truncated"))
    else:
        done, todo = None, rows
        while True:
            wide = with_halo(rows, s, halo, 0)
            if done is not None:
                wide = wide.join(todo.select(*part).distinct(), part, "left_semi")
            found = cut(map_blocks(wide, part, s.order, try_ends(halo), schema))
            final = found.filter(~F.col("truncated"))
            done = final if done is None else done.unionByName(final)
            todo = found.filter("truncated").select(*part)
            if todo.isEmpty():
                break
            halo *= 4
    rank = F.struct((-F.col("n")).alias("n"), F.col("rms"), (-F.col("end_t")).alias("e"))
    best = done.filter("n > 0").groupBy(*s.keys).agg(F.min_by(F.struct(*FIELDS[:-1]), rank).alias("_b"))
    return best.select(*s.keys, "_b.*")


def releases(arcs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where each flight was let go: the arc's own value at its first point."""
    return arcs.select(*keys, F.col("t0").alias("release_t"), F.col("e").alias("release_x"), F.col("c").alias("release_y"),
                       "n", "rms", "sag", (F.col("t1") - F.col("t0")).alias("span"))


def pick_flight(tracks: DataFrame, keys: Sequence[str], anchor: str, order: str, near: float = 0.15) -> DataFrame:
    """Among a shot's flying tracks the one ending latest before the anchor, more points on a near tie.

    ``tracks`` holds one row per flying track with end_t, n and the anchor time.  The comparison is not transitive,
    so tracks are visited in ``order``, like the rule was tuned.
    """
    cols = [c for c in tracks.columns if c not in keys]
    seq = F.array_sort(F.collect_list(F.struct(order, *[c for c in cols if c != order], (F.col(anchor) - F.col("end_t")).alias("late"))))
    packed = tracks.groupBy(*keys).agg(seq.alias("_t"))

    def better(best, c):
        closer = c["late"] < best["late"] - near
        tie = (F.abs(c["late"] - best["late"]) <= near) & (c["n"] > best["n"])
        return F.when(closer | tie, c).otherwise(best)

    chosen = packed.withColumn("_b", F.aggregate("_t", F.col("_t")[0], better))
    return chosen.select(*keys, "_b.*")


def aimed_flight(arcs: DataFrame, near_tracks: DataFrame, shots: DataFrame, keys: Sequence[str], t: str, cx: str, cy: str,
                 accept: float = 700.0, within: float = 500.0) -> DataFrame:
    """The flight whose arc at the shot's time is nearest the rim, else the longest track that came near it.

    ``arcs``: rows of a shot's footage with keys, track_id, fit and the shot's time and rim; ``near_tracks``: keys, track_id, n_points, nearest
    (distance to the rim).
    """
    j = arcs.withColumnRenamed("n", "n_arc")
    miss = dist(arc_x(F.col(t)), arc_y(F.col(t)), F.col(cx), F.col(cy))
    j = j.withColumn("miss", miss).filter(F.col("miss") <= accept)
    best = j.groupBy(*keys).agg(F.min(F.struct("miss", "track_id")).alias("_b"))
    longest = near_tracks.filter(F.col("nearest") < within).groupBy(*keys).agg(
        F.min(F.struct((-F.col("n_points")).alias("n"), "track_id")).alias("_l"))
    out = shots.select(*keys).join(best, list(keys), "left").join(longest, list(keys), "left")
    how = F.when(F.col("_b").isNotNull(), "arc").when(F.col("_l").isNotNull(), "longest near the rim").otherwise("none")
    return out.select(*keys, F.coalesce("_b.track_id", "_l.track_id").alias("track_id"), F.col("_b.miss").alias("miss"), how.alias("how"))


def predicted_next(df: DataFrame, s: Series) -> DataFrame:
    """Where a track's next sighting is expected from its last two, moving at constant velocity."""
    w = neighbours(df, s, {"_t1": (s.time, -1), "_x1": ("x", -1), "_y1": ("y", -1), "_t2": (s.time, -2), "_x2": ("x", -2), "_y2": ("y", -2)})
    dt, ahead = F.col("_t1") - F.col("_t2"), F.col(s.time) - F.col("_t1")
    ex = F.col("_x1") + (F.col("_x1") - F.col("_x2")) / dt * ahead
    ey = F.col("_y1") + (F.col("_y1") - F.col("_y2")) / dt * ahead
    return w.filter(dt > 0).withColumns({"ex": ex, "ey": ey}).drop("_t1", "_x1", "_y1", "_t2", "_x2", "_y2")


def accept_candidate(expected: DataFrame, candidates: DataFrame, keys: Sequence[str], eid: str, cid: str, frame: str, span: float, top: int = 3,
                     reach: float = 55.0, width: float = 64.0) -> DataFrame:
    """Second-look sightings: of the ``top`` most confident candidates around the frame, the one nearest the
    expected place, when it is within ``reach``.  ``candidates``: keys, cid, frame, cand_x, cand_y, conf."""
    spans = expected.select(*keys, eid, "ex", "ey", (F.col(frame) - span).alias("_lo"), (F.col(frame) + span).alias("_hi"))
    near = point_in_interval(candidates, spans, keys, frame, "_lo", "_hi", width)
    # candidates of one moment only: a short window
    order = Window.partitionBy(eid).orderBy(F.col("conf").desc(), cid)
    best = near.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= top)
    d = dist(F.col("cand_x"), F.col("cand_y"), F.col("ex"), F.col("ey"))
    picked = best.withColumn("_d", d).groupBy(eid).agg(F.min(F.struct(F.col("_d").alias("d"), F.col(cid).alias("c"))).alias("_b"))
    return picked.filter(F.col("_b.d") <= reach).select(eid, F.col("_b.c").alias(cid), F.col("_b.d").alias("off"))
