"""Tracking (T-01..05, T-10) and flight (A-03..06, A-15..17) queries; sequential rules without an SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.functions.geometry import dist, num
from flightline.functions.kinematics import arc_x, arc_y
from flightline.operators import arcs as ar
from flightline.operators import tracking as tk
from flightline.operators.blocks import Series
from flightline.operators.joins import point_in_interval
from flightline.plans.inputs import DAY, DET, HOUR, detections, marks, r
from flightline.plans.registry import query
from flightline.runtime import cut

FRAMES = Series(("video",), "frame", "seq", 168.0)
RADIUS = 60.0
FAST = tk.Tracker(ceiling=120.0, slack=5.0)
SHOT_H = 240.0  # a shot's own stretch of footage, in hours to either side


def tracked(spark, sf) -> DataFrame:
    rows = detections(spark, sf).withColumn("radius", num(RADIUS))
    return tk.build_tracks(rows, FRAMES, FAST)


@query("t01_build_tracks")
def t01(spark, sf):
    return tracked(spark, sf).select("video", "seq", "track_id")


@query("t03_link_people")
def t03(spark, sf):
    return tk.link_people(detections(spark, sf), FRAMES, 3.0, 3.0, 220.0).select("video", "seq", "track_id")


@query("t04_appearance_tracks")
def t04(spark, sf):
    return tk.link_people(detections(spark, sf), FRAMES, 6.0, 2.0, 260.0, min_track=3).select("video", "seq", "track_id")


@query("t05_link_by_scale")
def t05(spark, sf):
    """A day of one user is a shot."""
    rows = detections(spark, sf).withColumns({"day": F.floor(F.col("t") / DAY), "sw": F.col("w") * 4})
    s = Series(("video", "day"), "frame", "seq", 24.0)
    return tk.link_by_scale(rows, s).select("video", "day", "seq", "person")


@query("t10_clip_track")
def t10(spark, sf):
    labels = marks(spark, sf).withColumn("t_end", F.when(F.col("mark") % 2 == 0, F.col("mt") + DAY).otherwise(F.col("mt")))
    out = tk.clip_tracks(labels, detections(spark, sf), ["video"], 1.2 * DAY, 2.2 * DAY, 1.4 * DAY, 20.0, 150.0, 5 * DAY)
    return out.withColumns({c: r(F.col(c), 3) for c in ("t0", "t1", "apex_t")})


def flying(trk: DataFrame) -> DataFrame:
    """Arcs of the tracks, time in hours."""
    return ar.best_arcs(trk.withColumn("h", F.col("t") / HOUR), Series(("video", "track_id"), "h", "seq", 240.0), tol=60.0)


@query("a03_best_arc")
def a03(spark, sf):
    f = flying(tracked(spark, sf))
    return f.select("video", "track_id", "n", r(F.col("t0"), 4).alias("t0"), r(F.col("t1"), 4).alias("t1"), r(F.col("a"), 4).alias("a"),
                    r(F.col("rms"), 3).alias("rms"), r(F.col("sag"), 2).alias("sag"))


@query("a04_release")
def a04(spark, sf):
    trk = cut(tracked(spark, sf))
    rel = ar.releases(flying(trk), ["video", "track_id"])
    out = trk.select("video", "track_id").distinct().join(rel, ["video", "track_id"], "left")
    return out.select("video", "track_id", F.when(F.col("n").isNull(), "carried").otherwise("thrown").alias("how"), "n",
                      *[r(F.col(c), 2).alias(c) for c in ("release_t", "release_x", "release_y", "sag", "span")])


@query("a05_flight_of_shot")
def a05(spark, sf):
    trk = cut(tracked(spark, sf))
    shots = marks(spark, sf).select("video", "mark", (F.col("mt") / HOUR).alias("anchor")).withColumns(
        {"lo": F.col("anchor") - SHOT_H, "hi": F.col("anchor") + SHOT_H})
    travel = trk.groupBy("video", "track_id").agg(
        F.min_by(F.struct("x", "y"), F.struct("frame", "seq")).alias("p"), F.max_by(F.struct("x", "y"), F.struct("frame", "seq")).alias("q"),
        (F.max("t") / HOUR).alias("end_t"))
    far = travel.filter(dist(F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y")) >= 30.0).select("video", "track_id", "end_t")
    ends = flying(trk).select("video", "track_id", "n", "rms").join(far, ["video", "track_id"])  # lateness is that of the track, not of its arc
    cand = point_in_interval(ends, shots, ["video"], "end_t", "lo", "hi", 2 * SHOT_H).select("video", "mark", "track_id", "end_t", "n", "rms", "anchor")
    out = ar.pick_flight(cand, ["video", "mark"], "anchor", "track_id", near=24.0)
    return out.select("video", "mark", "track_id", "n", r(F.col("late"), 3).alias("late"))


@query("a06_aimed_flight")
def a06(spark, sf):
    trk = cut(tracked(spark, sf))
    f = flying(trk)
    near = trk.groupBy("video", "track_id").agg(F.count("*").alias("n_points"), F.min(dist(F.col("x"), F.col("y"), 250.0, 40.0)).alias("nearest"),
                                                (F.max("t") / HOUR).alias("end_t"))
    shots = marks(spark, sf).select("video", "mark", (F.col("mt") / HOUR).alias("st")).withColumns(
        {"cx": num(250), "cy": num(40), "lo": F.col("st") - SHOT_H, "hi": F.col("st") + SHOT_H})
    around = lambda flights: point_in_interval(flights, shots, ["video"], "end_t", "lo", "hi", 2 * SHOT_H)
    out = ar.aimed_flight(around(f), around(near), shots, ["video", "mark"], "st", "cx", "cy")
    return out.withColumn("miss", r(F.col("miss"), 2))


@query("a15_holes_in_arc")
def a15(spark, sf):
    """Hours inside a flight without a sighting, where the arc says the ball was in the picture."""
    trk = cut(tracked(spark, sf))
    f = flying(trk)
    grid = f.withColumn("frame", F.explode(F.sequence(F.ceil("t0"), F.floor("t1")))).filter("t1 >= t0")
    missing = grid.join(trk.select("video", "track_id", "frame"), ["video", "track_id", "frame"], "left_anti")
    px, py = arc_x(F.col("frame").cast("double")), arc_y(F.col("frame").cast("double"))
    return missing.withColumns({"px": px, "py": py}).filter("px BETWEEN 0 AND 500 AND py BETWEEN 0 AND 500").select(
        "video", "track_id", "frame", r(F.col("px"), 1).alias("px"), r(F.col("py"), 1).alias("py"))


@query("a16_prediction_gate", f"""WITH {DET}, l AS (SELECT *, lag(t) OVER w AS t1, lag(x) OVER w AS x1, lag(y) OVER w AS y1, lag(t, 2) OVER w AS t2,
  lag(x, 2) OVER w AS x2, lag(y, 2) OVER w AS y2 FROM det WINDOW w AS (PARTITION BY video, site ORDER BY t, seq)),
e AS (SELECT *, x1+(x1-x2)/(t1-t2)*(t-t1) AS ex, y1+(y1-y2)/(t1-t2)*(t-t1) AS ey FROM l WHERE t1>t2),
c AS (SELECT e.seq, e.ex, e.ey, d.seq AS cand, d.x AS cx, d.y AS cy, row_number() OVER (PARTITION BY e.seq ORDER BY d.conf DESC, d.seq) AS k
  FROM e JOIN det d ON d.video=e.video AND d.frame BETWEEN e.frame-6 AND e.frame+6),
b AS (SELECT seq, cand, sqrt((cx-ex)*(cx-ex)+(cy-ey)*(cy-ey)) AS off, row_number() OVER (PARTITION BY seq ORDER BY sqrt((cx-ex)*(cx-ex)+(cy-ey)*(cy-ey)), cand) AS rk FROM c WHERE k<=3)
SELECT e.video, e.site, e.seq, round(ex, 4) AS ex, round(ey, 4) AS ey, cand, round(off, 4) AS off FROM e LEFT JOIN b ON b.seq=e.seq AND rk=1 AND off<=55""")
def a16(spark, sf):
    det = detections(spark, sf)
    e = ar.predicted_next(det, Series(("video", "site"), "t", "seq", 7 * DAY))
    cand = det.select("video", F.col("seq").alias("cand"), "frame", F.col("x").alias("cand_x"), F.col("y").alias("cand_y"), "conf")
    got = ar.accept_candidate(e, cand, ["video"], "seq", "cand", "frame", 6, width=48)
    return e.select("video", "site", "seq", r(F.col("ex"), 4).alias("ex"), r(F.col("ey"), 4).alias("ey")).join(got, "seq", "left").withColumn("off", r(F.col("off"), 4))


@query("a17_pseudo_labels")
def a17(spark, sf):
    """Seven evenly spaced moments of each clean flight, unseen ones first, split by a fixed hash."""
    trk = cut(tracked(spark, sf))
    f = flying(trk)
    f = f.filter("rms <= 40 AND n >= 5").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(6))))
    f = f.withColumn("at", F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("i") / 6).withColumn("frame", F.floor("at"))
    seen = trk.select("video", "track_id", "frame").distinct().withColumn("seen", F.lit(True))
    f = f.join(seen, ["video", "track_id", "frame"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    f = f.withColumns({"px": arc_x(F.col("at")), "py": arc_y(F.col("at"))}).filter("px BETWEEN 0 AND 500 AND py BETWEEN 0 AND 500")
    w = F.row_number().over(tk_window().orderBy("seen", "i"))
    return f.select("video", "track_id", w.cast("long").alias("rank"), F.col("i").cast("long").alias("i"), "seen", r(F.col("px"), 1).alias("px"),
                    r(F.col("py"), 1).alias("py"),
                    F.when(F.pmod(F.xxhash64("video", "track_id"), F.lit(5)) == 0, "val").otherwise("train").alias("split"))


def tk_window():
    from pyspark.sql import Window
    return Window.partitionBy("video", "track_id")


