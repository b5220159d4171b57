"""Segmentation (T) and gate/merge (G) queries on the events table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightline.functions import geometry as geo
from flightline.functions import kinematics as kin
from flightline.operators import events as ev
from flightline.operators import segments as seg
from flightline.operators.blocks import Series, neighbours, settled
from flightline.operators.joins import point_in_interval
from flightline.operators.quantiles import quantiles
from flightline.plans.inputs import (DAY, DET, HOUR, MARKS, RIM_SQL, by_site, by_video, detections, marks, r,
                                     with_rim)
from flightline.plans.registry import query

# thresholds in the hours-and-days scale of the events table
G = ev.Gates().but(peak_fall=2e-4, max_dt=6 * HOUR, base_fps=1 / 1800.0, lookback=12 * HOUR, min_drop=25.0,
                   ring_fall=60.0, bounce_gap=2 * DAY, near_merge=1 * DAY, strong_fall=60.0, lead=12 * HOUR,
                   tail=22 * HOUR, neighbour_pad=3.5 * HOUR, min_lead=3 * HOUR, min_tail=15 * HOUR)
MAX_GAP, JITTER, WIDTH = 5 * DAY, 5.0, 7 * DAY
KEYS = ["video", "site"]


def sites(spark: SparkSession, sf: str) -> Series:
    """The sightings by site; where no recording is long, whole sites are blocks, of sightings and of all that is made of them."""
    return replace(by_site(), whole=settled(by_video(), detections(spark, sf)).whole)


def run_points(spark: SparkSession, sf: str, s: Series | None = None) -> DataFrame:
    return ev.mark_runs(with_rim(detections(spark, sf)), s or sites(spark, sf), MAX_GAP, JITTER)


def zone_corners() -> list:
    return geo.box_corners(geo.zone_box(F.col("x1"), F.col("y2"), F.col("x2")))


def gated(spark: SparkSession, sf: str, s: Series | None = None) -> DataFrame:
    s = s or sites(spark, sf)
    det, points = detections(spark, sf), run_points(spark, sf, s)
    if s.whole:
        feats = ev.run_features(ev.over_site(points, s, G), s, G, zone_corners())
        return ev.gate_runs(feats.filter(F.col("video").isNotNull() & F.col("site").isNotNull()), G)
    feats = ev.run_features(points, s, G, zone_corners())
    feats = ev.add_window_top(feats, det, s, G, 2 * DAY)
    feats = feats.join(ev.frame_scale(det, s, G).select(*KEYS, "scale"), KEYS)
    return ev.gate_runs(feats, G)


def kept_runs(spark: SparkSession, sf: str, s: Series) -> DataFrame:
    return gated(spark, sf, s).filter(F.col("reason").isNull())


def bounced(spark: SparkSession, sf: str, s: Series) -> DataFrame:
    return ev.bounce_merge(kept_runs(spark, sf, s), KEYS, G.bounce_gap, WIDTH, s.whole)


def merged(spark: SparkSession, sf: str, s: Series | None = None) -> DataFrame:
    return ev.merge_events(bounced(spark, sf, s or sites(spark, sf)), ["video"], "site", G.near_merge, WIDTH)


def windows(spark: SparkSession, sf: str, s: Series) -> DataFrame:
    final = ev.approach_gate(merged(spark, sf, s), G).filter("at_hoop")
    return ev.event_windows(final, KEYS, G, WIDTH, s.whole)


RUNS = f"""{DET},
lagged AS (SELECT *, lag(t) OVER w AS pt, lag(y) OVER w AS py FROM det WINDOW w AS (PARTITION BY video, site ORDER BY t, seq)),
flagged AS (SELECT *, CASE WHEN pt IS NULL OR t-pt>432000 OR y<py-5 THEN 1 ELSE 0 END AS st FROM lagged),
runs AS (SELECT *, CAST(sum(st) OVER (PARTITION BY video, site ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id
  FROM flagged)"""

FEATS = f"""{RUNS},
runp AS (SELECT *, {RIM_SQL} FROM runs),
rq AS (SELECT *, sqrt((x-(x1+x2)/2)*(x-(x1+x2)/2)+(y-(y1+y2)/2)*(y-(y1+y2)/2)) AS dd, greatest(1.0::DOUBLE, x2-x1) AS rw0,
  CASE WHEN st=0 AND t>pt THEN (y-py)/(t-pt) END AS v,
  row_number() OVER (PARTITION BY video, site, run_id ORDER BY t DESC, seq DESC) AS back,
  trunc((x1+x2)/2-0.52::DOUBLE*(x2-x1)) AS bx1, trunc((x1+x2)/2+0.52::DOUBLE*(x2-x1)) AS bx2,
  trunc(y2+0.3::DOUBLE*(x2-x1)) AS by1, trunc(y2+1.3::DOUBLE*(x2-x1)) AS by2 FROM runp),
rz AS (SELECT *, x>=(bx1+bx2)/2+(bx1-(bx1+bx2)/2)*2 AND x<(bx1+bx2)/2+(bx2-(bx1+bx2)/2)*2
  AND y>=(by1+by2)/2+(by1-(by1+by2)/2)*2 AND y<(by1+by2)/2+(by2-(by1+by2)/2)*2 AS inz FROM rq),
f0 AS (SELECT video, site, run_id, count(*) AS n, min(t) AS t0, max(t) AS t1, arg_min(seq, (t, seq)) AS seq0,
  arg_min(y, (t, seq)) AS y0, arg_max(y, (t, seq)) AS y1, min(y) AS y_min, max(y) AS y_max, max(v) AS peak_speed,
  arg_min(dd, (t, seq)) AS d0, min(dd) AS d_min, max(rw0) AS rw, max(conf) AS peak_conf, bool_or(inz) AS in_zone,
  min(CASE WHEN back<=3 THEN dd END)/max(rw0) AS end_near,
  min(dd)/max(rw0)<=0.6 AND max(y)-min(y)>=60 AS through_ring FROM rz GROUP BY ALL),
f1 AS (SELECT f0.*, (SELECT min(h.y) FROM det h WHERE h.video=f0.video AND h.site=f0.site
  AND h.t>=f0.t0-43200 AND h.t<=f0.t1) AS top FROM f0),
steps AS (SELECT video, site, t-lag(t) OVER (PARTITION BY video, site ORDER BY t, seq) AS dt FROM det),
sc AS (SELECT video, site, min(CASE WHEN dt>0 AND dt<21600 THEN dt END) AS frame_dt FROM steps GROUP BY ALL),
feats AS (SELECT f1.*, coalesce(frame_dt*(1.0::DOUBLE/1800.0::DOUBLE), 1.0::DOUBLE) AS scale,
  greatest(y1-y0, y1-coalesce(top, y0)) AS fell FROM f1 JOIN sc USING (video, site)),
gated AS (SELECT *, CASE WHEN n<3 AND NOT (n BETWEEN 5 AND 20) THEN 'too few detections'
  WHEN coalesce(peak_speed<2e-4/greatest(1.0::DOUBLE, least(1.2::DOUBLE, scale)), true) THEN 'never fell at the speed of a dropped ball'
  WHEN fell<25 AND NOT (n BETWEEN 5 AND 20) THEN 'did not fall far enough'
  WHEN end_near>3.2 AND NOT (through_ring OR in_zone) THEN 'ended too far from the rim' END AS reason FROM feats)"""

AGG = """sum(n)::BIGINT AS n, min(t0) AS t0, {end} AS t1, arg_min(seq0, (t0, seq0)) AS seq0, arg_min(d0, (t0, seq0)) AS d0,
  min(d_min) AS d_min, max(rw) AS rw, max(peak_conf) AS peak_conf, min(y_min) AS y_min, max(y_max) AS y_max"""

BOUNCED = f"""{FEATS},
k0 AS (SELECT *, lag(t1) OVER (PARTITION BY video, site ORDER BY t0, seq0) AS pend FROM gated WHERE reason IS NULL),
k1 AS (SELECT *, sum(CASE WHEN pend IS NULL OR t0-pend>172800 THEN 1 ELSE 0 END)
  OVER (PARTITION BY video, site ORDER BY t0, seq0 ROWS UNBOUNDED PRECEDING)::BIGINT AS event_id FROM k0),
bounced AS (SELECT video, site, event_id, {AGG.format(end="arg_max(t1, (t0, seq0))")} FROM k1 GROUP BY ALL)"""

MERGED = f"""{BOUNCED},
e0 AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t0, seq0) AS rn FROM bounced),
fold AS (SELECT video, rn, site, t0 AS anchor, t1 AS last_end, seq0 AS merged_id FROM e0 WHERE rn=1
  UNION ALL
  SELECT e.video, e.rn, e.site, CASE WHEN e.site=f.site AND (e.t0-f.anchor<=86400 OR e.t0<=f.last_end) THEN f.anchor ELSE e.t0 END,
    CASE WHEN e.site=f.site AND e.t0-f.anchor<=86400 THEN e.t1
         WHEN e.site=f.site AND e.t0<=f.last_end THEN greatest(f.last_end, e.t1) ELSE e.t1 END,
    CASE WHEN e.site=f.site AND (e.t0-f.anchor<=86400 OR e.t0<=f.last_end) THEN f.merged_id ELSE e.seq0 END
  FROM fold f JOIN e0 e ON e.video=f.video AND e.rn=f.rn+1),
m0 AS (SELECT e0.*, f.merged_id, f.last_end FROM e0 JOIN fold f USING (video, rn)),
merged AS (SELECT video, site, merged_id, {AGG.format(end="arg_max(last_end, (t0, seq0))")} FROM m0 GROUP BY ALL)"""

FINAL = f"""{MERGED},
appr AS (SELECT *, (d0-d_min)/greatest(1.0::DOUBLE, d0) AS closed, d_min/rw AS nearest FROM merged),
appr2 AS (SELECT *, closed>=(CASE WHEN n BETWEEN 5 AND 20 THEN 0.10 ELSE 0.40 END)::DOUBLE OR d_min<=0.8*rw
  OR (peak_conf>=0.85 AND y_max-y_min>=60) AS at_hoop FROM appr),
final AS (SELECT * FROM appr2 WHERE at_hoop)"""

WINDOWS = f"""{FINAL},
w0 AS (SELECT *, lag(t1) OVER w AS pend, lead(t0) OVER w AS nxt FROM final WINDOW w AS (PARTITION BY video, site ORDER BY t0, seq0)),
win AS (SELECT *, greatest(0.0::DOUBLE, least(greatest(t0-43200, coalesce(pend+12600, t0-43200)), t0-10800)) AS clip_start,
  greatest(least(t1+79200, coalesce(nxt-12600, t1+79200)), t1+54000) AS clip_stop FROM w0)"""


@query("t06_descent_runs", f"WITH {RUNS} SELECT video, site, seq, run_id FROM runs")
def t06(spark, sf):
    return seg.descent_runs(detections(spark, sf), by_site(), "y", MAX_GAP, JITTER).select("video", "site", "seq", "run_id")


SUMMARY = f"""{RUNS}, summ AS (SELECT video, site, run_id, count(*) AS n, min(t) AS t0, max(t) AS t1,
  arg_min(y, (t, seq)) AS y0, arg_max(y, (t, seq)) AS y1 FROM runs GROUP BY ALL),
desc3 AS (SELECT * FROM summ WHERE n>=3 AND y1-y0>=25)"""


def found_descents(spark, sf):
    runs = seg.descent_runs(detections(spark, sf), by_site(), "y", MAX_GAP, JITTER)
    return runs, seg.descents(seg.run_summary(runs, by_site()), 3, 25.0)


@query("t07_descents", f"""WITH {SUMMARY} SELECT video, site, run_id, n, round(t0, 3) AS t0, round(t1, 3) AS t1,
  round(y1-y0, 6) AS drop FROM desc3""")
def t07(spark, sf):
    _, found = found_descents(spark, sf)
    return found.select("video", "site", "run_id", "n", r(F.col("t0"), 3).alias("t0"), r(F.col("t1"), 3).alias("t1"),
                        r(F.col("y1") - F.col("y0")).alias("drop"))


@query("t08_anchor_descent", f"""WITH {SUMMARY}, {MARKS},
j AS (SELECT mark, site, run_id, abs(t0-mt) AS dt, row_number() OVER (PARTITION BY mark ORDER BY abs(t0-mt), t0, run_id, site) AS rk
  FROM marks JOIN desc3 USING (video) WHERE abs(t0-mt)<=172800)
SELECT mark, site, run_id, round(dt, 3) AS dt FROM j WHERE rk=1""")
def t08(spark, sf):
    _, found = found_descents(spark, sf)
    best = seg.nearest_within(marks(spark, sf), found, ["video"], ["mark"], "mt", "t0", 2 * DAY, ["t0", "run_id", "site"])
    return best.select("mark", "site", "run_id", r(F.col("dt"), 3).alias("dt"))


TRACKS = f"""{SUMMARY},
tr0 AS (SELECT *, CASE WHEN pt IS NULL OR t-pt>864000 THEN 1 ELSE 0 END AS ts FROM lagged),
tracks AS (SELECT video, site, seq, frame, x, y, t, conf, sum(ts) OVER (PARTITION BY video, site ORDER BY t, seq
  ROWS UNBOUNDED PRECEDING)::BIGINT AS track_id FROM tr0)"""


def simple_tracks(spark, sf) -> DataFrame:
    """Tracks cut at idle gaps of ten days, where the queries need a track that SQL can also build."""
    s = by_site()
    rows = neighbours(detections(spark, sf), s, {"_pt": ("t", -1)})
    return seg.islands(rows, s, seg.gap_flag("_pt", "t", 10 * DAY), "track_id").drop("_pt")


@query("t09_whole_flight", f"""WITH {TRACKS},
dp AS (SELECT r.video, r.site, r.run_id, r.frame, round_even(r.x, 1) AS rx, r.t FROM runs r JOIN desc3 USING (video, site, run_id)),
own AS (SELECT dp.video, dp.site, dp.run_id, min(track_id) AS track_id FROM dp JOIN tracks k ON k.video=dp.video AND k.site=dp.site
  AND k.frame=dp.frame AND round_even(k.x, 1)=dp.rx GROUP BY ALL),
mine AS (SELECT video, site, run_id, count(*) AS n_descent, min(t) AS d0, max(t) AS d1 FROM dp GROUP BY ALL),
fl AS (SELECT m.video, m.site, m.run_id, any_value(n_descent) AS n_descent, any_value(d0) AS d0, any_value(d1) AS d1,
  count(k.t) AS n_span, min(k.t) AS f0, max(k.t) AS f1 FROM mine m JOIN own USING (video, site, run_id)
  LEFT JOIN tracks k ON k.video=m.video AND k.site=m.site AND k.track_id=own.track_id AND k.t BETWEEN d0-259200 AND d1+172800
  GROUP BY ALL)
SELECT video, site, run_id, n_span>=n_descent AS whole, greatest(n_span, n_descent) AS n_flight,
  round(CASE WHEN n_span>=n_descent THEN f0 ELSE d0 END, 3) AS flight_t0,
  round(CASE WHEN n_span>=n_descent THEN f1 ELSE d1 END, 3) AS flight_t1 FROM fl""")
def t09(spark, sf):
    runs, found = found_descents(spark, sf)
    pts = runs.join(found.select(*KEYS, "run_id"), [*KEYS, "run_id"], "left_semi")
    out = seg.whole_flight(pts, simple_tracks(spark, sf), KEYS, 3 * DAY, 2 * DAY, 5 * DAY)
    return out.withColumns({"flight_t0": r(F.col("flight_t0"), 3), "flight_t1": r(F.col("flight_t1"), 3)})


MAKES = f"""{DET}, hp AS (SELECT video, seq, frame, x, y, lag(y) OVER w AS py, row_number() OVER w AS rn FROM det
  WINDOW w AS (PARTITION BY video ORDER BY frame, seq)),
vio AS (SELECT *, sum(CASE WHEN py-y>60 THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY rn) AS rises FROM hp),
vf AS (SELECT *, max(rises) OVER (PARTITION BY video, frame) AS rhi, min(rises) OVER (PARTITION BY video, frame) AS rlo FROM vio),
pairs AS (SELECT p.video, p.seq, p.frame AS exit_frame, q.frame AS entry_frame, p.rhi, q.rlo,
  row_number() OVER (PARTITION BY p.video, p.rn ORDER BY q.rn DESC) AS k FROM vf p JOIN vf q ON q.video=p.video AND q.rn<p.rn
  WHERE p.x BETWEEN 50 AND 450 AND p.y>40 AND q.y<30 AND q.x BETWEEN 50 AND 450),
makes AS (SELECT video, seq, exit_frame, entry_frame FROM pairs WHERE k=1 AND exit_frame-entry_frame<=45 AND rhi=rlo)"""


def frame_series() -> Series:
    return Series(("video",), "frame", "seq", 168.0)


def makes(spark, sf):
    hoop = {"x1": F.lit(50.0), "x2": F.lit(450.0), "y1": F.lit(30.0), "y2": F.lit(40.0)}
    return seg.passes_through(detections(spark, sf), frame_series(), hoop, 45, tolerance=60.0)


@query("t11_makes", f"WITH {MAKES} SELECT * FROM makes")
def t11(spark, sf):
    return makes(spark, sf)


@query("t12_anchored_dedup", f"""WITH RECURSIVE {DET},
o AS (SELECT video, seq, t, row_number() OVER (PARTITION BY video ORDER BY t, seq) AS rn FROM det),
f AS (SELECT video, rn, seq, t AS kept_t, true AS kept FROM o WHERE rn=1
  UNION ALL SELECT o.video, o.rn, o.seq, CASE WHEN o.t-f.kept_t>=216000 THEN o.t ELSE f.kept_t END, o.t-f.kept_t>=216000
  FROM f JOIN o ON o.video=f.video AND o.rn=f.rn+1)
SELECT video, seq, round(kept_t, 3) AS t FROM f WHERE kept""")
def t12(spark, sf):
    kept = seg.spaced(detections(spark, sf), by_video(), 60 * HOUR)
    return kept.select("video", "seq", r(F.col("t"), 3).alias("t"))


@query("t13_active_stretches", f"""WITH {DET}, q AS (SELECT site, quantile_cont(y, 0.6) AS p60 FROM det GROUP BY site),
a AS (SELECT det.*, y>p60 AS act FROM det JOIN q USING (site)),
b AS (SELECT *, lag(act) OVER (PARTITION BY site ORDER BY t, seq) AS was FROM a),
c AS (SELECT *, sum(CASE WHEN act AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY t, seq
  ROWS UNBOUNDED PRECEDING)::BIGINT AS stretch FROM b)
SELECT site, stretch, count(*) AS n, round(min(t), 3) AS t0, round(max(t), 3) AS t1, max(y) AS peak FROM c WHERE act
GROUP BY ALL HAVING count(*)>=3""")
def t13(spark, sf):
    det = detections(spark, sf)
    s = Series(("site",), "t", "seq", DAY)
    rows = det.join(quantiles(det, ["site"], "y", {"p60": 0.6}).select("site", "p60"), "site")
    out = seg.true_stretches(rows, s, F.col("y") > F.col("p60"), 3, "y")
    return out.withColumns({"t0": r(F.col("t0"), 3), "t1": r(F.col("t1"), 3)})


@query("t14_streak_lengths", f"""WITH {DET}, a AS (SELECT *, seq%3<>0 AS ok FROM det),
b AS (SELECT *, lag(ok) OVER w AS was FROM a WINDOW w AS (PARTITION BY video ORDER BY t, seq)),
c AS (SELECT *, sum(CASE WHEN ok AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY t, seq
  ROWS UNBOUNDED PRECEDING) AS st FROM b), l AS (SELECT video, st, count(*) AS n FROM c WHERE ok GROUP BY ALL),
h AS (SELECT video, n, count(*) AS streaks FROM l GROUP BY ALL)
SELECT video, n AS length, streaks, max(n) OVER (PARTITION BY video) AS longest FROM h""")
def t14(spark, sf):
    runs = seg.true_stretches(detections(spark, sf), by_video(), F.col("seq") % 3 != 0)
    hist = runs.groupBy("video", F.col("n").alias("length")).agg(F.count("*").alias("streaks"))
    return hist.withColumn("longest", F.max("length").over(seg.Window.partitionBy("video")))


@query("t15_smoothed_peaks", f"""WITH RECURSIVE {DET},
sm AS (SELECT *, avg(y) OVER (PARTITION BY video ORDER BY t, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM det),
pk AS (SELECT *, lag(m, 2) OVER w AS b, lead(m, 2) OVER w AS a FROM sm WINDOW w AS (PARTITION BY video ORDER BY t, seq)),
o AS (SELECT video, t, row_number() OVER (PARTITION BY video ORDER BY t, seq) AS rn FROM pk WHERE m<b-1e-9 AND m<a-1e-9),
f AS (SELECT video, rn, t AS kept_t, 1 AS kept FROM o WHERE rn=1
  UNION ALL SELECT o.video, o.rn, CASE WHEN o.t-f.kept_t>86400 THEN o.t ELSE f.kept_t END, CASE WHEN o.t-f.kept_t>86400 THEN 1 ELSE 0 END
  FROM f JOIN o ON o.video=f.video AND o.rn=f.rn+1),
n AS (SELECT video, count(*) AS points FROM det GROUP BY video), p AS (SELECT video, sum(kept)::BIGINT AS peaks FROM f GROUP BY video)
SELECT video, points, CASE WHEN points<6 THEN 1::BIGINT ELSE greatest(1::BIGINT, coalesce(peaks, 0)) END AS arcs FROM n LEFT JOIN p USING (video)""")
def t15(spark, sf):
    return seg.arc_counts(detections(spark, sf), by_video(), "y", DAY)


@query("t16_first_drop", f"""WITH {DET}, f AS (SELECT video, arg_min(y, (t, seq)) AS y0 FROM det GROUP BY video),
fr AS (SELECT unnest([0.9, 0.75, 0.6, 0.5, 0.4])::DOUBLE AS fraction)
SELECT video, fraction, round(min(CASE WHEN y<y0*fraction THEN t END), 3) AS t FROM det JOIN f USING (video) CROSS JOIN fr GROUP BY ALL""")
def t16(spark, sf):
    out = seg.first_drop_below(detections(spark, sf), by_video(), "y", (0.9, 0.75, 0.6, 0.5, 0.4))
    return out.withColumn("t", r(F.col("t"), 3))


@query("t17_survival", f"""WITH {DET}, p AS (SELECT frame, count(DISTINCT video) AS k FROM det GROUP BY frame),
m AS (SELECT round(avg(k), 6) AS mean_objects FROM p)
SELECT video, count(*) AS frames, min(frame) AS first, max(frame) AS last, arg_min(x, (frame, seq)) AS x_start,
  arg_max(x, (frame, seq)) AS x_end, any_value(mean_objects) AS mean_objects FROM det, m GROUP BY video""")
def t17(spark, sf):
    det = detections(spark, sf)
    per_frame = det.select("frame", "video").distinct().groupBy("frame").count()
    mean = per_frame.agg(r(F.avg("count")).alias("mean_objects"))
    return seg.survival(det, ["video"]).withColumn("mean_objects", mean.scalar())


# ---------------------------------------------------------------- gates


@query("g01_count_gate", f"""WITH {FEATS} SELECT video, site, run_id, n, n BETWEEN 5 AND 20 AS carried,
  n<3 AND NOT (n BETWEEN 5 AND 20) AS rejected FROM feats""")
def g01(spark, sf):
    runs = seg.descent_runs(detections(spark, sf), by_site(), "y", MAX_GAP, JITTER)
    n = runs.groupBy(*KEYS, "run_id").agg(F.count("*").alias("n"))
    carry = ev.carried(F.col("n"), G)
    return n.withColumns({"carried": carry, "rejected": (F.col("n") < G.min_dets) & ~carry})


@query("g02_peak_fall_speed", f"""WITH {FEATS} SELECT video, site, run_id, round(peak_speed, 9) AS peak_speed,
  round(2e-4/greatest(1.0::DOUBLE, least(1.2::DOUBLE, scale)), 9) AS floor_speed FROM feats""")
def g02(spark, sf):
    floor = F.lit(G.peak_fall) / F.greatest(F.lit(1.0), F.least(F.lit(G.fps_cap), F.col("scale")))
    return gated(spark, sf).select(*KEYS, "run_id", r(F.col("peak_speed"), 9).alias("peak_speed"), r(floor, 9).alias("floor_speed"))


@query("g03_fall_distance", f"WITH {FEATS} SELECT video, site, run_id, round(top, 6) AS top, round(fell, 6) AS fell FROM feats")
def g03(spark, sf):
    return gated(spark, sf).select(*KEYS, "run_id", r(F.col("top")).alias("top"), r(F.col("fell")).alias("fell"))


@query("g04_end_near_rim", f"WITH {FEATS} SELECT video, site, run_id, round(end_near, 6) AS end_near FROM feats")
def g04(spark, sf):
    s = sites(spark, sf)
    f = ev.run_features(run_points(spark, sf, s), s, G)
    return f.select(*KEYS, "run_id", r(F.col("end_near")).alias("end_near"))


@query("g05_through_ring", f"WITH {FEATS} SELECT video, site, run_id, round(d_min/rw, 6) AS nearest, through_ring FROM feats")
def g05(spark, sf):
    s = sites(spark, sf)
    f = ev.run_features(run_points(spark, sf, s), s, G)
    return f.select(*KEYS, "run_id", r(F.col("d_min") / F.col("rw")).alias("nearest"), "through_ring")


@query("g06_in_zone", f"WITH {FEATS} SELECT video, site, run_id, in_zone FROM feats")
def g06(spark, sf):
    s = sites(spark, sf)
    return ev.run_features(run_points(spark, sf, s), s, G, zone_corners()).select(*KEYS, "run_id", "in_zone")


@query("g07_rejections", f"""WITH {FEATS}, {MARKS}
SELECT mark, g.site, g.run_id, g.reason, round(g.t0-mt, 3) AS offset_s FROM marks JOIN gated g
ON g.video=marks.video AND g.t0 BETWEEN mt-172800 AND mt+172800 WHERE g.reason IS NOT NULL""")
def g07(spark, sf):
    spans = marks(spark, sf).select("video", "mark", "mt", (F.col("mt") - 2 * DAY).alias("_lo"), (F.col("mt") + 2 * DAY).alias("_hi"))
    rejected = gated(spark, sf).filter(F.col("reason").isNotNull()).select(*KEYS, "run_id", "t0", "reason")
    near = point_in_interval(rejected, spans, ["video"], "t0", "_lo", "_hi", 4 * DAY)
    return near.select("mark", "site", "run_id", "reason", r(F.col("t0") - F.col("mt"), 3).alias("offset_s"))


def _event_columns(df):
    return df.select(*[c for c in ("video", "site", "event_id", "merged_id") if c in df.columns], "n", r(F.col("t0"), 3).alias("t0"),
                     r(F.col("t1"), 3).alias("t1"), r(F.col("d_min")).alias("d_min"), "peak_conf")


@query("g08_bounce_merge", f"""WITH {BOUNCED} SELECT video, site, event_id, n, round(t0, 3) AS t0, round(t1, 3) AS t1,
  round(d_min, 6) AS d_min, peak_conf FROM bounced""")
def g08(spark, sf):
    return _event_columns(bounced(spark, sf, sites(spark, sf)))


@query("g09_near_merge", f"""WITH RECURSIVE {MERGED} SELECT video, site, seq0, merged_id FROM m0""")
def g09(spark, sf):
    return ev.near_merge(bounced(spark, sf, sites(spark, sf)), ["video"], "site", G.near_merge, WIDTH).select("video", "site", "seq0", "merged_id")


@query("g10_overlap_merge", f"""WITH RECURSIVE {MERGED} SELECT video, site, merged_id, n, round(t0, 3) AS t0, round(t1, 3) AS t1,
  round(d_min, 6) AS d_min, peak_conf FROM merged""")
def g10(spark, sf):
    return _event_columns(merged(spark, sf))


@query("g11_approach_gate", f"""WITH RECURSIVE {FINAL} SELECT video, site, merged_id, round(closed, 6) AS closed,
  round(nearest, 6) AS nearest, at_hoop FROM appr2""")
def g11(spark, sf):
    return ev.approach_gate(merged(spark, sf), G).select(
        "video", "site", "merged_id", r(F.col("closed")).alias("closed"), r(F.col("nearest")).alias("nearest"), "at_hoop")


@query("g12_event_windows", f"""WITH RECURSIVE {WINDOWS} SELECT video, site, merged_id, round(clip_start, 3) AS clip_start,
  round(clip_stop, 3) AS clip_stop FROM win""")
def g12(spark, sf):
    w = windows(spark, sf, sites(spark, sf))
    return w.select("video", "site", "merged_id", r(F.col("clip_start"), 3).alias("clip_start"), r(F.col("clip_stop"), 3).alias("clip_stop"))


@query("g13_event_index", f"""WITH RECURSIVE {WINDOWS} SELECT video, row_number() OVER (PARTITION BY video ORDER BY t0, seq0) AS n, site,
  round(t0, 2) AS t, round(t1, 2) AS t_end, round(clip_start, 2) AS clip_start, round(clip_stop, 2) AS clip_stop,
  (trunc(t0)::BIGINT//60)::VARCHAR || ':' || lpad((trunc(t0)::BIGINT%60)::VARCHAR, 2, '0') AS clock, n AS dets,
  round(peak_conf, 3) AS peak_conf FROM win""")
def g13(spark, sf):
    s = sites(spark, sf)
    return ev.event_index(windows(spark, sf, s), ["video"], "site", WIDTH, s.whole)


FIT_SQL = """rel AS (SELECT video, site, run_id, t-min(t) OVER p AS tt, x, y, min(t) OVER p AS t0, max(t) OVER p AS t1 FROM runs
  WINDOW p AS (PARTITION BY video, site, run_id)),
hrs AS (SELECT video, site, run_id, tt/3600.0::DOUBLE AS h, x-avg(x) OVER p AS x, y-avg(y) OVER p AS y, avg(x) OVER p AS mx,
  avg(y) OVER p AS my, t0, t1 FROM rel WINDOW p AS (PARTITION BY video, site, run_id)),
mo AS (SELECT video, site, run_id, count(*)::DOUBLE AS n, any_value(t0) AS t0, any_value(t1) AS t1, any_value(mx) AS mx,
  any_value(my) AS my, sum(h) AS s1, sum(h*h) AS s2, sum(h*h*h) AS s3, sum(h*h*h*h) AS s4, sum(x) AS sx, sum(h*x) AS stx,
  sum(x*x) AS sxx, sum(y) AS sy, sum(h*y) AS sty, sum(h*h*y) AS stty, sum(y*y) AS syy FROM hrs GROUP BY ALL),
dt AS (SELECT *, n*s2-s1*s1 AS den, s4*(s2*n-s1*s1)-s3*(s3*n-s1*s2)+s2*(s3*s1-s2*s2) AS det FROM mo),
fit0 AS (SELECT *, n>=4 AND abs(den)>=1e-9 AND abs(det)>abs(s4*s2*n)*1e-13 AS ok FROM dt),
fit AS (SELECT *, CASE WHEN ok THEN (stty*(s2*n-s1*s1)-s3*(sty*n-s1*sy)+s2*(sty*s1-s2*sy))/det END AS a,
  CASE WHEN ok THEN (s4*(sty*n-s1*sy)-stty*(s3*n-s1*s2)+s2*(s3*sy-sty*s2))/det END AS b,
  CASE WHEN ok THEN (s4*(s2*sy-sty*s1)-s3*(s3*sy-sty*s2)+stty*(s3*s1-s2*s2))/det END AS c,
  CASE WHEN ok THEN (n*stx-s1*sx)/den END AS d,
  CASE WHEN ok THEN (sx-(n*stx-s1*sx)/den*s1)/n END AS e FROM fit0)"""


def run_fits(spark, sf) -> DataFrame:
    """Ballistic fits of the descent runs, with time in hours."""
    runs = seg.descent_runs(detections(spark, sf), by_site(), "y", MAX_GAP, JITTER)
    return kin.fit_arcs(runs.withColumn("h", F.col("t") / HOUR), [*KEYS, "run_id"], "h")


@query("g14_free_fall", f"""WITH {RUNS}, {FIT_SQL}, sp AS (SELECT video, site, run_id,
  max(CASE WHEN st=0 AND t>pt THEN abs(y-py)/((t-pt)/3600.0::DOUBLE) END) AS max_speed FROM runs GROUP BY ALL)
SELECT video, site, run_id, fit.n::BIGINT AS n, round(a, 4) AS a, coalesce(fit.n>=6 AND (t1-t0)/3600.0>=1 AND a>=0.001
  AND max_speed>=1, false) AS falls FROM fit JOIN sp USING (video, site, run_id)""")
def g14(spark, sf):
    pts = run_points(spark, sf)
    gap = (F.col("t") - F.col("prev_t")) / HOUR
    speed = pts.groupBy(*KEYS, "run_id").agg(F.max(F.when(gap > 0, F.abs(F.col("y") - F.col("prev_y")) / gap)).alias("max_speed"))
    fits = run_fits(spark, sf).join(speed, [*KEYS, "run_id"])
    falls = ev.free_fall(6, 1.0, 0.001, 1.0)
    return fits.select(*KEYS, "run_id", "n", r(F.col("a"), 4).alias("a"), falls.alias("falls"))


@query("g16_merged_pairs", f"""WITH {BOUNCED}, p AS (SELECT video, site, run_id, t0, t0-pend AS pause,
  lag(y1) OVER (PARTITION BY video, site ORDER BY t0, seq0)-y0 AS rise FROM k0)
SELECT video, site, run_id, round(pause, 3) AS pause, round(rise, 6) AS rise FROM p WHERE pause<=172800""")
def g16(spark, sf):
    s = sites(spark, sf)
    pairs = ev.merge_pairs(kept_runs(spark, sf, s), KEYS, G.bounce_gap, WIDTH, s.whole)
    return pairs.select(*KEYS, "run_id", r(F.col("pause"), 3).alias("pause"), r(F.col("rise")).alias("rise"))


@query("a01_ballistic_fit", f"""WITH {RUNS}, {FIT_SQL}
SELECT video, site, run_id, n::BIGINT AS n, round(a, 4) AS a, round(b, 4) AS b, round(c+my, 4) AS c, round(d, 4) AS d, round(e+mx, 4) AS e,
  round(CASE WHEN ok THEN sqrt(greatest(sxx-d*stx-e*sx+syy-a*stty-b*sty-c*sy, 0)/n) END, 3) AS rms FROM fit""")
def a01(spark, sf):
    f = run_fits(spark, sf)
    return f.select(*KEYS, "run_id", "n", *[r(F.col(c), 4).alias(c) for c in "abcde"], r(F.col("rms"), 3).alias("rms"))


@query("a02_arc_polyline", f"""WITH {RUNS}, {FIT_SQL}, g AS (SELECT *, (t1-t0)/3600.0::DOUBLE AS span FROM fit WHERE a IS NOT NULL),
p AS (SELECT *, unnest(range(25)) AS i FROM g)
SELECT video, site, run_id, i, round(d*(span*i/24)+e+mx, 3) AS px, round(a*(span*i/24)*(span*i/24)+b*(span*i/24)+c+my, 3) AS py,
  round(abs(a)*span*span/8, 3) AS sag FROM p""")
def a02(spark, sf):
    f = run_fits(spark, sf).filter(F.col("a").isNotNull())
    pts = f.withColumn("_p", F.explode(kin.polyline(F.col("t0"), F.col("t1"))))
    return pts.select(*KEYS, "run_id", F.col("_p.i").cast("long").alias("i"), r(F.col("_p.x"), 3).alias("px"), r(F.col("_p.y"), 3).alias("py"),
                      r(kin.sag(F.col("a"), F.col("t0"), F.col("t1")), 3).alias("sag"))


