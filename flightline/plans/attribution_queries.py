"""Attribution (B) and remaining event-level queries (G-15, G-17, G-18, A-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.functions import pose
from flightline.functions.geometry import box_distance, num
from flightline.operators import attribution as at
from flightline.operators.blocks import Series
from flightline.operators.joins import point_in_interval
from flightline.plans.event_queries import SUMMARY, found_descents
from flightline.plans.geometry_queries import POSE, poses
from flightline.plans.inputs import DAY, DET, HOUR, MARKS, detections, marks, r
from flightline.plans.registry import query

PEOPLE = Series(("video", "site"), "t", "seq", 7 * DAY)


@query("b01_nearest_person", f"""WITH {DET}, j AS (SELECT b.seq AS ball, p.seq AS person, p.frame, (p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y) AS d2,
  row_number() OVER (PARTITION BY b.seq ORDER BY p.frame DESC, (p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y), p.seq) AS k
  FROM det b JOIN det p ON p.video=b.video AND p.frame BETWEEN b.frame-19 AND b.frame WHERE b.site='purchase' AND p.site='view')
SELECT det.seq AS ball, person, j.frame, round(d2, 4) AS d2 FROM det LEFT JOIN j ON j.ball=det.seq AND k=1 WHERE site='purchase'""")
def b01(spark, sf):
    d = detections(spark, sf)
    balls = d.filter("site = 'purchase'").select("video", F.col("seq").alias("ball"), "frame", "x", "y")
    people = d.filter("site = 'view'").select("video", F.col("seq").alias("person"), "frame", "x", "y")
    out = at.nearest_person(balls, people, ["video"])
    return out.select("ball", "person", "frame", r(F.col("d2"), 4).alias("d2"))


@query("b02_lift_and_gap", f"""WITH {POSE}, q AS (SELECT *, greatest(12.0::DOUBLE, sn) AS sw, 150+(vec_id%100)::DOUBLE AS bx, 200+(vec_id%70)::DOUBLE AS ball_y FROM pp)
SELECT vec_id, round(CASE WHEN hy0 IS NOT NULL AND sh AND (c9>0.3 OR c10>0.3) THEN greatest(CASE WHEN c9>0.3 THEN hy0-y9 END, CASE WHEN c10>0.3 THEN hy0-y10 END)/sw END, 6) AS lift,
 round(CASE WHEN hy0 IS NOT NULL AND sh AND (c9>0.3 OR c10>0.3) THEN least(CASE WHEN c9>0.3 THEN sqrt((x9-bx)*(x9-bx)+(y9-ball_y)*(y9-ball_y)) END, CASE WHEN c10>0.3 THEN sqrt((x10-bx)*(x10-bx)+(y10-ball_y)*(y10-ball_y)) END)/sw END, 6) AS gap FROM q""")
def b02(spark, sf):
    lift, gap = pose.lift_and_gap(F.col("kp"), (F.col("vec_id") % 100 + 150).cast("double"), (F.col("vec_id") % 70 + 200).cast("double"))
    return poses(spark, sf).select("vec_id", r(lift).alias("lift"), r(gap).alias("gap"))


def hand_series(spark, sf) -> DataFrame:
    """Each user and site as one person's series of gap to the ball and hand height."""
    return detections(spark, sf).withColumns({"gap": F.col("y") / 40, "lift": F.col("x") / 250 - 0.8})


HANDS = f"""{DET}, ser AS (SELECT *, y/40 AS gap, x/250-0.8::DOUBLE AS lift FROM det),
aft AS (SELECT *, list(gap) OVER (PARTITION BY video, site ORDER BY t, seq ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS after FROM ser),
rl AS (SELECT * FROM aft WHERE gap<=0.9 AND len(after)>=2 AND after[len(after)]>gap+0.6
  AND list_bool_and([after[i+1]>=after[i]-0.15 for i in range(1, len(after))])),
rel AS (SELECT video, site, arg_max(t, (t, seq)) AS rt, arg_max(gap, (t, seq)) AS gap, arg_max(lift, (t, seq)) AS lift, arg_max(after[len(after)]-gap, (t, seq)) AS grew FROM rl GROUP BY ALL)"""


@query("b03_releases", f"WITH {HANDS} SELECT video, site, round(rt, 3) AS t, round(gap, 6) AS gap, round(lift, 6) AS lift, round(grew, 6) AS grew FROM rel")
def b03(spark, sf):
    out = at.releases(hand_series(spark, sf), PEOPLE)
    return out.select("video", "site", r(F.col("t"), 3).alias("t"), *[r(F.col(c)).alias(c) for c in ("gap", "lift", "grew")])


@query("b04_candidates", f"""WITH {HANDS}, n AS (SELECT video, site, count(*) AS n_seen FROM ser GROUP BY ALL)
SELECT video, site, n_seen, round(gap, 6) AS gap, row_number() OVER (PARTITION BY video ORDER BY gap, rt DESC, site) AS rank FROM rel JOIN n USING (video, site) WHERE n_seen>=4 AND lift>0""")
def b04(spark, sf):
    c = at.candidates(hand_series(spark, sf), PEOPLE, ["video"])
    return c.select("video", "site", "n_seen", r(F.col("gap")).alias("gap"), "rank")


def samples(spark, sf) -> DataFrame:
    side = F.when(F.col("seq") % 7 != 0, F.col("seq") % 3 - 1)
    return hand_series(spark, sf).withColumn("side", side).select("video", "site", "t", "gap", "lift", "side", "seq", "x", "y", "w")


@query("b05_people_at", f"""WITH {HANDS}, {MARKS}, s AS (SELECT *, CASE WHEN seq%7<>0 THEN seq%3-1 END AS side FROM ser),
nv AS (SELECT video, site FROM ser GROUP BY ALL HAVING min(gap)>4),
j AS (SELECT mark, s.*, row_number() OVER (PARTITION BY mark, site ORDER BY abs(t-mt), t) AS k FROM marks JOIN s USING (video) WHERE abs(t-mt)<=21600 AND (video, site) NOT IN (SELECT (video, site) FROM nv))
SELECT mark, site, seq, round(gap, 6) AS gap, lift>0 AS up FROM j WHERE k=1 AND NOT (coalesce(side=0, false) AND NOT lift>0)""")
def b05(spark, sf):
    out = at.people_at(marks(spark, sf).select("video", "mark", "mt"), samples(spark, sf), ["video"], ["mark"], "site", "mt", 6 * HOUR)
    return out.select("mark", "site", "seq", r(F.col("gap")).alias("gap"), (F.col("lift") > 0).alias("up"))


def shot_inputs(spark, sf):
    """A purchase is a shot: a made-up arc from its own sighting, and the people seen around it."""
    m = marks(spark, sf)
    d = detections(spark, sf).filter("site = 'purchase'").select(F.col("seq").alias("mark"), "x", "y", "w")
    fl = m.join(d, "mark").select("video", "mark", (F.col("mt") / HOUR).alias("release_t"), (F.col("mt") / HOUR).alias("t0"), F.col("x").alias("release_x"),
                                  F.col("y").alias("release_y"), F.col("x").alias("e"), F.col("y").alias("c"), (F.col("w") * 20).alias("d"),
                                  num(-40.0).alias("b"), num(30.0).alias("a"))
    ppl = at.people_at(m.select("video", "mark", "mt"), samples(spark, sf).filter("site <> 'purchase'"), ["video"], ["mark"], "site", "mt", 12 * HOUR)
    ppl = ppl.select("mark", F.col("site").alias("person"), (F.col("x") - F.col("w")).alias("px1"), (F.col("y") - F.col("w") * 3).alias("py1"),
                     (F.col("x") + F.col("w")).alias("px2"), (F.col("y") + F.col("w") * 3).alias("py2"), (F.col("lift") > 0).alias("up"),
                     (F.col("side") * F.col("lift")).alias("turn"), F.when(F.col("seq") % 2 == 0, F.col("lift")).alias("face"))
    return m, fl, ppl


def moving_people(spark, sf) -> DataFrame:
    """Everyone's sightings with boxes, time in hours."""
    return samples(spark, sf).filter("site <> 'purchase'").select(
        "video", F.col("site").alias("person"), "seq", (F.col("t") / HOUR).alias("t"), "gap", "lift", "side", (F.col("x") - F.col("w")).alias("px1"),
        (F.col("y") - F.col("w") * 3).alias("py1"), (F.col("x") + F.col("w")).alias("px2"), (F.col("y") + F.col("w") * 3).alias("py2"))


FLIGHT = f"""{HANDS}, {MARKS}, s AS (SELECT *, CASE WHEN seq%7<>0 THEN seq%3-1 END AS side FROM ser WHERE site<>'purchase'),
nv AS (SELECT video, site FROM s GROUP BY ALL HAVING min(gap)>4),
j AS (SELECT mark, s.*, row_number() OVER (PARTITION BY mark, site ORDER BY abs(t-mt), t) AS k FROM marks JOIN s USING (video) WHERE abs(t-mt)<=43200 AND (video, site) NOT IN (SELECT (video, site) FROM nv)),
ppl AS (SELECT mark, site AS person, x-w AS px1, y-w*3 AS py1, x+w AS px2, y+w*3 AS py2, lift>0 AS up FROM j WHERE k=1 AND NOT (coalesce(side=0, false) AND NOT lift>0)),
fl AS (SELECT marks.video, mark, mt/3600.0::DOUBLE AS rt, x AS e, y AS c, w*20 AS d FROM marks JOIN det ON det.seq=mark)"""


@query("a07_walk_back", f"""WITH {FLIGHT}, st AS (SELECT fl.*, i AS k, rt-i*(1.0::DOUBLE/60.0::DOUBLE) AS tk FROM fl, (SELECT unnest(range(1, 73)) AS i)),
nr AS (SELECT st.mark, k, tk-rt AS tt, d, e, c, s.site AS person, s.x-s.w AS px1, s.y-s.w*3 AS py1, s.x+s.w AS px2, s.y+s.w*3 AS py2, s.side, s.lift,
  row_number() OVER (PARTITION BY st.mark, k, s.site ORDER BY abs(s.t/3600.0::DOUBLE-tk), s.t, s.seq) AS n
  FROM st JOIN s USING (video) WHERE abs(s.t/3600.0::DOUBLE-tk)<=12 AND (s.video, s.site) NOT IN (SELECT (video, site) FROM nv)),
xy AS (SELECT *, d*tt+e AS x, 30*tt*tt-40*tt+c AS y FROM nr WHERE n=1 AND NOT (coalesce(side=0, false) AND NOT lift>0)),
h AS (SELECT mark, person, k, sqrt(pow(greatest(px1-x, 0, x-px2), 2)+pow(greatest(py1-y, 0, y-py2), 2)) AS dist FROM xy),
b AS (SELECT *, row_number() OVER (PARTITION BY mark ORDER BY k, person) AS rk FROM h WHERE dist<=90) SELECT mark, k AS steps, person, round(dist, 3) AS dist FROM b WHERE rk=1""")
def a07(spark, sf):
    """Hours for seconds, as sightings are hours apart; people are looked up again at every step."""
    _, fl, _ = shot_inputs(spark, sf)
    seen = moving_people(spark, sf)
    out = at.walk_back_among(fl, seen, ["video"], ["mark"], near=12.0)
    return out.select("mark", F.col("steps").cast("long").alias("steps"), "person", r(F.col("dist"), 3).alias("dist"))


@query("b06_attribution")
def b06(spark, sf):
    m, fl, ppl = shot_inputs(spark, sf)
    cands = at.candidates(hand_series(spark, sf), PEOPLE, ["video"]).filter("rank = 1").select("video", F.col("site").alias("person"), "rank")
    cands = m.select("video", "mark").join(cands, "video").select("mark", "person", "rank")
    caps = detections(spark, sf).filter("site = 'click'").select("video", F.col("seq").alias("cap"), (F.col("t") / HOUR).alias("t"), "x", "y", "w")
    out = at.attribute(m.select("mark"), fl, ppl, cands, ["mark"], moving_people(spark, sf), caps, ["video"], near_s=12.0, cap_s=12.0)
    return out.select("mark", "person", "cap", r(F.col("dist"), 2).alias("dist"), "how")


@query("b07_cap_fallback", f"""WITH {DET}, o AS (SELECT seq AS shot, video, t, x, y, CASE WHEN seq%3<>0 THEN y END AS wrist FROM det WHERE site='purchase'),
j AS (SELECT shot, c.seq AS cap, c.w, sqrt((c.x-o.x)*(c.x-o.x)+(c.y-o.y)*(c.y-o.y)) AS d FROM o JOIN det c ON c.video=o.video AND c.site='click' AND abs(c.t-o.t)<=43200 WHERE wrist IS NULL OR wrist>110),
k AS (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY d, cap) AS rk FROM j) SELECT shot, cap, round(d, 4) AS dist FROM k WHERE rk=1 AND d<=5*greatest(28, w)""")
def b07(spark, sf):
    d = detections(spark, sf)
    o = d.filter("site = 'purchase'").select("video", F.col("seq").alias("shot"), "t", "x", "y", F.when(F.col("seq") % 3 != 0, F.col("y")).alias("wrist"))
    caps = d.filter("site = 'click'").select("video", F.col("seq").alias("cap"), "t", "x", "y", "w")
    out = at.cap_fallback(o, caps, ["video"], ["shot"], near_s=12 * HOUR)
    return out.select("shot", "cap", r(F.col("dist"), 4).alias("dist"))


@query("b08_origin_candidate", f"""WITH {FLIGHT}, p AS (SELECT video, site AS person, t/3600.0::DOUBLE AS t, x-w AS px1, y-w*3 AS py1, x+w AS px2, y+w*3 AS py2 FROM det WHERE site<>'purchase'),
h AS (SELECT mark, person, d*(t-rt)+e AS ax, 30*(t-rt)*(t-rt)-40*(t-rt)+c AS ay, px1, py1, px2, py2 FROM fl JOIN p USING (video) WHERE t BETWEEN rt-20 AND rt+5),
g AS (SELECT mark, person, sqrt(pow(greatest(px1-ax, 0, ax-px2), 2)+pow(greatest(py1-ay, 0, ay-py2), 2)) AS dist FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY mark ORDER BY dist, person) AS rk FROM g) SELECT mark, person, round(dist, 3) AS dist FROM k WHERE rk=1""")
def b08(spark, sf):
    _, fl, _ = shot_inputs(spark, sf)
    d = detections(spark, sf).filter("site <> 'purchase'")
    p = d.select("video", F.col("site").alias("person"), (F.col("t") / HOUR).alias("t"), (F.col("x") - F.col("w")).alias("px1"), (F.col("y") - F.col("w") * 3).alias("py1"),
                 (F.col("x") + F.col("w")).alias("px2"), (F.col("y") + F.col("w") * 3).alias("py2"))
    out = at.origin_candidate(fl, p, ["video"], ["mark"], 20.0, 5.0)
    return out.select("mark", "person", r(F.col("dist"), 3).alias("dist"))


@query("b09_stage_funnel", f"""WITH {DET}, s AS (SELECT *, y>20 AS a, x>100 AS b, conf>0.5 AS c FROM det),
f AS (SELECT count(*) AS s0, count(*) FILTER (a) AS s1, count(*) FILTER (a AND b) AS s2, count(*) FILTER (a AND b AND c) AS s3 FROM s)
SELECT unnest([0, 1, 2, 3])::BIGINT AS stage_no, unnest(['shots', 'ball seen in flight', 'arc found', 'shooter found']) AS stage, unnest([s0, s1, s2, s3]) AS reached FROM f""")
def b09(spark, sf):
    stages = [("shots", F.lit(True)), ("ball seen in flight", F.col("y") > 20), ("arc found", F.col("x") > 100), ("shooter found", F.col("conf") > 0.5)]
    return at.funnel(detections(spark, sf), stages)


@query("b10_gate_report", f"""WITH {HANDS}, b AS (SELECT video, site, count(*) AS frames, min(gap) AS min_gap, max(lift) AS max_lift FROM ser GROUP BY ALL HAVING count(*)>=2)
SELECT b.video, b.site, frames, round(min_gap, 6) AS min_gap, round(max_lift, 6) AS max_lift, CASE WHEN rel.lift IS NULL THEN '-' WHEN rel.lift>0 THEN 'OK' ELSE 'handsdown' END AS release
FROM b LEFT JOIN rel USING (video, site)""")
def b10(spark, sf):
    out = at.gate_report(hand_series(spark, sf), PEOPLE)
    return out.select("video", "site", "frames", r(F.col("min_gap")).alias("min_gap"), r(F.col("max_lift")).alias("max_lift"), "release")


@query("g15_separation", f"""WITH {DET}, n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, seq)-1 AS i, count(*) OVER (PARTITION BY video) AS n FROM det WHERE site='purchase'),
s AS (SELECT * FROM n WHERE i%greatest(1, n//5)=0), p AS (SELECT video, frame, x-20 AS px1, x+20 AS px2, y-30 AS py1, y+30 AS py2 FROM det WHERE site<>'purchase'),
d AS (SELECT s.seq, s.video, s.w, min(sqrt(pow(greatest(px1-s.x, 0, s.x-px2), 2)+pow(greatest(py1-s.y, 0, s.y-py2), 2))) AS d FROM s JOIN p ON p.video=s.video AND p.frame BETWEEN s.frame-6 AND s.frame+6 GROUP BY ALL)
SELECT video, round(max(d/greatest(24, w)), 6) AS best, max(d/greatest(24, w))>=3 AS separates FROM d GROUP BY video""")
def g15(spark, sf):
    from flightline.operators.blocks import running
    d = detections(spark, sf)
    ball = running(d.filter("site = 'purchase'"), Series(("video",), "t", "seq", 7 * DAY), {"i": ("sum", F.lit(1).cast("long"))})
    n = d.filter("site = 'purchase'").groupBy("video").agg(F.count("*").alias("n"))
    s = ball.join(n, "video").filter((F.col("i") - 1) % F.greatest(F.lit(1), F.floor(F.col("n") / 5)) == 0)
    spans = s.select("video", F.col("seq").alias("bs"), F.col("x").alias("bx"), F.col("y").alias("by_"), F.col("w").alias("bw"),
                     (F.col("frame") - 6).alias("_lo"), (F.col("frame") + 6).alias("_hi"))
    near = point_in_interval(d.filter("site <> 'purchase'").select("video", "frame", "x", "y"), spans, ["video"], "frame", "_lo", "_hi", 24)
    away = box_distance(F.col("bx"), F.col("by_"), F.col("x") - 20, F.col("y") - 30, F.col("x") + 20, F.col("y") + 30)
    per = near.groupBy("video", "bs").agg(F.min(away).alias("d"), F.max("bw").alias("bw"))
    best = F.max(F.col("d") / F.greatest(F.lit(24.0), F.col("bw")))
    return per.groupBy("video").agg(best.alias("b")).select("video", r(F.col("b")).alias("best"), (F.col("b") >= 3).alias("separates"))


@query("g17_merge_verdicts", """SELECT CASE WHEN toxic=1 THEN 'not a shot' WHEN quality=1 AND doc_id%3=0 THEN 'two' WHEN quality=1 THEN 'one' ELSE 'duplicate' END AS verdict, count(*) AS n FROM labels GROUP BY 1""")
def g17(spark, sf):
    from flightline.plans.inputs import table
    from flightline.sources.labels import label_counts
    v = (F.when(F.col("toxic") == 1, "not a shot").when((F.col("quality") == 1) & (F.col("doc_id") % 3 == 0), "two").when(F.col("quality") == 1, "one").otherwise("duplicate"))
    return label_counts(table(spark, sf, "labels").withColumn("verdict", v), "verdict").withColumnRenamed("label", "verdict")


@query("g18_air_window", f"""WITH {SUMMARY}, {MARKS}, k AS (SELECT d.*, (SELECT max(mt) FROM marks m WHERE m.video=d.video AND m.mt BETWEEN d.t0-172800 AND d.t0-1e-6) AS release FROM desc3 d),
p AS (SELECT k.video, k.site, k.run_id, k.t0, k.t1, k.release, min(det.t) AS first, max(CASE WHEN det.t<=k.t1+43200 THEN det.t END) AS last FROM k JOIN det ON det.video=k.video AND det.site=k.site AND det.t BETWEEN k.t0-172800 AND k.t1+129600 GROUP BY ALL),
w AS (SELECT *, greatest(t1, last) AS air1, coalesce(release, first) AS s0 FROM p)
SELECT video, site, run_id, round(greatest(s0, air1-259200), 3) AS air0, round(air1, 3) AS air1, release IS NOT NULL AS known, air1-s0>259200 AS capped FROM w""")
def g18(spark, sf):
    from flightline.operators.air import air_windows
    _, found = found_descents(spark, sf)
    rel = marks(spark, sf).select("video", F.col("mt").alias("rt"))
    out = air_windows(found, rel, detections(spark, sf).select("video", "site", "t"), ["video", "site"], ["video"], 2 * DAY, 1.5 * DAY, 0.5 * DAY, 3 * DAY)
    return out.select("video", "site", "run_id", r(F.col("air0"), 3).alias("air0"), r(F.col("air1"), 3).alias("air1"), "known", "capped")


