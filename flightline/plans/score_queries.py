"""Scoring, sweep, diagnosis and model (E) queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightline.operators import attribution as at
from flightline.operators import diagnosis as dg
from flightline.operators import events as ev
from flightline.operators import matching as mt
from flightline.operators import models as md
from flightline.operators import sweeps as sw
from flightline.operators.blocks import Series, running
from flightline.operators.quantiles import quantiles
from flightline.operators.scoring import one, rank_auc
from flightline.plans.attribution_queries import HANDS, PEOPLE, hand_series
from flightline.plans.event_queries import FEATS, G, KEYS, WIDTH, gated, run_points, sites
from flightline.plans.feature_queries import run_features
from flightline.plans.geometry_queries import RIG, rigged
from flightline.plans.inputs import DAY, DET, MARKS, detections, marks, r, table
from flightline.plans.match_queries import FLAGS, TOL, mark_flags, matched
from flightline.plans.registry import query
from flightline.runtime import cut

STEPS = [0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0]


@query("e08_zone_size_grid", f"""WITH {RIG}, o AS (SELECT kind='F' AS make, abs((x-(rx1+rx2)/2)/12) AS s, abs((y-30)/24) AS d FROM rig), t AS (SELECT count(*) FILTER (make) AS all_makes FROM o),
st AS (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0])::DOUBLE AS v), g AS (SELECT a.v AS half, b.v AS depth, count(*) FILTER (make AND s<=a.v AND d<=b.v) AS makes_in,
  count(*) FILTER (NOT make AND s<=a.v AND d<=b.v) AS misses_in FROM o, st a, st b GROUP BY ALL),
k AS (SELECT *, makes_in>=0.9::DOUBLE*all_makes AS ok FROM g, t) SELECT half, depth, makes_in, misses_in, ok AND row_number() OVER (ORDER BY ok DESC, half*depth, abs(half-depth), half)=1 AS chosen FROM k""")
def e08(spark, sf):
    p = rigged(spark, sf)
    s, d = F.abs((F.col("x") - (F.col("rx1") + F.col("rx2")) / 2) / 12), F.abs((F.col("y") - 30) / 24)
    make = F.col("kind") == "F"
    desc = STEPS[::-1]
    g = sw.grid_counts(p, s, desc, d, desc, {"makes_in": one(make), "misses_in": one(~make)}, lambda v, t: v <= t, lambda v, t: v <= t, either=False)
    total = p.agg(F.sum(one(make)).alias("all"))
    k = g.withColumn("ok", F.col("makes_in") >= 0.9 * total.scalar())
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("ok").desc(), F.col("a") * F.col("b"), F.abs(F.col("a") - F.col("b")), "a")
    return k.select(F.col("a").alias("half"), F.col("b").alias("depth"), "makes_in", "misses_in", (F.col("ok") & (F.row_number().over(w) == 1)).alias("chosen"))


GROWS = (1.0, 1.5, 2.0, 2.5, 4.0)


@query("e09_zone_grow_sweep")
def e09(spark, sf):
    """All zone sizes at once: a run's zone size is the smallest one holding a point, so the gates run on run rows."""
    from flightline.functions.geometry import zone_box
    s = sites(spark, sf)
    pts = run_points(spark, sf, s)
    b = zone_box(F.col("x1"), F.col("y2"), F.col("x2"))
    gauge = F.greatest(F.abs(F.col("x") - (b[0] + b[2]) / 2) / ((b[2] - b[0]) / 2), F.abs(F.col("y") - (b[1] + b[3]) / 2) / ((b[3] - b[1]) / 2))
    if s.whole:
        feats = ev.run_features(ev.over_site(pts, s, G).withColumn("_need", gauge), s, G).drop("scale")
    else:
        need = pts.groupBy(*KEYS, "run_id").agg(F.min(gauge).alias("need"))
        feats = ev.add_window_top(ev.run_features(pts, s, G), detections(spark, sf), s, G, 2 * DAY).join(need, [*KEYS, "run_id"])
    rows = feats.withColumn("grow", F.explode(F.array(*[F.lit(g) for g in GROWS]))).withColumn("in_zone", F.col("need") <= F.col("grow"))
    kept = ev.gate_runs(rows, G).filter(F.col("reason").isNull())
    events = ev.merge_events(ev.bounce_merge(kept, ["grow", *KEYS], G.bounce_gap, WIDTH, s.whole), ["grow", "video"], "site", G.near_merge, WIDTH)
    events = cut(ev.approach_gate(events, G).filter("at_hoop"))
    found = events.select("grow", "video", F.col("merged_id").alias("call"), F.col("t0").alias("ct"), F.lit(None).cast("long").alias("choop"))
    m = marks(spark, sf).withColumn("mhoop", F.lit(None).cast("long"))
    pairs = mt.candidate_pairs(m, found, ["video"], TOL).select(
        "grow", "video", "mark", "call", "dt", "outcome", F.least("mt", "ct").alias("_from"), F.greatest("mt", "ct").alias("_to"), F.struct("mark", "call").alias("_pair"))
    span = Series(("grow", "video"), "_from", "_pair", 256 * TOL)
    hit = mt.greedy_in_parts(pairs, span, ["grow", "mark"], ["grow", "call"], [F.col("dt"), F.col("mark"), F.col("call")], F.col("_to"))
    a = hit.groupBy("grow").agg(F.count("*").alias("found"), F.count_if(F.col("outcome") == "make").alias("makes_found"))
    n = found.groupBy("grow").agg(F.count("*").alias("called"))
    return n.join(a, "grow", "left").na.fill(0).select("grow", "found", "makes_found", (F.col("called") - F.col("found")).alias("extra"))


def _combos():
    return [(t, o, w) for t in (0.9, 1.2, 1.6) for o in (0.6, 0.4, 0.25) for w in (5, 8)]


@query("e10_release_sweep", f"""WITH {HANDS}, w AS (SELECT *, list(gap) OVER (PARTITION BY video, site ORDER BY t, seq ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS g5,
  list(gap) OVER (PARTITION BY video, site ORDER BY t, seq ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS g8, count(*) OVER (PARTITION BY video, site) AS n FROM ser),
c AS (SELECT * FROM (SELECT unnest([0.9, 1.2, 1.6])::DOUBLE AS touch), (SELECT unnest([0.6, 0.4, 0.25])::DOUBLE AS opened), (SELECT unnest([5, 8]) AS win)),
x AS (SELECT w.*, c.*, CASE WHEN win=5 THEN g5 ELSE g8 END AS g FROM w, c WHERE n>=4),
rls AS (SELECT * FROM x WHERE gap<=touch AND len(g)>=2 AND g[len(g)]>gap+opened AND list_bool_and([g[i+1]>=g[i]-0.15 for i in range(1, len(g))])),
p AS (SELECT video, site, touch, opened, win, arg_max(lift, (t, seq)) AS lift FROM rls GROUP BY ALL), l AS (SELECT unnest([0.0, -0.25, -0.6])::DOUBLE AS lift_min),
s AS (SELECT touch, opened, win, lift_min, video, count(*) FILTER (lift>lift_min) AS k FROM p, l GROUP BY ALL)
SELECT touch, opened, win::BIGINT AS win, lift_min, count(*) FILTER (k>0) AS answered, round(sum(k)/greatest(1, count(*) FILTER (k>0))::DOUBLE, 6) AS mean_candidates FROM s GROUP BY ALL""")
def e10(spark, sf):
    rows = at.with_next_gaps(hand_series(spark, sf), PEOPLE, 8)
    big = rows.groupBy(*KEYS).agg(F.count("*").alias("n_all")).filter("n_all >= 4").select(*KEYS)
    combos = _combos()
    hit = lambda t, o, w: F.when(at.is_release(F.slice("after", 1, w), F.col("gap"), t, o), F.struct("t", "seq"))
    per = rows.filter(F.size("after") >= 2).join(big, KEYS, "left_semi").groupBy(*KEYS).agg(
        *[F.max_by("lift", hit(*c)).alias(f"c{i}") for i, c in enumerate(combos)])
    counts = per.groupBy("video").agg(*[F.count_if(F.col(f"c{i}") > m).alias(f"k{i}_{j}") for i in range(len(combos)) for j, m in enumerate((0.0, -0.25, -0.6))])
    cells = [F.struct(F.lit(t).alias("touch"), F.lit(o).alias("opened"), F.lit(w).cast("long").alias("win"), F.lit(m).alias("lift_min"), F.col(f"k{i}_{j}").alias("k"))
             for i, (t, o, w) in enumerate(combos) for j, m in enumerate((0.0, -0.25, -0.6))]
    long = counts.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    out = long.groupBy("touch", "opened", "win", "lift_min").agg(F.count_if(F.col("k") > 0).alias("answered"), F.sum("k").alias("_k"))
    return out.select("touch", "opened", "win", "lift_min", "answered", r(F.col("_k") / F.greatest(F.lit(1), F.col("answered"))).alias("mean_candidates"))


JD = """jd AS (SELECT doc_id, n_chars, source, lang, quality, toxic, (n_chars%1000)/1000.0::DOUBLE AS p, (n_chars%37)/37.0::DOUBLE AS net, (n_chars%11)::BIGINT AS near FROM documents JOIN labels USING (doc_id))"""


def judged_docs(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang").join(table(spark, sf, "labels"), "doc_id")
    c = F.col("n_chars")
    return d.withColumns({"p": (c % 1000) / F.lit(1000.0), "net": (c % 37) / F.lit(37.0), "near": c % 11, "y": F.col("quality")})


VETO = [0.3, 0.5, 0.7, 0.85, 0.95]


@query("e11_veto_table", f"""WITH {JD}, th AS (SELECT unnest([0.3, 0.5, 0.7, 0.85, 0.95])::DOUBLE AS threshold)
SELECT threshold, count(*) FILTER (net<threshold AND quality=1) AS vetoed_makes, count(*) FILTER (net<threshold AND quality=0) AS vetoed_misses,
 round(count(*) FILTER (net<threshold AND quality=0)/greatest(1, count(*) FILTER (net<threshold))::DOUBLE, 6) AS precision FROM jd, th GROUP BY threshold""")
def e11(spark, sf):
    c = sw.counts_from(judged_docs(spark, sf), F.col("net"), VETO[::-1], {"vetoed_makes": one(F.col("quality") == 1), "vetoed_misses": one(F.col("quality") == 0)},
                       passes=lambda v, t: v < t)
    prec = F.col("vetoed_misses") / F.greatest(F.lit(1), F.col("vetoed_makes") + F.col("vetoed_misses"))
    return c.select("threshold", "vetoed_makes", "vetoed_misses", r(prec).alias("precision"))


@query("e12_rotation_score", f"""WITH {DET}, s AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY t, seq)-1 AS i, CASE seq%4 WHEN 0 THEN 'green' WHEN 1 THEN 'blue' WHEN 2 THEN 'pink' END AS got FROM det WHERE site='purchase'),
o AS (SELECT video, off, got, (['green', 'blue', 'pink'])[((i+off)%3+1)::INT] AS want FROM s, (SELECT unnest([0, 1, 2]) AS off) WHERE got IS NOT NULL),
g AS (SELECT video, off, count(*) FILTER (got=want) AS hit, count(*) AS tot FROM o GROUP BY ALL),
k AS (SELECT *, hit/tot AS score, row_number() OVER (PARTITION BY video ORDER BY hit/tot DESC, off DESC) AS rk, lead(hit/tot) OVER (PARTITION BY video ORDER BY hit/tot DESC, off DESC) AS nxt FROM g)
SELECT video, off::BIGINT AS off, hit, tot, rk=1 AS best, CASE WHEN rk=1 THEN score-nxt<0.15 END AS unproven FROM k""")
def e12(spark, sf):
    d = detections(spark, sf).filter("site = 'purchase'")
    s = running(d, Series(("video",), "t", "seq", 7 * DAY), {"i": ("sum", F.lit(1).cast("long"))})
    got = F.when(F.col("seq") % 4 == 0, "green").when(F.col("seq") % 4 == 1, "blue").when(F.col("seq") % 4 == 2, "pink")
    s = s.withColumn("got", got).filter(F.col("got").isNotNull())
    rotation = F.array(*[F.lit(c) for c in ("green", "blue", "pink")])
    cnt = s.groupBy("video").agg(F.count("*").alias("tot"), *[F.count_if(F.col("got") == F.element_at(rotation, ((F.col("i") - 1 + o) % 3 + 1).cast("int"))).alias(f"h{o}") for o in range(3)])
    long = cnt.select("video", "tot", F.explode(F.array(*[F.struct(F.lit(o).cast("long").alias("off"), F.col(f"h{o}").alias("hit")) for o in range(3)])).alias("_o")).select("video", "tot", "_o.*")
    w = Window.partitionBy("video").orderBy((F.col("hit") / F.col("tot")).desc(), F.col("off").desc())
    best = F.row_number().over(w) == 1
    lead = F.lead(F.col("hit") / F.col("tot")).over(w)
    return long.select("video", "off", "hit", "tot", best.alias("best"), F.when(best, F.col("hit") / F.col("tot") - lead < 0.15).alias("unproven"))


@query("e13_shooter_score", f"""WITH RECURSIVE {FLAGS}, p AS (SELECT marks.video, marks.mark, m.call, CASE WHEN m.call%5<>0 THEN m.call%3 END AS pick, marks.mark%3 AS truth FROM marks LEFT JOIN matched m ON m.mark=marks.mark)
SELECT video, count(*) AS shots, count(pick) AS answered, count(*) FILTER (call IS NOT NULL AND pick IS NULL) AS no_answer, count(*) FILTER (call IS NULL) AS never_called,
 count(*) FILTER (pick=truth) AS correct, round(count(*) FILTER (pick=truth)/count(*)::DOUBLE, 6) AS of_all FROM p GROUP BY video""")
def e13(spark, sf):
    p = marks(spark, sf).join(matched(spark, sf).select("mark", "call"), "mark", "left").withColumns({
        "pick": F.when(F.col("call") % 5 != 0, F.col("call") % 3), "truth": F.col("mark") % 3})
    right = F.count_if(F.col("pick") == F.col("truth"))
    return p.groupBy("video").agg(
        F.count("*").alias("shots"), F.count("pick").alias("answered"), F.count_if(F.col("call").isNotNull() & F.col("pick").isNull()).alias("no_answer"),
        F.count_if(F.col("call").isNull()).alias("never_called"), right.alias("correct"), r(right / F.count("*")).alias("of_all"))


@query("e14_error_buckets", f"""WITH {JD}, w AS (SELECT *, (p>=0.5)<>(quality=1) AS wrong, CASE WHEN near=0 THEN '0' WHEN near<=2 THEN '1-2' WHEN near<=5 THEN '3-5' ELSE '6+' END AS bin FROM jd)
SELECT 'bin' AS kind, bin AS value, count(*) AS n, round(avg(wrong::INT), 6) AS error, NULL::DOUBLE AS median FROM w GROUP BY bin
UNION ALL SELECT 'label', quality::VARCHAR, count(*), round(avg(wrong::INT), 6), NULL FROM w GROUP BY quality HAVING count(*)>=3
UNION ALL SELECT 'source', source, count(*), round(avg(wrong::INT), 6), median(near) FROM w GROUP BY source""")
def e14(spark, sf):
    c = F.col
    w = judged_docs(spark, sf).withColumns({"wrong": one((c("p") >= 0.5) != (c("y") == 1)), "bin": F.when(c("near") == 0, "0").when(c("near") <= 2, "1-2").when(c("near") <= 5, "3-5").otherwise("6+")})
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c(v).cast("string").alias("value")) for k, v in (("bin", "bin"), ("label", "quality"), ("source", "source"))]))
    long = w.select("wrong", "near", kinds.alias("_k")).select("_k.*", "wrong", "near")
    med = quantiles(long.filter("kind = 'source'"), ["kind", "value"], "near", {"median": 0.5}).select("kind", "value", "median")
    out = long.groupBy("kind", "value").agg(F.count("*").alias("n"), F.avg("wrong").alias("e")).filter("kind <> 'label' OR n >= 3")
    return out.join(med, ["kind", "value"], "left").select("kind", "value", "n", r(c("e")).alias("error"), "median")


@query("e15_detector_density", f"""WITH {DET}, {MARKS}, s AS (SELECT unnest([0.0, 0.3, 0.6])::DOUBLE AS setting),
n AS (SELECT mark, setting, count(det.seq) AS seen FROM marks CROSS JOIN s LEFT JOIN det ON det.video=marks.video AND det.t BETWEEN mt-86400 AND mt+172800 AND det.x BETWEEN 50 AND 450 AND det.y BETWEEN 5 AND 120 AND det.conf>=setting GROUP BY ALL),
g AS (SELECT setting, median(seen) AS median, count(*) FILTER (seen<=2) AS thin, count(*) FILTER (seen>=6) AS dense FROM n GROUP BY setting)
SELECT *, row_number() OVER (ORDER BY dense DESC, thin, setting)=1 AS best FROM g""")
def e15(spark, sf):
    m = marks(spark, sf).withColumn("me", F.col("mt") + DAY)
    return dg.detector_density(m, detections(spark, sf), ["video"], "mt", "me", (0.0, 0.3, 0.6), DAY, (50, 450), (5, 120), 3 * DAY)


@query("e16_miss_reasons", f"""WITH RECURSIVE {FLAGS}, {FEATS}, ms AS (SELECT video, mark, mt FROM found WHERE NOT found),
sn AS (SELECT mark, count(*) AS seen FROM ms JOIN det ON det.video=ms.video AND t BETWEEN mt-259200 AND mt+259200 GROUP BY mark),
rn AS (SELECT mark, max(n) AS longest, arg_max(reason, (n, seq0)) FILTER (reason IS NOT NULL) AS reason FROM ms JOIN gated g ON g.video=ms.video AND g.t0 BETWEEN mt-345600 AND mt+345600 GROUP BY mark),
j AS (SELECT ms.mark, coalesce(seen, 0) AS seen, coalesce(longest, 0) AS longest, reason FROM ms LEFT JOIN sn USING (mark) LEFT JOIN rn USING (mark))
SELECT mark, seen, longest, CASE WHEN seen<12 THEN 'detector: barely seen' WHEN longest<=3 THEN 'fragmented: many sightings, tiny runs' ELSE coalesce(reason, 'no run built at all') END AS why FROM j""")
def e16(spark, sf):
    missed = mark_flags(spark, sf).filter(~F.col("found")).select("video", "mark", "mt")
    runs = gated(spark, sf).select("video", "t0", "n", "seq0", "reason")
    return dg.miss_reasons(cut(missed), detections(spark, sf).select("video", "t"), runs, ["video"], 3 * DAY, 4 * DAY, 4 * DAY)


@query("e17_footage_report", f"""WITH {DET}, f AS (SELECT video, frame, count(*) AS c FROM det GROUP BY ALL), g AS (SELECT video, max(frame)-min(frame)+1 AS frames, count(*) AS s, max(c) AS max_per_frame, sum(c) AS n FROM f GROUP BY video),
a AS (SELECT video, avg(conf) AS mean_conf, median(w*w/2500.0::DOUBLE) AS area FROM det GROUP BY video)
SELECT video, frames, round(n/frames::DOUBLE, 6) AS mean_per_frame, max_per_frame, round(1-s/frames::DOUBLE, 6) AS empty_share, round(mean_conf, 6) AS mean_conf, round(area, 6) AS median_area_pct,
 1-s/frames::DOUBLE<=0.7 AS enough_seen, area>=0.05 AS big_enough FROM g JOIN a USING (video)""")
def e17(spark, sf):
    out = dg.footage_report(detections(spark, sf), ["video"])
    return out.withColumns({c: r(F.col(c)) for c in ("mean_per_frame", "empty_share", "mean_conf", "median_area_pct")})


@query("e19_auc_and_confusion", f"""WITH {JD}, n AS (SELECT count(*) FILTER (quality=1) AS np, count(*) FILTER (quality=0) AS nn FROM jd), v AS (SELECT p, count(*) FILTER (quality=1) AS a, count(*) FILTER (quality=0) AS b FROM jd GROUP BY p),
c AS (SELECT a, b, coalesce(sum(b) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v)
SELECT (SELECT count(*) FROM jd) AS n, round((SELECT avg(((p>=0.5)=(quality=1))::INT) FROM jd), 6) AS accuracy, (SELECT count(*) FROM jd WHERE p>=0.5 AND quality=1) AS tp, (SELECT count(*) FROM jd WHERE p>=0.5 AND quality=0) AS fp,
 (SELECT count(*) FROM jd WHERE p<0.5 AND quality=1) AS fn, round(sum(a*(below+b/2.0::DOUBLE))/any_value(np*nn), 6) AS auc FROM c, n""")
def e19(spark, sf):
    s = md.scores(judged_docs(spark, sf))
    return s.select("n", r(F.col("accuracy")).alias("accuracy"), "tp", "fp", "fn", r(F.col("auc")).alias("auc"))


@query("e20_majority_baseline", "SELECT round(greatest(avg(quality), 1-avg(quality)), 6) AS baseline FROM labels")
def e20(spark, sf):
    m = F.avg("quality")
    return table(spark, sf, "labels").agg(r(F.greatest(m, 1 - m)).alias("baseline"))


@query("e21_confident_answers", f"""WITH {JD}, b AS (SELECT unnest([{{'lo': 0.2::DOUBLE, 'hi': 0.8::DOUBLE}}, {{'lo': 0.15::DOUBLE, 'hi': 0.85::DOUBLE}}, {{'lo': 0.1::DOUBLE, 'hi': 0.9::DOUBLE}}]) AS s)
SELECT s.lo AS lo, s.hi AS hi, count(*) FILTER (p<=s.lo OR p>=s.hi) AS answered, round(count(*) FILTER (p<=s.lo OR p>=s.hi)/count(*)::DOUBLE, 6) AS share,
 round(count(*) FILTER ((p<=s.lo OR p>=s.hi) AND (p>=0.5)=(quality=1))/count(*) FILTER (p<=s.lo OR p>=s.hi)::DOUBLE, 6) AS accuracy FROM jd, b GROUP BY ALL""")
def e21(spark, sf):
    out = md.confident(judged_docs(spark, sf), ((0.2, 0.8), (0.15, 0.85), (0.1, 0.9)))
    return out.select("lo", "hi", "answered", r(F.col("share")).alias("share"), r(F.col("accuracy")).alias("accuracy"))


@query("e27_vetoed_predictions", f"""WITH {JD} SELECT doc_id, round(CASE WHEN p>=0.5 AND near>0 AND n_chars%3<>0 THEN least(p, 0.25) WHEN p>=0.5 AND net<0.85 THEN least(p, 0.35) ELSE p END, 6) AS p FROM jd""")
def e27(spark, sf):
    p = md.vetoed(F.col("p"), F.col("near") > 0, F.col("n_chars") % 3 == 0, F.col("net"))
    return judged_docs(spark, sf).select("doc_id", r(p).alias("p"))


@query("e29_blend", f"""WITH {JD}, w AS (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS weight), b AS (SELECT weight, quality=1 AS y, p>=0.5 AS a, net>=0.5 AS b, weight*p+(1-weight)*net>=0.5 AS m, weight*p+(1-weight)*net AS s FROM jd, w),
 v AS (SELECT weight, s, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM b GROUP BY weight, s),
 t AS (SELECT weight, pos, neg, coalesce(sum(neg) OVER (PARTITION BY weight ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v),
 u AS (SELECT weight, round(sum(pos*(below+neg/2.0::DOUBLE))/(sum(pos)*sum(neg))::DOUBLE, 6) AS auc FROM t GROUP BY weight)
SELECT weight, round(avg((m=y)::INT), 6) AS accuracy, count(*) FILTER (a=b) AS agree, count(*) FILTER (a=y AND b=y) AS both_right, count(*) FILTER (a<>y AND b=y) AS saves, (SELECT auc FROM u WHERE u.weight=b.weight) AS auc FROM b GROUP BY weight""")
def e29(spark, sf):
    d = judged_docs(spark, sf)
    y, a, b = F.col("y") == 1, F.col("p") >= 0.5, F.col("net") >= 0.5
    rows = d.withColumn("weight", F.explode(F.array(*[F.lit(v) for v in (0.3, 0.5, 0.7)])))
    rows = rows.withColumn("s", F.col("weight") * F.col("p") + (1 - F.col("weight")) * F.col("net"))
    m = F.col("s") >= 0.5
    auc = rank_auc(rows, "s", y, 1 / 256, ["weight"]).select("weight", r(F.col("auc")).alias("auc"))
    return rows.groupBy("weight").agg(r(F.avg(one(m == y))).alias("accuracy"), F.count_if(a == b).alias("agree"), F.count_if((a == y) & (b == y)).alias("both_right"),
                                      F.count_if((a != y) & (b == y)).alias("saves")).join(auc, "weight")


@query("e30_equivariance", f"""WITH {RIG}, s AS (SELECT unnest([-4, -2, 2, 4])::DOUBLE AS shift), c AS (SELECT shift, abs(x+shift*0.9-(rx1+shift)) AS d_target, abs(x+shift*0.9-rx2) AS d_centre FROM rig, s)
SELECT shift, count(*) AS n, count(*) FILTER (d_target<d_centre-1e-9) AS follows FROM c GROUP BY shift""")
def e30(spark, sf):
    rows = rigged(spark, sf).withColumn("shift", F.explode(F.array(*[F.lit(float(v)) for v in (-4, -2, 2, 4)])))
    at_ = F.col("x") + F.col("shift") * 0.9
    follows = F.abs(at_ - (F.col("rx1") + F.col("shift"))) < F.abs(at_ - F.col("rx2")) - 1e-9
    return rows.groupBy("shift").agg(F.count("*").alias("n"), F.count_if(follows).alias("follows"))


@query("e31_verdict_rows", f"""WITH {JD} SELECT doc_id, CASE WHEN near=0 THEN NULL ELSE n_chars%3=0 END AS zone_fell, CASE WHEN p>=0.5 THEN 'made' ELSE 'missed' END AS outcome, round(greatest(p, 1-p), 6) AS certainty,
 CASE WHEN near=1 THEN NULL WHEN n_chars%2=0 THEN 3 ELSE 2 END::BIGINT AS worth, near AS people FROM jd""")
def e31(spark, sf):
    c = F.col
    return judged_docs(spark, sf).select(
        "doc_id", F.when(c("near") != 0, c("n_chars") % 3 == 0).alias("zone_fell"), F.when(c("p") >= 0.5, "made").otherwise("missed").alias("outcome"),
        r(F.greatest(c("p"), 1 - c("p"))).alias("certainty"), F.when(c("near") != 1, F.when(c("n_chars") % 2 == 0, 3).otherwise(2)).cast("long").alias("worth"), c("near").alias("people"))


# ---------------------------------------------------------------- models


def model_rows(spark, sf) -> DataFrame:
    """Flight features of the runs; a run is a make when its user bought within a day of its start."""
    from flightline.operators.features import FEATURES
    from flightline.operators.landing import zone_hits
    runs = cut(run_features(spark, sf).withColumn("rid", F.concat_ws("/", *KEYS, "run_id")))
    bought = detections(spark, sf).filter("site = 'purchase'").select("video", "t")
    rows = zone_hits(runs, bought, ["video"], ["rid"], "mt", DAY, DAY, 2 * DAY).withColumn("y", one(F.col("dropped")).cast("double"))
    return cut(md.assemble(rows, FEATURES).select("video", "site", "rid", "y", "features"))


@query("e22_out_of_fold")
def e22(spark, sf):
    return md.out_of_fold(md.folds(model_rows(spark, sf), ["rid"], 5), md.logistic, 5).select("rid", "y", "fold", r(F.col("p"), 4).alias("p"))


@query("e23_gradient_boosting")
def e23(spark, sf):
    return md.scores(md.out_of_fold(md.folds(model_rows(spark, sf), ["rid"], 5), lambda n: md.boosting(200), 5))


@query("e24_strongest_signals")
def e24(spark, sf):
    from flightline.operators.features import FEATURES
    rows = model_rows(spark, sf)
    model = md.logistic(rows.count()).fit(rows)
    coef = model.stages[-1].coefficients.toArray()  # one number per feature
    return spark.createDataFrame([(n, float(c)) for n, c in zip(FEATURES, coef)], "feature string, coefficient double").orderBy(
        F.abs("coefficient").desc(), "feature").limit(8)


@query("e29_stack")
def e29_stack(spark, sf):
    """Accuracy and AUC of both views and of their stack, which never sees the rows it is judged on."""
    d = cut(md.stacked(judged_docs(spark, sf).withColumn("y", one(F.col("y") == 1).cast("double")), ["doc_id"], ["p", "net"]))
    views = d.select("y", F.explode(F.create_map(*[v for c in ("p", "net", "stack") for v in (F.lit(c), F.col(c))])).alias("view", "s"))
    return md.scores(views, ["view"], p="s").select("view", "n", r(F.col("accuracy"), 4).alias("accuracy"), r(F.col("auc"), 4).alias("auc"))


@query("e25_held_out")
def e25(spark, sf):
    return md.scores(md.held_out(model_rows(spark, sf), "site", md.logistic), ["site"])


@query("e26_learning_curve")
def e26(spark, sf):
    return md.learning_curve(model_rows(spark, sf), ["rid"], md.logistic, (0.25, 0.5, 0.75, 1.0), 8, 5)


@query("e28_pca_logistic")
def e28(spark, sf):
    from pyspark.ml.functions import array_to_vector
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 2).cast("double").alias("y"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return md.out_of_fold(md.folds(e, ["vec_id"], 5), md.pca_logistic, 5).select("vec_id", "y", r(F.col("p"), 4).alias("p"))


