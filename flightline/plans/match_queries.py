"""Matching (M) and detection-scoring (E) queries: purchases as marks, clicks as calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.operators import matching as mt
from flightline.operators import sweeps as sw
from flightline.operators.joins import nearest_within
from flightline.operators.quantiles import UPPER_MEDIAN, quantiles
from flightline.plans.inputs import CALLS, DAY, DET, HOUR, MARKS, PTS, calls, detections, marks, points, r
from flightline.plans.registry import query
from flightline.runtime import cut

TOL = 12 * HOUR

PAIRS = f"""{MARKS}, {CALLS}, pairs AS (SELECT video, mark, call, abs(ct-mt) AS dt FROM marks JOIN calls USING (video)
  WHERE abs(ct-mt)<=43200 AND (mhoop IS NULL OR choop IS NULL OR mhoop=choop)),
rp AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY dt, mark, call) AS rn FROM pairs),
walk AS (SELECT video, 0::BIGINT AS rn, []::BIGINT[] AS um, []::BIGINT[] AS uc, NULL::BIGINT AS mark, NULL::BIGINT AS call, NULL::DOUBLE AS dt, false AS ok
    FROM (SELECT DISTINCT video FROM rp)
  UNION ALL SELECT p.video, p.rn, CASE WHEN NOT list_contains(um, p.mark) AND NOT list_contains(uc, p.call) THEN list_append(um, p.mark) ELSE um END,
    CASE WHEN NOT list_contains(um, p.mark) AND NOT list_contains(uc, p.call) THEN list_append(uc, p.call) ELSE uc END,
    p.mark, p.call, p.dt, NOT list_contains(um, p.mark) AND NOT list_contains(uc, p.call)
  FROM walk w JOIN rp p ON p.video=w.video AND p.rn=w.rn+1),
matched AS (SELECT video, mark, call, dt FROM walk WHERE ok)"""


def matched(spark, sf) -> DataFrame:
    return mt.match_events(marks(spark, sf), calls(spark, sf), ["video"], TOL)


def in_order_sql(before: str, marks_: str, calls_: str, rule: str, order: str) -> str:
    """Marks in time order; each one's list of fitting calls in order of preference, of which it takes the first not taken yet."""
    return f"""WITH RECURSIVE {before}, fit AS (SELECT m.video, m.mark, m.mt, list(c.call ORDER BY {order}) AS fits FROM {marks_} m JOIN {calls_} c USING (video)
  WHERE abs(c.ct-m.mt)<=43200 AND {rule} GROUP BY ALL), rm AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY mt, mark) AS rn FROM fit),
steps AS (SELECT video, 0::BIGINT AS rn, []::BIGINT[] AS used, NULL::BIGINT AS mark, NULL::BIGINT AS call FROM (SELECT DISTINCT video FROM rm)
  UNION ALL SELECT video, rn, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, mark, pick
  FROM (SELECT p.video, p.rn, p.mark, s.used, [x for x in p.fits if NOT list_contains(s.used, x)][1] AS pick FROM steps s JOIN rm p ON p.video=s.video AND p.rn=s.rn+1))
SELECT s.mark, s.call, round(abs(c.ct-m.mt), 3) AS dt FROM steps s JOIN {marks_} m ON m.mark=s.mark JOIN {calls_} c ON c.call=s.call"""


@query("m01_first_fit", in_order_sql(f"{MARKS}, {CALLS}", "marks", "calls", "(c.choop IS NULL OR c.choop=m.mhoop)", "c.ct, c.call"))
def m01(spark, sf):
    out = mt.in_order(marks(spark, sf), calls(spark, sf), ["video"], TOL, nearest=False, use_hoop=True, width=14 * DAY)
    return out.withColumn("dt", r(F.col("dt"), 3))


@query("m02_nearest_first", f"WITH RECURSIVE {PAIRS} SELECT video, mark, call, round(dt, 3) AS dt FROM matched")
def m02(spark, sf):
    return matched(spark, sf).select("video", "mark", "call", r(F.col("dt"), 3).alias("dt"))


@query("m03_nearest_unused", in_order_sql(f"{MARKS}, {CALLS}", "marks", "calls", "true", "abs(c.ct-m.mt), c.ct, c.call"))
def m03(spark, sf):
    out = mt.in_order(marks(spark, sf), calls(spark, sf), ["video"], TOL, nearest=True, use_hoop=False, width=14 * DAY)
    return out.withColumn("dt", r(F.col("dt"), 3))


NEAREST = f"""{MARKS}, {CALLS}, nn AS (SELECT call, ct, fall, calls.video, mark, abs(ct-mt) AS dt,
  row_number() OVER (PARTITION BY call ORDER BY abs(ct-mt), mt, mark) AS k FROM calls JOIN marks USING (video)),
near AS (SELECT * FROM nn WHERE k=1)"""


@query("m04_nearest_mark", f"WITH {NEAREST} SELECT call, mark, round(dt, 3) AS dt, dt<=43200 AS real FROM near")
def m04(spark, sf):
    near = mt.nearest_mark(calls(spark, sf), marks(spark, sf), ["video"], 7 * DAY).filter(F.col("mark").isNotNull())
    return near.select("call", "mark", r(F.col("dt"), 3).alias("dt"), (F.col("dt") <= TOL).alias("real"))


def scanned(spark, sf) -> DataFrame:
    """Signups open a scanned window of two days."""
    d = detections(spark, sf).filter(F.col("site") == "signup")
    return d.select("video", F.col("t").alias("lo"), (F.col("t") + 2 * DAY).alias("hi"))


COVER = """cover AS (SELECT user_id AS video, epoch_us(ts)/1e6 AS lo, epoch_us(ts)/1e6+172800 AS hi FROM events WHERE event_type='signup')"""


@query("m05_covered_marks", f"""WITH {MARKS}, {COVER} SELECT mark, outcome FROM marks WHERE EXISTS (SELECT 1 FROM cover
  WHERE cover.video=marks.video AND mt BETWEEN lo-3600 AND hi+3600)""")
def m05(spark, sf):
    return mt.covered(marks(spark, sf), scanned(spark, sf), ["video"], HOUR, 2 * DAY).select("mark", "outcome")


@query("m06_named_false_positives", in_order_sql(
    f"""{PAIRS}, free AS (SELECT * FROM calls WHERE call NOT IN (SELECT call FROM matched)),
nots AS (SELECT user_id AS video, event_id AS mark, epoch_us(ts)/1e6 AS mt FROM events WHERE event_type='error')""", "nots", "free", "true", "c.ct, c.call"))
def m06(spark, sf):
    """Errors as moments known not to be shots."""
    used = matched(spark, sf).select("call")
    free = calls(spark, sf).join(used, "call", "left_anti")
    d = detections(spark, sf).filter(F.col("site") == "error")
    nots = d.select("video", F.col("seq").alias("mark"), F.col("t").alias("mt"), F.lit(None).cast("long").alias("mhoop"))
    out = mt.in_order(nots, free, ["video"], TOL, nearest=False, use_hoop=False, width=14 * DAY)
    return out.withColumn("dt", r(F.col("dt"), 3))


@query("m07_extra_calls", f"WITH RECURSIVE {PAIRS} SELECT call, round(fall, 6) AS fall FROM calls WHERE call NOT IN (SELECT call FROM matched)")
def m07(spark, sf):
    return calls(spark, sf).join(matched(spark, sf).select("call"), "call", "left_anti").select("call", r(F.col("fall")).alias("fall"))


@query("m08_label_claims", f"""WITH {MARKS}, {CALLS},
c AS (SELECT mark, mt, outcome, call, row_number() OVER (PARTITION BY mark ORDER BY abs(ct-mt), ct DESC, call DESC) AS k
  FROM marks JOIN calls ON calls.video=marks.video AND choop=mhoop WHERE abs(ct-mt)<=43200),
g AS (SELECT call, CASE WHEN count(DISTINCT outcome)=1 THEN any_value(outcome) ELSE '' END AS label, arg_min(mark, (mt, mark)) AS by_mark FROM c WHERE k=1 GROUP BY call),
f AS (SELECT calls.call, CASE WHEN calls.call%3=0 THEN 'make' ELSE '' END AS old, coalesce(label, '') AS label, by_mark FROM calls LEFT JOIN g USING (call))
SELECT call, old, label, by_mark FROM f WHERE old<>label""")
def m08(spark, sf):
    from flightline.sources.labels import claim_labels
    current = calls(spark, sf).withColumn("old", F.when(F.col("call") % 3 == 0, "make").otherwise(""))
    return claim_labels(marks(spark, sf), current, ["video"], 12 * HOUR)


@query("m09_label_migration", f"""WITH {MARKS}, {CALLS}, w AS (SELECT *, ct+21600 AS c_end, ct-43200 AS w0, ct+86400 AS w1 FROM calls),
j AS (SELECT mark, mt, outcome, call, CASE WHEN mt BETWEEN ct-5400 AND c_end+5400 THEN 1 WHEN mt BETWEEN w0 AND w1 THEN 2 END AS tier, ct
  FROM marks JOIN w ON w.video=marks.video AND choop=mhoop),
k AS (SELECT *, row_number() OVER (PARTITION BY mark ORDER BY tier, ct, call) AS rk FROM j WHERE tier IS NOT NULL),
b AS (SELECT * FROM k WHERE rk=1), g AS (SELECT call, CASE WHEN count(DISTINCT outcome)=1 THEN any_value(outcome) ELSE '' END AS label, count(*) AS n FROM b GROUP BY call)
SELECT marks.mark, b.call, g.label, b.call IS NULL AS dropped FROM marks LEFT JOIN b ON b.mark=marks.mark LEFT JOIN g ON g.call=b.call""")
def m09(spark, sf):
    from flightline.sources.labels import migrate_labels
    c = calls(spark, sf).withColumns({"c_end": F.col("ct") + 6 * HOUR, "w0": F.col("ct") - 12 * HOUR, "w1": F.col("ct") + DAY})
    return migrate_labels(marks(spark, sf), c, ["video"], 1.5 * HOUR, 2 * DAY)


@query("m10_interval_prefill", f"""WITH {MARKS}, {CALLS}, j AS (SELECT call, outcome, row_number() OVER (PARTITION BY call ORDER BY mt, mark) AS k
  FROM calls JOIN marks ON marks.video=calls.video AND mhoop=choop AND mt BETWEEN ct-10800 AND ct+21600+10800)
SELECT calls.call, coalesce(outcome, '') AS label FROM calls LEFT JOIN j ON j.call=calls.call AND k=1""")
def m10(spark, sf):
    from flightline.sources.labels import prefill
    c = calls(spark, sf).withColumn("c_end", F.col("ct") + 6 * HOUR)
    return prefill(marks(spark, sf), c, ["video"], 3 * HOUR, DAY)


def box_sides(spark, sf):
    p = points(spark, sf).select("frame", F.concat_ws("/", "line", "part", F.round("y", 5)).alias("id"), "line", F.col("x").alias("x1"), F.col("h").alias("y1"),
                                 (F.col("x") + F.col("w")).alias("x2"), (F.col("h") * 2).alias("y2"))
    return (p.filter(F.col("line") % 2 == 1).withColumnRenamed("id", "aid"), p.filter(F.col("line") % 2 == 0).withColumnRenamed("id", "bid"))


@query("m11_box_agreement", f"""WITH {PTS}, b AS (SELECT frame, line, part, y, x AS x1, h AS y1, x+w AS x2, h*2 AS y2 FROM pts),
o AS (SELECT * FROM b WHERE line%2=1), e AS (SELECT * FROM b WHERE line%2=0),
oh AS (SELECT o.frame, avg(CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.frame=o.frame AND greatest(abs(e.x1-o.x1), abs(e.y1-o.y1), abs(e.x2-o.x2), abs(e.y2-o.y2))<=6)
  THEN 1.0::DOUBLE ELSE 0 END) AS s FROM o GROUP BY 1),
eh AS (SELECT e.frame, avg(CASE WHEN EXISTS (SELECT 1 FROM o WHERE e.frame=o.frame AND greatest(abs(e.x1-o.x1), abs(e.y1-o.y1), abs(e.x2-o.x2), abs(e.y2-o.y2))<=6)
  THEN 1.0::DOUBLE ELSE 0 END) AS s FROM e GROUP BY 1)
SELECT frame, round(coalesce(oh.s, 1), 6) AS a_in_b, round(coalesce(eh.s, 1), 6) AS b_in_a FROM oh FULL JOIN eh USING (frame)""")
def m11(spark, sf):
    a, b = box_sides(spark, sf)
    out = mt.box_agreement(a, b, "frame", 6.0)
    return out.select("frame", r(F.col("a_in_b")).alias("a_in_b"), r(F.col("b_in_a")).alias("b_in_a"))


@query("m12_detector_recall")
def m12(spark, sf):
    from flightline.operators.detectors import recall_at
    p = points(spark, sf).select("frame", "line", "part", "x", F.col("h").alias("y"), "w", "conf")
    return recall_at(p.filter(F.col("line") <= 3), p.filter(F.col("line") > 3), "frame", ["line", "part", "x"], (0.9, 0.93, 0.96, 0.99), 1.5)


@query("m13_paired_runs", f"""WITH {DET}, a AS (SELECT video, count(*) AS n, max(t)-min(t) AS span FROM det WHERE conf>=0.5 GROUP BY video),
b AS (SELECT video, count(*) AS n, max(t)-min(t) AS span FROM det WHERE conf>=0.2 GROUP BY video)
SELECT video, coalesce(a.n, 0) AS before_n, coalesce(b.n, 0) AS after_n, coalesce(b.n, 0)-coalesce(a.n, 0) AS gained,
  round(coalesce(b.span, 0)-coalesce(a.span, 0), 3) AS span_gained, round(100.0::DOUBLE*(sum(coalesce(b.n, 0)) OVER ()-sum(coalesce(a.n, 0)) OVER ())
  /greatest(1, sum(coalesce(a.n, 0)) OVER ()), 4) AS total_pct FROM a FULL JOIN b USING (video)""")
def m13(spark, sf):
    from flightline.operators.detectors import compare_runs
    det = detections(spark, sf)
    out = compare_runs(det.filter(F.col("conf") >= 0.5), det.filter(F.col("conf") >= 0.2), ["video"], "t")
    return out.withColumns({"span_gained": r(F.col("span_gained"), 3), "total_pct": r(F.col("total_pct"), 4)})


@query("m14_aligned_features", """SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)""")
def m14(spark, sf):
    from flightline.plans.inputs import table
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return d.join(table(spark, sf, "labels"), "doc_id")


@query("m15_capped_assignment", """WITH RECURSIVE s AS (SELECT l_orderkey AS frame, l_partkey*10+l_linenumber AS id, l_quantity AS x, l_tax*500 AS y, l_linenumber AS line,
  l_suppkey AS stored FROM lineitem),
a AS (SELECT frame, id AS a, x, y, stored FROM s WHERE line<=3), b AS (SELECT frame, id AS b, x, y FROM s WHERE line>3),
p AS (SELECT frame, a, b, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM a JOIN b USING (frame)),
q AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY d2, a, b) AS rn FROM (SELECT DISTINCT frame, a, b, min(d2) AS d2 FROM p WHERE d2<=225 GROUP BY 1, 2, 3)),
walk AS (SELECT frame, 0::BIGINT AS rn, []::BIGINT[] AS ua, []::BIGINT[] AS ub, NULL::BIGINT AS a, NULL::BIGINT AS b, false AS ok FROM (SELECT DISTINCT frame FROM q)
  UNION ALL SELECT q.frame, q.rn, CASE WHEN NOT list_contains(ua, q.a) AND NOT list_contains(ub, q.b) THEN list_append(ua, q.a) ELSE ua END,
    CASE WHEN NOT list_contains(ua, q.a) AND NOT list_contains(ub, q.b) THEN list_append(ub, q.b) ELSE ub END, q.a, q.b,
    NOT list_contains(ua, q.a) AND NOT list_contains(ub, q.b) FROM walk w JOIN q ON q.frame=w.frame AND q.rn=w.rn+1),
ch AS (SELECT frame, a, b FROM walk WHERE ok), st AS (SELECT frame, a, min(stored) AS stored FROM a GROUP BY ALL)
SELECT st.frame, st.a, coalesce(ch.b, st.stored) AS value, ch.b IS NOT NULL AS moved FROM st LEFT JOIN ch ON ch.frame=st.frame AND ch.a=st.a""")
def m15(spark, sf):
    p = points(spark, sf).select(
        "frame", (F.col("part") * 10 + F.col("line")).alias("id"), "x", ((F.col("h") - 3.0) * 5.0).alias("y"), "line", F.col("video").alias("stored"))
    a = p.filter("line <= 3").select("frame", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "stored")
    b = p.filter("line > 3").select("frame", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by_"))
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by_")) * (F.col("ay") - F.col("by_"))
    pairs = a.join(b, "frame").filter(d2 <= 225).groupBy("frame", "a", "b").agg(F.min(d2).alias("d2"))
    best = mt.greedy_in_groups(pairs, ["frame"], ["a"], ["b"], [F.col("d2"), F.col("a"), F.col("b")]).select("frame", "a", "b")
    stored = a.groupBy("frame", "a").agg(F.min("stored").alias("stored"))
    return stored.join(best, ["frame", "a"], "left").select(
        "frame", "a", F.coalesce("b", "stored").alias("value"), F.col("b").isNotNull().alias("moved"))


# ---------------------------------------------------------------- scores


def call_flags(spark, sf) -> DataFrame:
    """Calls with ``real``: matched to a mark."""
    hit = matched(spark, sf).select("call", F.lit(True).alias("_h"))
    return calls(spark, sf).join(hit, "call", "left").withColumn("real", F.coalesce("_h", F.lit(False))).drop("_h")


FLAGS = f"""{PAIRS}, flags AS (SELECT calls.*, call IN (SELECT call FROM matched) AS real FROM calls),
found AS (SELECT marks.*, mark IN (SELECT mark FROM matched) AS found FROM marks)"""


def mark_flags(spark, sf) -> DataFrame:
    hit = matched(spark, sf).select("mark", F.lit(True).alias("_h"))
    return marks(spark, sf).join(hit, "mark", "left").withColumn("found", F.coalesce("_h", F.lit(False))).drop("_h")


@query("e01_detection_score", f"""WITH RECURSIVE {FLAGS}, m AS (SELECT video, count(*) FILTER (found) AS found, count(*) AS total FROM found GROUP BY video),
c AS (SELECT video, count(*) FILTER (NOT real) AS extra FROM flags GROUP BY video)
SELECT video, coalesce(found, 0) AS found, coalesce(total, 0) AS total, coalesce(extra, 0) AS extra FROM m FULL JOIN c USING (video)""")
def e01(spark, sf):
    hit = cut(matched(spark, sf))
    m = marks(spark, sf).join(hit.select("mark", F.lit(1).alias("h")), "mark", "left").groupBy("video").agg(
        F.count("h").alias("found"), F.count("*").alias("total"))
    c = calls(spark, sf).join(hit.select("call"), "call", "left_anti").groupBy("video").agg(F.count("*").alias("extra"))
    known = calls(spark, sf).select("video").distinct()
    out = m.join(known, "video", "full").join(c, "video", "left")
    return out.na.fill(0, ["found", "total", "extra"])


@query("e02_recall_by_kind", f"""WITH RECURSIVE {FLAGS} SELECT coalesce(outcome, '(all)') AS outcome, coalesce(mh, '(all)') AS hoop, count(*) FILTER (found) AS found,
  count(*) AS total FROM (SELECT *, CASE WHEN mhoop IS NULL THEN 'unknown' ELSE mhoop::VARCHAR END AS mh FROM found) GROUP BY GROUPING SETS ((outcome), (mh))""")
def e02(spark, sf):
    m = mark_flags(spark, sf).withColumn("hoop", F.coalesce(F.col("mhoop").cast("string"), F.lit("unknown")))
    out = m.groupingSets([[F.col("outcome")], [F.col("hoop")]], "outcome", "hoop").agg(
        F.count_if("found").alias("found"), F.count("*").alias("total"))
    return out.na.fill("(all)", ["outcome", "hoop"])


@query("e03_regression_suite", f"""WITH RECURSIVE {FLAGS}, cv AS (SELECT DISTINCT user_id AS video FROM events WHERE event_type='signup'),
m AS (SELECT video, count(*) FILTER (found) AS found, count(*) AS total FROM found GROUP BY video),
c AS (SELECT video, count(*) FILTER (NOT real) AS extra FROM flags GROUP BY video),
k AS (SELECT m.video, found, total, coalesce(extra, 0) AS extra, cv.video IS NOT NULL AS scanned FROM m LEFT JOIN c USING (video) LEFT JOIN cv ON cv.video=m.video)
SELECT coalesce(video::VARCHAR, 'TOTAL') AS case_name, sum(CASE WHEN scanned THEN found END)::BIGINT AS found, sum(CASE WHEN scanned THEN total END)::BIGINT AS total,
  sum(CASE WHEN scanned THEN extra END)::BIGINT AS extra, count(*) FILTER (NOT scanned) AS not_run FROM k GROUP BY ROLLUP (video)""")
def e03(spark, sf):
    hit = cut(matched(spark, sf))
    m = marks(spark, sf).join(hit.select("mark", F.lit(1).alias("h")), "mark", "left").groupBy("video").agg(
        F.count("h").alias("found"), F.count("*").alias("total"))
    c = calls(spark, sf).join(hit.select("call"), "call", "left_anti").groupBy("video").agg(F.count("*").alias("extra"))
    scans = scanned(spark, sf).select("video").distinct().withColumn("s", F.lit(True))
    k = m.join(c, "video", "left").join(scans, "video", "left").withColumns(
        {"s": F.coalesce("s", F.lit(False)), "extra": F.coalesce("extra", F.lit(0))})
    total = lambda n: F.sum(F.when(F.col("s"), F.col(n))).alias(n)
    return k.rollup("video").agg(total("found"), total("total"), total("extra"), F.count_if(~F.col("s")).alias("not_run")).select(
        F.coalesce(F.col("video").cast("string"), F.lit("TOTAL")).alias("case_name"), "found", "total", "extra", "not_run")


THRS = [float(v) for v in range(0, 701, 25)]
PRF_SQL = """CASE WHEN total>0 THEN tp/total::DOUBLE END AS rec, tp/greatest(1, tp+fp)::DOUBLE AS prec"""


@query("e04_threshold_f1", f"""WITH RECURSIVE {FLAGS}, th AS (SELECT unnest(range(0, 701, 25))::DOUBLE AS threshold),
sp AS (SELECT video%4=3 AS held, count(*) AS total FROM marks GROUP BY 1),
c AS (SELECT threshold, video%4=3 AS held, count(*) FILTER (real AND fall>=threshold) AS tp, count(*) FILTER (NOT real AND fall>=threshold) AS fp FROM flags, th GROUP BY ALL),
s AS (SELECT c.*, total, {PRF_SQL} FROM c JOIN sp USING (held)), f AS (SELECT *, 2*rec*prec/greatest(1e-9, rec+prec) AS f1 FROM s),
b AS (SELECT threshold FROM f WHERE NOT held ORDER BY round(f1, 12) DESC, threshold LIMIT 1)
SELECT threshold, held, tp, fp, total, round(rec, 6) AS recall, round(prec, 6) AS precision, round(f1, 6) AS f1, threshold=(SELECT threshold FROM b) AS chosen FROM f""")
def e04(spark, sf):
    flags = call_flags(spark, sf).withColumn("held", F.col("video") % 4 == 3)
    one = lambda c: F.when(c, 1).otherwise(0)
    c = sw.counts_from(flags, F.col("fall"), THRS, {"tp": one(F.col("real")), "fp": one(~F.col("real"))}, ["held"])
    total = marks(spark, sf).groupBy((F.col("video") % 4 == 3).alias("held")).agg(F.count("*").alias("total"))
    s = c.join(total, "held").withColumns(sw.prf(F.col("tp"), F.col("fp"), F.col("total")))
    fit = sw.flag_first_max(s, F.when(~F.col("held"), F.round("f1", 12)), [F.col("threshold")], "b")
    chosen = F.max(F.when(F.col("b"), F.col("threshold"))).over(sw.Window.partitionBy(F.lit(1)))
    return fit.withColumn("chosen", F.col("threshold") == chosen).select(
        "threshold", "held", "tp", "fp", "total", r(F.col("recall")).alias("recall"), r(F.col("precision")).alias("precision"),
        r(F.col("f1")).alias("f1"), "chosen")


@query("e05_two_gate_grid", f"""WITH RECURSIVE {FLAGS}, g AS (SELECT *, (fall%100)/100 AS closed, (call%40)/10.0::DOUBLE AS nearest FROM flags),
a AS (SELECT unnest(range(0, 100, 5))/100.0::DOUBLE AS c), b AS (SELECT unnest(range(0, 40, 2))/10.0::DOUBLE AS n),
k AS (SELECT c, n, count(*) FILTER (real AND (closed>=c OR nearest<=n)) AS tp, count(*) FILTER (NOT real AND (closed>=c OR nearest<=n)) AS fp FROM g, a, b GROUP BY ALL),
tt AS (SELECT count(*) AS total FROM marks), s AS (SELECT *, {PRF_SQL} FROM k, tt),
f AS (SELECT *, 2*rec*prec/greatest(1e-9, rec+prec) AS f1 FROM s)
SELECT c, n, tp, fp, round(f1, 6) AS f1, row_number() OVER (ORDER BY round(f1, 12) DESC, c, n)=1 AS best FROM f""")
def e05(spark, sf):
    g = call_flags(spark, sf).withColumns({"closed": F.col("fall") % 100 / 100, "nearest": (F.col("call") % 40) / F.lit(10.0)})
    one = lambda c: F.when(c, 1).otherwise(0)
    near_desc = [v / 10 for v in range(38, -1, -2)]
    k = sw.grid_counts(g, F.col("closed"), [v / 100 for v in range(0, 100, 5)], F.col("nearest"), near_desc,
                       {"tp": one(F.col("real")), "fp": one(~F.col("real"))}, lambda v, t: v >= t, lambda v, t: v <= t, either=True)
    total = marks(spark, sf).agg(F.count("*").alias("total"))
    s = k.withColumn("total", total.scalar()).withColumns(sw.prf(F.col("tp"), F.col("fp"), F.col("total")))
    s = sw.flag_first_max(s, F.round("f1", 12), [F.col("a"), F.col("b")])
    return s.select(F.col("a").alias("c"), F.col("b").alias("n"), "tp", "fp", r(F.col("f1")).alias("f1"), "best")


@query("e06_gate_retention", f"""WITH {NEAREST}, v AS (SELECT dt<=43200 AS real, unnest([{{'f': 'fall', 'v': fall}}, {{'f': 'hour', 'v': ((ct//3600)%24)::DOUBLE}}]) AS s FROM near),
th AS (SELECT unnest(range(0, 900, 50))::DOUBLE AS thr, 'fall' AS f UNION ALL SELECT unnest(range(0, 24, 2))::DOUBLE, 'hour'),
k AS (SELECT s.f AS field, thr, count(*) FILTER (real AND s.v>=thr) AS kept_real, count(*) FILTER (NOT real AND s.v>=thr) AS kept_false,
  count(*) FILTER (real) AS all_real, count(*) FILTER (NOT real) AS all_false FROM v JOIN th ON th.f=v.s.f GROUP BY ALL),
z AS (SELECT *, coalesce(sum(CASE WHEN kept_false=0 AND NOT (kept_real=all_real AND kept_false=all_false) THEN 1 ELSE 0 END) OVER (PARTITION BY field ORDER BY thr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS zeros FROM k)
SELECT field, thr AS threshold, kept_real, kept_false FROM z WHERE zeros=0 AND NOT (kept_real=all_real AND kept_false=all_false)""")
def e06(spark, sf):
    from flightline.operators.scoring import retention
    near = mt.nearest_mark(calls(spark, sf), marks(spark, sf), ["video"], 7 * DAY).filter(F.col("mark").isNotNull())
    near = cut(near.select((F.col("dt") <= TOL).alias("real"), "fall", (F.floor(F.col("ct") / HOUR) % 24).cast("double").alias("hour")))
    return retention(near, "real", {"fall": [float(v) for v in range(0, 900, 50)], "hour": [float(v) for v in range(0, 24, 2)]})


@query("e07_class_summary", f"""WITH {NEAREST}, s AS (SELECT dt<=43200 AS real, fall, row_number() OVER (PARTITION BY dt<=43200 ORDER BY fall)-1 AS i,
  count(*) OVER (PARTITION BY dt<=43200) AS n FROM near)
SELECT real, any_value(n) AS n, min(fall) AS low, max(CASE WHEN i=n//2 THEN fall END) AS middle, max(fall) AS high FROM s GROUP BY real""")
def e07(spark, sf):
    near = mt.nearest_mark(calls(spark, sf), marks(spark, sf), ["video"], 7 * DAY).filter(F.col("mark").isNotNull())
    near = cut(near.withColumn("real", F.col("dt") <= TOL).select("real", "fall"))
    q = quantiles(near, ["real"], "fall", {"middle": UPPER_MEDIAN}).select("real", "middle")
    return near.groupBy("real").agg(F.count("*").alias("n"), F.min("fall").alias("low"), F.max("fall").alias("high")).join(q, "real")


@query("e18_nearest_call", f"""WITH {MARKS}, {CALLS}, j AS (SELECT mark, call, abs(ct-mt) AS dt, row_number() OVER (PARTITION BY mark ORDER BY abs(ct-mt), ct, call) AS k
  FROM marks JOIN calls USING (video) WHERE abs(ct-mt)<=9000) SELECT marks.mark, call, round(dt, 3) AS dt FROM marks LEFT JOIN j ON j.mark=marks.mark AND k=1""")
def e18(spark, sf):
    m = marks(spark, sf)
    best = nearest_within(m, calls(spark, sf), ["video"], ["mark"], "mt", "ct", 2.5 * HOUR, ["ct", "call"])
    return m.select("mark").join(best, "mark", "left").select("mark", "call", r(F.col("dt"), 3).alias("dt"))


