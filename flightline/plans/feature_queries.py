"""Feature/fit (A) and colour/identity (I) queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.functions import color
from flightline.functions.geometry import num
from flightline.operators import features as ft
from flightline.operators import fits
from flightline.operators import identity as idn
from flightline.operators.blocks import Series, settled
from flightline.plans.event_queries import KEYS, RUNS, run_points
from flightline.plans.inputs import DAY, DET, HOUR, MARKS, PTS, RIM, RIM_SQL, by_site, detections, marks, points, r, table
from flightline.plans.registry import query
from flightline.runtime import cut

ID, ID_SQL = ["frame", "line", "part"], "frame, line, part"


def run_features(spark, sf) -> DataFrame:
    """Flight features of the runs, and ``mt``, a run's start in seconds."""
    s = settled(by_site(), detections(spark, sf))  # nothing here spans the sites of a recording
    pts = run_points(spark, sf, s).select(*KEYS, "run_id", "seq", F.col("t").alias("at"), (F.col("t") / HOUR).alias("t"), "x", "y", "conf",
                                          "prev_x", "prev_y", (F.col("prev_t") / HOUR).alias("prev_t"), *RIM)
    return ft.flight_features(pts if s.whole else cut(pts), [*KEYS, "run_id"], whole=s.whole, more={"mt": F.min("at")})


FEAT = f"""{RUNS}, rp AS (SELECT *, {RIM_SQL}, t/3600.0::DOUBLE AS h, CASE WHEN st=0 THEN pt/3600.0::DOUBLE END AS ph FROM runs),
rpx AS (SELECT *, CASE WHEN st=0 THEN lag(x) OVER (PARTITION BY video, site ORDER BY t, seq) END AS px,
  row_number() OVER (PARTITION BY video, site, run_id ORDER BY t, seq) AS i FROM rp),
bs AS (SELECT video, site, run_id, any_value(x1) AS x1, any_value(x2) AS x2, any_value((x1+x2)/2) AS cx, any_value((y1+y2)/2) AS cy, any_value(x2-x1) AS rw, count(*) AS n, min(y) AS lo, max(y) AS hi,
  max(h)-min(h) AS dur, max(conf) AS cmax, avg(conf) AS cmean, min(sqrt((x-(x1+x2)/2)*(x-(x1+x2)/2)+(y-(y1+y2)/2)*(y-(y1+y2)/2))) AS md,
  count(*) FILTER (x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2) AS nin, arg_min(i, (y, i)) AS pk FROM rpx GROUP BY video, site, run_id HAVING count(*)>=4),
fl AS (SELECT rpx.*, bs.cx, bs.cy, bs.rw, bs.pk FROM rpx JOIN bs USING (video, site, run_id) WHERE i>=pk),
cr AS (SELECT video, site, run_id, arg_min({{'x': px+(cy-py)/greatest(1e-6, y-py)*(x-px), 't': ph+(cy-py)/greatest(1e-6, y-py)*(h-ph), 'vx': (x-px)/greatest(1e-6, h-ph),
  'vy': (y-py)/greatest(1e-6, h-ph)}}, i) AS c FROM fl WHERE i>pk AND py<=cy AND cy<=y AND y>py GROUP BY ALL),
dn AS (SELECT video, site, run_id, count(*) AS dn, var_pop(x) AS vx, var_pop(h-473000) AS vt, covar_pop(x, h-473000) AS cv FROM fl GROUP BY ALL),
af AS (SELECT video, site, run_id, count(*) AS na, arg_max(x, i) AS lx, arg_max(y, i) AS ly, max(abs(x-c.x)) AS mx, stddev_pop(x) AS sx FROM fl JOIN cr USING (video, site, run_id) WHERE h>c.t GROUP BY ALL),
fx AS (SELECT bs.*, c, dn, vx, vt, cv, cv/CASE WHEN vt>0 THEN vt ELSE 1e-6 END AS sl, coalesce(na, 0) AS na, lx, ly, mx, sx FROM bs JOIN dn USING (video, site, run_id) LEFT JOIN cr USING (video, site, run_id) LEFT JOIN af USING (video, site, run_id))"""


@query("a09_flight_features", f"""WITH {FEAT} SELECT video, site, run_id, round((cy-lo)/rw, 4) AS peak_above, round((hi-lo)/rw, 4) AS total_drop, n::DOUBLE AS n_det, round(dur, 4) AS dur,
 round(cmax, 4) AS conf_max, round(cmean, 4) AS conf_mean, round(md/rw, 4) AS min_dist, nin::DOUBLE AS n_inside, round(nin/n, 4) AS frac_inside, dn::DOUBLE AS desc_n,
 CASE WHEN c IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS crossed, round(coalesce((c.x-cx)/rw, 0), 4) AS cross_dx, round(coalesce(abs(c.x-cx)/rw, 0), 4) AS cross_adx,
 round(coalesce(degrees(atan2(abs(c.vy), abs(c.vx)+1e-6)), 0), 3) AS cross_angle, round(coalesce(abs(c.vx)/(abs(c.vy)+1e-6), 0), 3) AS cross_vratio, na::DOUBLE AS n_after,
 round(coalesce(abs(lx-c.x)/rw, 0), 4) AS dx_after, round(coalesce((ly-cy)/rw, 0), 4) AS dy_after, round(coalesce(mx/rw, 0), 4) AS max_dx_after, round(coalesce(sx/rw, 0), 4) AS x_spread_after,
 round(CASE WHEN dn>=4 THEN sqrt(greatest(0, vx-2*sl*cv+sl*sl*vt))/rw ELSE 0 END, 3) AS desc_x_resid, round(CASE WHEN dn>=4 THEN abs(sl)/rw ELSE 0 END, 3) AS desc_x_slope FROM fx""")
def a09(spark, sf):
    f = run_features(spark, sf)
    three = {"cross_angle", "cross_vratio", "desc_x_resid", "desc_x_slope"}
    return f.select(*KEYS, "run_id", *[r(F.col(c), 3 if c in three else 4).alias(c) for c in ft.FEATURES])


def entry_points(spark, sf) -> DataFrame:
    """A noisy line per supplier: slope by supplier, every twentieth point far off."""
    p = points(spark, sf)
    y = F.col("x") * ((F.col("video") % 9) / num(4)) + F.col("w") + F.when(F.col("part") % 20 == 0, num(200)).otherwise(num(0))
    return p.select("video", F.col("x").alias("px"), y.alias("py"))


def _robust_sql(passes: int) -> str:
    sql = f"""{PTS}, q0 AS (SELECT video, x AS px, x*((video%9)/4.0::DOUBLE)+w+CASE WHEN part%20=0 THEN 200 ELSE 0 END AS py FROM pts)"""
    for i in range(passes):
        sql += f""", f{i} AS (SELECT video, regr_slope(py, px) AS m, regr_intercept(py, px) AS b FROM q{i} GROUP BY video),
r{i} AS (SELECT q{i}.*, abs(py-(m*px+b)) AS res FROM q{i} JOIN f{i} USING (video)), m{i} AS (SELECT video, median(res) AS med FROM r{i} GROUP BY video),
k{i} AS (SELECT r{i}.*, res<=greatest(18, 2*med) AS keep FROM r{i} JOIN m{i} USING (video)),
q{i+1} AS (SELECT video, px, py FROM (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY video) AS nk FROM k{i}) WHERE keep OR nk<8)"""
    return sql


@query("a10_robust_line", f"""WITH {_robust_sql(2)} SELECT video, count(*) AS n, round(regr_slope(py, px), 6) AS slope, round(regr_intercept(py, px), 6) AS intercept FROM q2 GROUP BY video""")
def a10(spark, sf):
    f = fits.robust_line(entry_points(spark, sf), ["video"], "px", "py")
    return f.select("video", "n", r(F.col("slope")).alias("slope"), r(F.col("intercept")).alias("intercept"))


def _principal_sql(passes: int) -> str:
    ax = """SELECT video, count(*) AS n, avg(px) AS mx, avg(py) AS my, cos(atan2(2*covar_pop(px, py), var_pop(px)-var_pop(py))/2) AS dx,
  sin(atan2(2*covar_pop(px, py), var_pop(px)-var_pop(py))/2) AS dy FROM q{i} GROUP BY video"""
    sql = f"""{PTS}, q0 AS (SELECT video, x AS px, x*((video%9)/4.0::DOUBLE)+w+CASE WHEN part%20=0 THEN 200 ELSE 0 END AS py FROM pts)"""
    for i in range(passes):
        sql += f""", f{i} AS ({ax.format(i=i)}), r{i} AS (SELECT q{i}.*, abs((py-my)*dx-(px-mx)*dy) AS res FROM q{i} JOIN f{i} USING (video)),
m{i} AS (SELECT video, median(res) AS med FROM r{i} GROUP BY video), k{i} AS (SELECT r{i}.*, res<=greatest(14, 2*med) AS keep FROM r{i} JOIN m{i} USING (video)),
q{i+1} AS (SELECT video, px, py FROM (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY video) AS nk FROM k{i}) WHERE keep OR nk<10)"""
    return sql + f", fin AS ({ax.format(i=passes)})"


@query("a11_principal_direction", f"WITH {_principal_sql(2)} SELECT video, n, round(dx, 6) AS dx, round(dy, 6) AS dy FROM fin")
def a11(spark, sf):
    f = fits.principal_direction(entry_points(spark, sf), ["video"], "px", "py")
    return f.select("video", "n", r(F.col("dx")).alias("dx"), r(F.col("dy")).alias("dy"))


@query("a12_series_summary", f"""WITH {DET} SELECT site, count(*) AS n, round(median(y), 6) AS median, round(quantile_cont(y, 0.6), 6) AS p60, round(quantile_cont(y, 0.95), 6) AS p95,
  round(avg(y), 6) AS mean, max(y) AS max, round(stddev_pop(y), 6) AS sd FROM det GROUP BY site""")
def a12(spark, sf):
    s = fits.series_summary(detections(spark, sf), ["site"], "y")
    return s.select("site", "n", *[r(F.col(c)).alias(c) for c in ("median", "p60", "p95", "mean")], "max", r(F.col("sd")).alias("sd"))


@query("a13_energy_ratio", f"""WITH {DET}, {MARKS}, fr AS (SELECT video, frame*3600.0::DOUBLE AS t, quantile_cont(y, 0.95) AS energy FROM det GROUP BY ALL),
j AS (SELECT mark, quantile_cont(CASE WHEN t BETWEEN mt-12960 AND mt+125280 THEN energy END, 0.8) AS loud, quantile_cont(CASE WHEN t BETWEEN mt-362880 AND mt-216000 THEN energy END, 0.8) AS quiet
  FROM marks JOIN fr USING (video) WHERE t BETWEEN mt-362880 AND mt+125280 GROUP BY mark)
SELECT marks.mark, round(CASE WHEN quiet>0.01 THEN loud/quiet END, 5) AS ratio, CASE WHEN quiet>0.01 THEN loud/quiet END<0.85 AS still FROM marks LEFT JOIN j USING (mark)""")
def a13(spark, sf):
    # a frame is one picture: its few values fit in one buffer
    fr = detections(spark, sf).groupBy("video", (F.col("frame") * num(HOUR)).alias("t")).agg(F.percentile("y", F.lit(0.95)).alias("energy"))
    out = fits.energy_ratio(marks(spark, sf), fr, ["video"], "mt", (-0.15 * DAY, 1.45 * DAY), (-4.2 * DAY, -2.5 * DAY), 5 * DAY)
    return out.withColumn("ratio", r(F.col("ratio"), 5))


@query("a14_baseline_deviation", f"""WITH {PTS}, c AS (SELECT video, frame//500 AS f, line AS cell, y FROM pts), fr AS (SELECT DISTINCT video, f FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY f) AS rn, count(*) OVER (PARTITION BY video) AS n FROM fr), e AS (SELECT video, f FROM p WHERE rn<=greatest(4, n//3)),
b AS (SELECT video, cell, median(y) AS base FROM c JOIN e USING (video, f) GROUP BY ALL), s AS (SELECT video, f, avg(CASE WHEN abs(y-base)>18 THEN 1.0::DOUBLE ELSE 0 END) AS s FROM c JOIN b USING (video, cell) GROUP BY ALL)
SELECT video, round(max(s), 6) AS peak, arg_min(f, (-s, f)) AS at, round(avg(s), 6) AS mean FROM s GROUP BY video""")
def a14(spark, sf):
    p = points(spark, sf).select("video", F.floor(F.col("frame") / 500).alias("f"), F.col("line").alias("cell"), "y")
    out = fits.baseline_deviation(p, ["video"], "f", "cell", "y")
    return out.select("video", r(F.col("peak")).alias("peak"), "at", r(F.col("mean")).alias("mean"))


# ---------------------------------------------------------------- colour and identity

HSV = f"""{PTS}, hsv AS (SELECT * EXCLUDE (h), site||kind AS name, CAST((part*7)%180 AS DOUBLE) AS h, x*5 AS s, y*2.4::DOUBLE AS v FROM pts)"""


def hsv(spark, sf) -> DataFrame:
    c = F.col
    return points(spark, sf).withColumns({"name": F.concat("site", "kind"), "h": (c("part") * 7 % 180).cast("double"), "s": c("x") * 5, "v": c("y") * num(2.4)})


REFS = f"""{HSV}, refs AS (SELECT name, ((atan2(sum(sin(h*pi()/90)), sum(cos(h*pi()/90)))*90/pi())%180+180)%180 AS h, median(s) AS s, median(v) AS v
  FROM hsv WHERE part%6=length(name)+ascii(name)%3 GROUP BY name)"""


def colour_refs(spark, sf) -> DataFrame:
    chosen = hsv(spark, sf).filter((F.col("part") % 6) == F.length("name") + F.ascii("name") % 3)
    return idn.calibrate(chosen, ["name"])


@query("i01_calibrate", f"WITH {REFS} SELECT name, round(h, 5) AS h, round(s, 6) AS s, round(v, 6) AS v FROM refs")
def i01(spark, sf):
    return colour_refs(spark, sf).select("name", r(F.col("h"), 5).alias("h"), r(F.col("s")).alias("s"), r(F.col("v")).alias("v"))


@query("i02_hue_gap", f"WITH {HSV} SELECT {ID_SQL}, least(abs(h-97.5)%180, 180-abs(h-97.5)%180)::DOUBLE AS gap FROM hsv")
def i02(spark, sf):
    return hsv(spark, sf).select(*ID, color.hue_gap(F.col("h"), num(97.5)).alias("gap"))


@query("i03_classify", f"""WITH {REFS}, sc AS (SELECT frame, line, part, refs.name, CASE WHEN (hsv.s<60)<>(refs.s<60) THEN 1e6 WHEN refs.s<60 THEN abs(hsv.v-refs.v)
  ELSE least(abs(hsv.h-refs.h)%180, 180-abs(hsv.h-refs.h)%180)*4.0+abs(hsv.s-refs.s)*0.35+abs(hsv.v-refs.v)*0.2 END AS d, hsv.x, hsv.y FROM hsv, refs),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame, line, part, x, y ORDER BY d, name) AS k FROM sc)
SELECT frame, line, part, max(CASE WHEN k=1 THEN name END) AS match, round(greatest(0, least(1, (max(CASE WHEN k=2 THEN d END)-max(CASE WHEN k=1 THEN d END))/greatest(max(CASE WHEN k=2 THEN d END), 1e-6))), 4) AS confidence
FROM rk GROUP BY frame, line, part, x, y""")
def i03(spark, sf):
    out = idn.classify(hsv(spark, sf), colour_refs(spark, sf))
    return out.select(*ID, "match", r(F.col("confidence"), 4).alias("confidence"))


@query("i04_hue_names", f"""WITH {PTS}, n AS (SELECT *, CASE WHEN line=7 THEN -1 WHEN line=6 THEN -2 WHEN line=5 THEN NULL ELSE (part*7)%360 END AS hue FROM pts)
SELECT {ID_SQL}, CASE WHEN hue IS NULL THEN NULL WHEN hue=-1 THEN 'white' WHEN hue=-2 THEN 'black' WHEN hue>=30 AND hue<75 THEN 'yellow' WHEN hue>=75 AND hue<165 THEN 'green'
  WHEN hue>=165 AND hue<265 THEN 'blue' ELSE 'pink' END AS colour FROM n""")
def i04(spark, sf):
    c = F.col
    hue = F.when(c("line") == 7, -1).when(c("line") == 6, -2).when(c("line") != 5, c("part") * 7 % 360)
    return points(spark, sf).select(*ID, color.hue_name(hue).alias("colour"))


def hues(spark, sf) -> DataFrame:
    h = F.when(F.col("seq") % 10 == 0, -1).otherwise(F.col("seq") * 13 % 360).cast("double")
    return detections(spark, sf).withColumn("hue", h)


HUES = f"{DET}, hues AS (SELECT *, (CASE WHEN seq%10=0 THEN -1 ELSE (seq*13)%360 END)::DOUBLE AS hue FROM det)"


@query("i05_hue_vote", f"""WITH {HUES}, b AS (SELECT *, CASE WHEN hue<0 THEN -1 ELSE (floor(hue/30)*30)::BIGINT END AS band FROM hues),
n AS (SELECT video, site, band, count(*) AS votes, min((t, seq)) AS o, median(hue) AS med FROM b GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY video, site ORDER BY votes DESC, o) AS rk FROM n)
SELECT video, site, band, votes, CASE WHEN band<0 THEN -1.0::DOUBLE ELSE round(med, 6) END AS hue FROM k WHERE rk=1""")
def i05(spark, sf):
    out = idn.hue_vote(hues(spark, sf), ["video", "site"], "hue", ["t", "seq"])
    return out.withColumn("hue", r(F.col("hue")))


@query("i06_hue_histogram", f"""WITH {HUES}, h AS (SELECT video, (floor(hue/20)*20)::BIGINT AS bin, count(*) AS n, median(w*conf) AS median_w FROM hues GROUP BY ALL)
SELECT video, bin, n, round(median_w, 6) AS median_w, n>=greatest(3, 0.05::DOUBLE*sum(n) OVER (PARTITION BY video)) AS strong FROM h""")
def i06(spark, sf):
    rows = hues(spark, sf).withColumn("wc", F.col("w") * F.col("conf"))
    return idn.hue_histogram(rows, ["video"], "hue", "wc", 20).withColumn("median_w", r(F.col("median_w")))


@query("i07_overlap_groups", """WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate)/1e6 AS t0, epoch_us(o_orderdate)/1e6+(o_orderkey%200)*86400.0::DOUBLE AS t1 FROM orders),
m AS (SELECT *, max(t1) OVER (PARTITION BY o_custkey ORDER BY t0, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o)
SELECT o_custkey, o_orderkey, sum(CASE WHEN reach IS NULL OR t0>reach THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY t0, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS overlap_group FROM m""")
def i07(spark, sf):
    from flightline.plans.inputs import seconds
    t0 = seconds("o_orderdate")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", t0.alias("t0"), (t0 + (F.col("o_orderkey") % 200) * num(DAY)).alias("t1"))
    s = Series(("o_custkey",), "t0", "o_orderkey", 365 * DAY)
    return idn.overlap_groups(o, s, "t1").select("o_custkey", "o_orderkey", "overlap_group")


COLOURS = ("red", "cyan", "lime", "white", "black")


def tracklets(spark, sf) -> DataFrame:
    """Two weeks of one user and site are a tracklet; event ids vote for colours by confidence."""
    d = detections(spark, sf).withColumns({"half": F.floor(F.col("t") / (14 * DAY)), "colour": F.element_at(
        F.array(*[F.lit(c) for c in COLOURS]), (F.col("seq") % 5 + 1).cast("int"))})
    d = d.withColumn("tid", F.xxhash64("video", "site", "half"))
    v = d.groupBy("video", "tid", "colour").agg(F.round(F.sum("conf"), 6).alias("w"))
    span = d.groupBy("video", "tid").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    votes = v.groupBy("video", "tid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("colour", "w")))).alias("votes"))
    return span.join(votes, ["video", "tid"])


def assignments(spark, sf) -> DataFrame:
    tr = cut(tracklets(spark, sf))
    grouped = cut(idn.overlap_groups(tr, Series(("video",), "t0", "tid", 14 * DAY), "t1"))
    roster = spark.range(1).select(F.explode(F.create_map(*[F.lit(v) for p in (("red", "p1"), ("cyan", "p2"), ("lime", "p3")) for v in p])).alias("colour", "player"))
    return idn.assign(grouped, roster, ["video", "overlap_group"], "tid")


@query("i08_assignment")
def i08(spark, sf):
    return assignments(spark, sf).filter((F.col("player").isNotNull()) & (F.col("confidence") != 0.5))


@query("i09_elimination")
def i09(spark, sf):
    return assignments(spark, sf).filter(F.col("player").isNull() | (F.col("confidence") == 0.5))


@query("i10_known_colours", f"""WITH {HSV} SELECT {ID_SQL}, name FROM hsv WHERE video%4=0 OR (video%4=1 AND name IN ('AF', 'NO')) OR (video%4=2 AND name='RF') OR (video%4=3 AND name IN ('AO', 'RO', 'NF'))""")
def i10(spark, sf):
    pick = (F.when(F.col("video") % 4 == 0, F.array().cast("array<string>")).when(F.col("video") % 4 == 1, F.array(F.lit("AF"), F.lit("NO")))
            .when(F.col("video") % 4 == 2, F.array(F.lit("RF"))).otherwise(F.array(F.lit("AO"), F.lit("RO"), F.lit("NF"))))
    return hsv(spark, sf).filter(idn.known_colours(F.col("name"), pick)).select(*ID, "name")


@query("i11_best_blob", f"""WITH {PTS}, b AS (SELECT frame, line, part, site, w, h, w*h*(0.3+conf*0.5) AS area, y AS cy, (part*7)%360 AS hue FROM pts),
k AS (SELECT *, area*CASE site WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.75 ELSE 0.55 END AS score FROM b WHERE area BETWEEN 10 AND 90 AND greatest(w, h)/least(w, h)<=2.8 AND area/(w*h)>=0.45 AND cy<=0.75*110),
s AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, line, part) AS rk FROM k) SELECT frame, site AS kind, hue, round(score, 6) AS score FROM s WHERE rk=1""")
def i11(spark, sf):
    b = points(spark, sf).select("frame", "line", "part", F.col("site").alias("kind"), "w", "h",
                                 (F.col("w") * F.col("h") * (0.3 + F.col("conf") * 0.5)).alias("area"), F.col("y").alias("cy"), (F.col("part") * 7 % 360).alias("hue"))
    return idn.best_blob(b, ["frame"], ["line", "part"], 10, 90, num(110)).withColumn("score", r(F.col("score")))


@query("i12_uncovered_caps", f"""WITH {PTS}, c AS (SELECT * FROM pts WHERE line>2), b AS (SELECT frame, x-15 AS x1, x+15 AS x2, y-30 AS y1, y+30 AS y2 FROM pts WHERE line<=2)
SELECT {ID_SQL}, round(x-w*1.2, 6) AS bx1, round(y+w*4.0, 6) AS by2 FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.frame=c.frame AND c.x BETWEEN b.x1 AND b.x2 AND c.y BETWEEN b.y1 AND b.y2)""")
def i12(spark, sf):
    p = points(spark, sf)
    boxes = p.filter("line <= 2").select("frame", (F.col("x") - 15).alias("x1"), (F.col("x") + 15).alias("x2"), (F.col("y") - 30).alias("y1"), (F.col("y") + 30).alias("y2"))
    out = idn.uncovered(p.filter("line > 2"), boxes, ["frame"])
    return out.select(*ID, r(F.col("bx1")).alias("bx1"), r(F.col("by2")).alias("by2"))


@query("i13_separability", """WITH e AS (SELECT vec_id AS id, label, vec_id//20 AS frame, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT list_dot_product(a.v, b.v) AS d FROM e a JOIN e b ON a.label=b.label AND a.id<b.id AND abs(a.frame-b.frame)>=2),
f AS (SELECT list_dot_product(a.v, b.v) AS d FROM e a JOIN e b ON a.frame=b.frame AND a.id<b.id AND a.label<>b.label),
m AS (SELECT (SELECT avg(d) FROM s) AS ms, (SELECT avg(d) FROM f) AS mf, (SELECT stddev_pop(d) FROM s) AS ss, (SELECT stddev_pop(d) FROM f) AS sf, (SELECT count(*) FROM s) AS ns, (SELECT count(*) FROM f) AS nf),
h AS (SELECT (SELECT count(*) FROM s, m WHERE d>(ms+mf)/2)+(SELECT count(*) FROM f, m WHERE d<=(ms+mf)/2) AS hit)
SELECT ns AS n_same, round(ms, 6) AS mean_same, round(ss, 6) AS sd_same, nf AS n_diff, round(mf, 6) AS mean_diff, round(sf, 6) AS sd_diff, round(ms-mf, 6) AS gap,
 round((ms-mf)/(sqrt((ss*ss+sf*sf)/2)+1e-9), 5) AS gap_sd, round(hit/(ns+nf), 6) AS accuracy FROM m, h""")
def i13(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("identity"), F.floor(F.col("vec_id") / 20).alias("frame"),
                                              F.col("embedding").cast("array<double>").alias("vec"))
    out = idn.separability(e)
    return out.select("n_same", "n_diff", *[r(F.col(c), 5 if c == "gap_sd" else 6).alias(c) for c in out.columns if not c.startswith("n_")])


@query("i14_median_hue_above", f"""WITH {HSV}, p AS (SELECT video, quantile_cont(s, 0.92) AS p92 FROM hsv GROUP BY video)
SELECT video, count(*) AS n, round(median(h), 6) AS hue FROM hsv JOIN p USING (video) WHERE s>=greatest(p92, 90) AND least(abs(h-100)%180, 180-abs(h-100)%180)>15 GROUP BY video HAVING count(*)>=20""")
def i14(spark, sf):
    return idn.reading_above(hsv(spark, sf), ["video"], "h", "s", 100.0).withColumn("hue", r(F.col("hue")))
