"""Cleaning (C) and source/sink (S) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightline.functions import clock
from flightline.functions.geometry import in_box, num
from flightline.operators import cleaning as cl
from flightline.operators import events as ev
from flightline.operators import sites
from flightline.plans.inputs import DET, PTS, by_site, detections, points, r, seconds, table
from flightline.plans.registry import query
from flightline.sources import labels as lb
from flightline.sources import notes

ID, ID_SQL = ["frame", "line", "part"], "frame, line, part"


@query("c01_region_of_interest", f"WITH {PTS} SELECT {ID_SQL}, x, y FROM pts WHERE x BETWEEN 10 AND 40 AND y BETWEEN 5 AND 60+video%20")
def c01(spark, sf):
    pool_y2 = (F.col("video") % 20 + 60).cast("double")
    return points(spark, sf).filter(in_box(F.col("x"), F.col("y"), 10, 5, 40, pool_y2)).select(*ID, "x", "y")


PARKED = f"""{DET}, cells AS (SELECT *, floor(x/250)::BIGINT AS cx, floor(y/40)::BIGINT AS cy FROM det),
dead AS (SELECT video, cx, cy, count(DISTINCT frame) AS seen, any_value(total) AS total FROM cells
  JOIN (SELECT video, count(DISTINCT frame) AS total FROM det GROUP BY video) USING (video) GROUP BY video, cx, cy
  HAVING count(DISTINCT frame)>0.25*any_value(total))"""


def squared(spark, sf):
    return detections(spark, sf).withColumn("x", F.col("x") / 6.25)  # 250 of x per 40-wide cell


@query("c02_parked_cells", f"WITH {PARKED} SELECT * FROM dead")
def c02(spark, sf):
    return cl.parked_cells(squared(spark, sf), ["video"])


@query("c03_drop_parked", f"""WITH {PARKED}, k AS (SELECT cells.* FROM cells ANTI JOIN dead USING (video, cx, cy))
SELECT det.video, count(k.seq) AS kept, count(*)-count(k.seq) AS dropped FROM det LEFT JOIN k USING (seq) GROUP BY det.video""")
def c03(spark, sf):
    det = squared(spark, sf)
    kept = cl.drop_parked(det, ["video"]).groupBy("video").agg(F.count("*").alias("kept"))
    n = det.groupBy("video").agg(F.count("*").alias("n")).join(kept, "video", "left").na.fill(0, ["kept"])
    return n.select("video", "kept", (F.col("n") - F.col("kept")).alias("dropped"))


@query("c04_moving_ball", f"""WITH {DET}, fr AS (SELECT video, count(DISTINCT frame)*2 AS total FROM det GROUP BY video),
cells AS (SELECT *, floor(x/200/45)::BIGINT AS cx, floor(y/45)::BIGINT AS cy FROM det),
dead AS (SELECT video, cx, cy FROM cells JOIN fr USING (video) GROUP BY video, cx, cy HAVING count(DISTINCT frame)>0.25*any_value(total)),
k AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY conf DESC, seq) AS rk FROM cells ANTI JOIN dead USING (video, cx, cy))
SELECT video, frame, seq, conf FROM k WHERE rk=1""")
def c04(spark, sf):
    det = detections(spark, sf).withColumn("x", F.col("x") / 200)
    # every frame with a sighting, and as many again that had none
    frames = det.select("video", F.explode(F.array(F.col("frame") * 2, F.col("frame") * 2 + 1)).alias("frame"))
    return cl.moving_ball(det, frames, ["video"], ["seq"]).select("video", "frame", "seq", "conf")


@query("c05_one_box_per_ball", """WITH RECURSIVE b AS (SELECT l_orderkey AS t, l_partkey*10+l_linenumber AS id, l_quantity AS x, l_tax*500 AS y,
  l_discount*100+2 AS w, 1-l_discount AS conf FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY conf DESC, id, x) AS rn FROM b),
f AS (SELECT t, 0::BIGINT AS rn, []::STRUCT(x DOUBLE, y DOUBLE)[] AS kept, NULL::BIGINT AS id, false AS ok FROM (SELECT DISTINCT t FROM o)
  UNION ALL SELECT o.t, o.rn, CASE WHEN len(list_filter(kept, lambda k: sqrt((o.x-k.x)*(o.x-k.x)+(o.y-k.y)*(o.y-k.y))<1.2::DOUBLE*greatest(1.0::DOUBLE, o.w)))=0
    THEN list_append(kept, {'x': o.x, 'y': o.y}) ELSE kept END, o.id,
    len(list_filter(kept, lambda k: sqrt((o.x-k.x)*(o.x-k.x)+(o.y-k.y)*(o.y-k.y))<1.2::DOUBLE*greatest(1.0::DOUBLE, o.w)))=0
  FROM f JOIN o ON o.t=f.t AND o.rn=f.rn+1)
SELECT t, id FROM f WHERE ok""")
def c05(spark, sf):
    li = table(spark, sf, "lineitem")
    b = li.select(F.col("l_orderkey").cast("double").alias("t"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"),
                  F.col("l_quantity").alias("x"), (F.col("l_tax") * 500).alias("y"), (F.col("l_discount") * 100 + 2).alias("w"),
                  (1 - F.col("l_discount")).alias("conf"))
    return cl.one_box_per_ball(b, [], "id").select(F.col("t").cast("long").alias("t"), "id")


@query("c06_one_box_per_frame", f"WITH {PTS} SELECT frame, max(conf) AS conf, arg_min(part*10+line, (-conf, part*10+line)) AS id FROM pts GROUP BY frame")
def c06(spark, sf):
    p = points(spark, sf).withColumn("id", F.col("part") * 10 + F.col("line")).select("frame", "id", "conf")
    return cl.best_per_frame(p, [], ["id"]).select("frame", "conf", "id")


@query("c07_frame_interval", f"""WITH {DET}, s AS (SELECT video, site, t-lag(t) OVER (PARTITION BY video, site ORDER BY t) AS dt FROM det)
SELECT video, site, round(min(CASE WHEN dt>0 AND dt<21600 THEN dt END), 6) AS frame_dt,
  round(coalesce(min(CASE WHEN dt>0 AND dt<21600 THEN dt END)*(1.0::DOUBLE/1800), 1), 6) AS scale FROM s GROUP BY ALL""")
def c07(spark, sf):
    from flightline.plans.event_queries import G
    out = ev.frame_scale(detections(spark, sf), by_site(), G)
    return out.select("video", "site", r(F.col("frame_dt")).alias("frame_dt"), r(F.col("scale")).alias("scale"))


@query("c08_match_radius", f"""WITH {DET}, s AS (SELECT video, site, t-lag(t) OVER (PARTITION BY video, site ORDER BY t) AS dt FROM det)
SELECT video, site, round(150*greatest(1, least(1.5::DOUBLE, coalesce(min(CASE WHEN dt>0 AND dt<21600 THEN dt END)*(1.0::DOUBLE/1800), 1))), 6) AS radius FROM s GROUP BY ALL""")
def c08(spark, sf):
    from flightline.plans.event_queries import G
    out = ev.frame_scale(detections(spark, sf), by_site(), G)
    return out.select("video", "site", r(ev.match_radius(F.col("scale"))).alias("radius"))


LABEL = """lab AS (SELECT doc_id, CASE WHEN toxic=1 THEN 'notshot' WHEN quality=1 THEN 'make' WHEN doc_id%3=0 THEN 'airball' WHEN doc_id%3=1 THEN 'offiron' ELSE '' END AS label,
  quality, toxic FROM labels)"""
MISSES = ("offiron", "behind", "airball", "airnet", "inout")  # fixed values


def judged(spark, sf):
    c = F.col
    label = (F.when(c("toxic") == 1, "notshot").when(c("quality") == 1, "make").when(c("doc_id") % 3 == 0, "airball")
             .when(c("doc_id") % 3 == 1, "offiron").otherwise(""))
    return table(spark, sf, "labels").withColumn("label", label)


@query("c09_label_classes", f"""WITH {LABEL} SELECT CASE WHEN label='make' THEN 'used: make' WHEN label IN ('offiron', 'airball') THEN 'used: miss'
  ELSE 'skipped: '||label END AS reason, count(*) AS n FROM lab GROUP BY 1""")
def c09(spark, sf):
    m = lb.model_labels(judged(spark, sf), "label", "make", MISSES)
    reason = F.when(F.col("y") == 1, "used: make").when(F.col("y") == 0, "used: miss").otherwise(F.concat(F.lit("skipped: "), "skipped"))
    return m.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("c10_default_end", f"WITH {PTS} SELECT {ID_SQL}, round(CASE WHEN y>x THEN y ELSE x+1.4::DOUBLE END, 6) AS t_end FROM pts")
def c10(spark, sf):
    return points(spark, sf).select(*ID, r(cl.default_end(F.col("x"), F.col("y"))).alias("t_end"))


@query("c11_attribution_horizon", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey%5=0 OR epoch_us(o_orderdate)/1e6<=(788918400+(o_custkey%5)*31536000)::DOUBLE""")
def c11(spark, sf):
    until = F.when(F.col("o_custkey") % 5 != 0, (F.lit(788918400) + (F.col("o_custkey") % 5) * 31536000).cast("double"))
    return table(spark, sf, "orders").filter(cl.within_horizon(seconds("o_orderdate"), until)).select("o_orderkey", "o_custkey")


def frame_boxes(spark, sf):
    c = F.col
    return points(spark, sf).select("frame", (c("part") * 10 + c("line")).alias("bid"), "line", c("x").alias("x1"), (c("h") * 3).alias("y1"),
                                    (c("x") + c("w")).alias("x2"), (c("h") * 3 + c("w")).alias("y2"))


@query("c12_overlap_suppression")
def c12(spark, sf):
    boxes = frame_boxes(spark, sf)
    return cl.overlap_suppression(boxes, ["frame"], [F.col("line"), F.col("bid")], 0.25, ["bid", "x1", "y1", "x2", "y2"])


@query("c13_identity_transfer", f"""WITH {PTS}, b AS (SELECT frame, part*10+line AS bid, line, x AS x1, h*3 AS y1, x+w AS x2, h*3+w AS y2 FROM pts),
bx AS (SELECT * FROM b WHERE line>2), pk AS (SELECT frame, bid AS pid, x1, y1, x2, y2 FROM b WHERE line<=2),
j AS (SELECT bx.frame, pid, bid, greatest(least(bx.x2, pk.x2)-greatest(bx.x1, pk.x1), 0)*greatest(least(bx.y2, pk.y2)-greatest(bx.y1, pk.y1), 0)
  /greatest(least((bx.x2-bx.x1)*(bx.y2-bx.y1), (pk.x2-pk.x1)*(pk.y2-pk.y1)), 1e-9) AS share FROM bx JOIN pk USING (frame)),
k AS (SELECT *, row_number() OVER (PARTITION BY frame, pid ORDER BY share DESC, bid) AS rk FROM j WHERE share>0.2),
ow AS (SELECT frame, bid, min(pid) AS pid FROM k WHERE rk=1 GROUP BY ALL)
SELECT frame, bid, pid FROM bx LEFT JOIN ow USING (frame, bid)
UNION ALL SELECT frame, NULL, pid FROM pk WHERE NOT EXISTS (SELECT 1 FROM k WHERE rk=1 AND k.frame=pk.frame AND k.pid=pk.pid)""")
def c13(spark, sf):
    b = frame_boxes(spark, sf)
    picks = b.filter("line <= 2").withColumnRenamed("bid", "pid")
    return cl.identity_transfer(b.filter("line > 2"), picks, ["frame"], 0.2).select("frame", "bid", "pid")


# ---------------------------------------------------------------- sources and sinks


@query("s04_clock", f"""WITH {DET}, c AS (SELECT seq, t, (trunc(t)::BIGINT//60)::VARCHAR||':'||lpad((trunc(t)::BIGINT%60)::VARCHAR, 2, '0') AS clock FROM det)
SELECT seq, clock, split_part(clock, ':', 1)::DOUBLE*60+split_part(clock, ':', 2)::DOUBLE AS parsed FROM c""")
def s04(spark, sf):
    c = clock.format_clock(F.col("t"))
    return detections(spark, sf).select("seq", c.alias("clock"), clock.parse_clock(c).alias("parsed"))


def note_lines(spark, sf):
    """Every turn as a dictated line: a clock in front of the turn's own words."""
    c = table(spark, sf, "conversations")
    head = F.format_string("%d:%02d ", F.col("conv_id") % 40, F.col("turn") * 7 % 60)
    extra = F.element_at(F.array(*[F.lit(v) for v in ("left make", "right miss red", "LEFT dunk blue", "white", "")]), (F.col("turn") % 5 + 1).cast("int"))
    return c.select("conv_id", F.col("turn").alias("line_no"), F.concat(head, extra, F.lit(" "), "text").alias("line"))


@query("s05_notes_to_key", """WITH l AS (SELECT conv_id, turn, ((conv_id%40)*60+turn*7%60)::BIGINT AS t,
  lower(CASE turn%5 WHEN 0 THEN 'left make' WHEN 1 THEN 'right miss red' WHEN 2 THEN 'left dunk blue' WHEN 3 THEN 'white' ELSE '' END||' '||text) AS body FROM conversations),
w AS (SELECT conv_id, t, turn, unnest(regexp_split_to_array(body, '[^a-z]+')) AS word, generate_subscripts(regexp_split_to_array(body, '[^a-z]+'), 1) AS pos FROM l),
k AS (SELECT conv_id, t, arg_max(word, (turn, pos)) FILTER (word IN ('left', 'right')) AS hoop,
  arg_max(CASE WHEN word IN ('make', 'made', 'dunk') THEN 'make' ELSE 'miss' END, (turn, pos)) FILTER (word IN ('make', 'made', 'dunk', 'miss', 'missed', 'airball')) AS outcome,
  arg_max(word, (turn, pos)) FILTER (word IN ('red', 'blue', 'white', 'green', 'yellow', 'black', 'pink', 'purple')) AS cap, bool_or(word='dunk') AS dunk FROM w GROUP BY ALL)
SELECT conv_id, t, hoop, outcome, cap, dunk, hoop IS NOT NULL AND outcome IS NOT NULL AS complete FROM k""")
def s05(spark, sf):
    return notes.parse_notes(note_lines(spark, sf), ["conv_id"], "line", "line_no")


@query("s06_export_labelled", f"WITH {LABEL} SELECT doc_id, label, quality::BIGINT AS quality FROM lab WHERE label<>''")
def s06(spark, sf):
    return lb.export_labelled(judged(spark, sf), "label", {"doc_id": "long", "label": "string", "quality": "long"})


@query("s08_idempotent_append", """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey%3=0)""")
def s08(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return lb.missing_rows(o.filter("o_orderkey % 3 = 0"), o, ["o_orderkey"])


@query("s10_coverage", f"""WITH {DET} SELECT video, count(DISTINCT frame) AS scanned, max(frame)-min(frame)+1 AS wanted,
  round(100.0::DOUBLE*count(DISTINCT frame)/(max(frame)-min(frame)+1), 6) AS pct, 100.0::DOUBLE*count(DISTINCT frame)/(max(frame)-min(frame)+1)<=99 AS incomplete FROM det GROUP BY video""")
def s10(spark, sf):
    f = detections(spark, sf).select("video", "frame").distinct().groupBy("video").agg(
        F.count("*").alias("scanned"), (F.max("frame") - F.min("frame") + 1).alias("wanted"))
    pct = F.lit(100.0) * F.col("scanned") / F.col("wanted")
    return f.select("video", "scanned", "wanted", r(pct).alias("pct"), (pct <= 99).alias("incomplete"))


@query("s11_site_lookup", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_nationkey FROM lineitem JOIN supplier ON s_suppkey=l_suppkey""")
def s11(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return sites.with_sites(li, sup, ["l_suppkey"])


@query("s12_dimension_override", f"""WITH {PTS}, ov AS (SELECT video, CASE WHEN video%3<>0 THEN (video%10)/10.0::DOUBLE END AS a, CASE WHEN video%5<>0 THEN (video%7)/10.0::DOUBLE END AS i
  FROM (SELECT DISTINCT video FROM pts WHERE video%2=0))
SELECT {ID_SQL}, CASE WHEN a IS NOT NULL AND i IS NOT NULL THEN a ELSE 0.5::DOUBLE END AS along, CASE WHEN a IS NOT NULL AND i IS NOT NULL THEN i ELSE 0.8::DOUBLE END AS into_
FROM pts LEFT JOIN ov USING (video)""")
def s12(spark, sf):
    p = points(spark, sf).withColumns({"along": num(0.5), "into_": num(0.8)})
    ov = p.filter("video % 2 = 0").select("video").distinct().withColumns({
        "a": F.when(F.col("video") % 3 != 0, (F.col("video") % 10) / num(10)), "i": F.when(F.col("video") % 5 != 0, (F.col("video") % 7) / num(10))})
    return sites.override_pair(p, ov, ["video"], ["along", "into_"], ["a", "i"]).select(*ID, "along", "into_")


@query("s13_review_summary", f"WITH {LABEL} SELECT CASE WHEN label='' THEN '(none)' ELSE label END AS label, count(*) AS n FROM lab GROUP BY 1")
def s13(spark, sf):
    return lb.label_counts(judged(spark, sf), "label")


@query("s14_keyed_update", """WITH t AS (SELECT doc_id, CASE WHEN doc_id%4=0 THEN source END AS shooter, CASE WHEN doc_id%6=0 THEN lang END AS confirmed FROM documents)
SELECT doc_id, CASE WHEN confirmed IS NULL AND l.doc_id IS NOT NULL THEN 'q'||quality ELSE shooter END AS shooter, confirmed,
  CASE WHEN confirmed IS NOT NULL THEN 'kept' WHEN l.doc_id IS NOT NULL THEN 'updated' ELSE 'no source' END AS status FROM t LEFT JOIN labels l USING (doc_id)""")
def s14(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("source")).alias("shooter"),
                                             F.when(F.col("doc_id") % 6 == 0, F.col("lang")).alias("confirmed"))
    u = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("shooter"))
    return lb.keyed_update(t, u, ["doc_id"], ["shooter"], "confirmed")


@query("s15_retire_answered", """SELECT conv_id, turn, turn%2=0 AND NOT (turn%2=0 AND trim(CASE WHEN turn%3=0 THEN '  ' ELSE text END)<>'') AS active,
  CASE WHEN turn%2=0 AND trim(CASE WHEN turn%3=0 THEN '  ' ELSE text END)<>'' THEN 'retired' WHEN turn%2=0 THEN 'waiting' ELSE 'inactive' END AS status FROM conversations""")
def s15(spark, sf):
    c = table(spark, sf, "conversations").withColumns({"active": F.col("turn") % 2 == 0, "note": F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text"))})
    return lb.retire_answered(c, "active", "note").select("conv_id", "turn", "active", "status")


@query("s16_file_names", """WITH f AS (SELECT l_suppkey AS v, l_linenumber AS n, CASE WHEN l_tax>0.04 THEN '-3pt' ELSE '' END AS kind FROM lineitem)
SELECT 'V_'||v AS video, n::BIGINT AS n, count(*) FILTER (kind='')>0 AS plain, count(*) FILTER (kind='-3pt')>0 AS three FROM f GROUP BY v, n""")
def s16(spark, sf):
    li = table(spark, sf, "lineitem")
    names = li.select(F.concat(F.lit("pose-diag-V_"), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"),
                               F.when(F.col("l_tax") > 0.04, "-3pt").otherwise(""), F.lit(".jpg")).alias("name"))
    return notes.pivot_file_kinds(names, "name")


@query("s17_reconcile_files", """WITH a AS (SELECT 'doc_'||doc_id AS key, n_chars AS size FROM documents WHERE doc_id%7<>0),
b AS (SELECT 'doc_'||doc_id AS key, n_chars+doc_id*3 AS size FROM documents WHERE doc_id%5<>0)
SELECT key, a.size AS local_size, b.size AS published_size, CASE WHEN a.size IS NULL THEN 'only published' WHEN b.size IS NULL THEN 'only local'
  WHEN abs(a.size-b.size)<=2048 THEN 'same' ELSE 'differs' END AS state FROM a FULL JOIN b USING (key)""")
def s17(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    a = d.filter("doc_id % 7 <> 0").select(F.concat(F.lit("DOC-"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("name"), F.col("n_chars").alias("size"))
    b = d.filter("doc_id % 5 <> 0").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_x1y2z3a4b5.jpg")).alias("name"),
                                           (F.col("n_chars") + F.col("doc_id") * 3).alias("size"))
    return lb.reconcile_sizes(a, b, notes.file_key(F.col("name")), "size", 2048)


