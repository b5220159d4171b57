"""Geometric predicate (P) queries, mostly on lineitem read as points and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.functions import geometry as geo
from flightline.functions import pose
from flightline.operators.landing import landing_points, landing_summary, through_depth, zone_hits
from flightline.operators.sites import orientation
from flightline.plans.inputs import DAY, DET, MARKS, PTS, RIM_SQL, detections, marks, points, r, table, with_rim
from flightline.plans.registry import query

ID = ["frame", "line", "part"]
ID_SQL = "frame, line, part"


def rigged(spark, sf) -> DataFrame:
    """Points with a rim of their own, a tilt, and a wall direction."""
    x1 = (F.col("part") % 3 * 5 + 10).cast("double")
    return points(spark, sf).withColumns({
        "rx1": x1, "rx2": x1 + 12.0, "ry1": F.lit(20.0), "ry2": F.lit(28.0), "tilt": (F.col("part") % 5 * 10 - 20).cast("double")})


RIG = f"""{PTS}, rig AS (SELECT *, CAST(part%3*5+10 AS DOUBLE) AS rx1, CAST(part%3*5+22 AS DOUBLE) AS rx2, 20.0::DOUBLE AS ry1,
  28.0::DOUBLE AS ry2, CAST(part%5*10-20 AS DOUBLE) AS tilt FROM pts)"""


def sql_inside(corners: list[tuple[str, str]], x: str = "x", y: str = "y") -> str:
    edges = []
    for (px, py), (qx, qy) in zip(corners, [*corners[1:], corners[0]]):
        edges.append(f"(CASE WHEN (({py})>{y})<>(({qy})>{y}) THEN CASE WHEN {x}<(({qx})-({px}))*({y}-({py}))/(({qy})-({py}))+({px}) "
                     "THEN 1 ELSE 0 END ELSE 0 END)")
    return "((" + "+".join(edges) + ")%2=1)"


PENTAGON = [("rx1", "ry1"), ("rx2", "ry1+3"), ("rx2+4", "ry2+9"), ("rx1+6", "ry2+14"), ("rx1-5", "ry2+4")]


@query("p01_point_in_polygon", f"WITH {RIG} SELECT {ID_SQL}, {sql_inside(PENTAGON)} AS inside FROM rig")
def p01(spark, sf):
    poly = F.array(*[F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")) for x, y in PENTAGON])
    return rigged(spark, sf).select(*ID, geo.contains(poly, F.col("x"), F.col("y")).alias("inside"))


_C = "((rx1+rx2)/2)"
_W = "(rx2-rx1)"


def _plane_sql(sign_s: str, sign_d: str) -> tuple[str, str]:
    s, dd = f"((part%4)/10.0::DOUBLE{sign_s}0.52::DOUBLE)", f"(0.8::DOUBLE{sign_d}0.55::DOUBLE)"
    return (f"trunc({_C}+0.8::DOUBLE*{s}*{_W}+(-0.6::DOUBLE)*{dd}*{_W})", f"trunc(ry2+2+0.6::DOUBLE*{s}*{_W}+0.8::DOUBLE*{dd}*{_W})")


def _sheared_sql(x: str, depth: str) -> tuple[str, str]:
    return (f"trunc({x})", f"trunc(({depth})+(part%7)/10.0::DOUBLE*(({x})-{_C}))")


_TOP = f"ry2+4+0.3::DOUBLE*{_W}*0.5"
_BOT = f"({_TOP})+(1.3::DOUBLE-0.3::DOUBLE)*{_W}"
_LX, _RX = f"{_C}-0.52::DOUBLE*{_W}", f"{_C}+0.52::DOUBLE*{_W}"
ZONES_SQL = {
    "A": [_plane_sql("-", "-"), _plane_sql("-", "+"), _plane_sql("+", "+"), _plane_sql("+", "-")],
    "N": [_sheared_sql(_LX, _TOP), _sheared_sql(_RX, _TOP), _sheared_sql(_RX, _BOT), _sheared_sql(_LX, _BOT)],
    "R": [(f"trunc({_LX})", f"trunc(ry2+0.3::DOUBLE*{_W})"), (f"trunc({_RX})", f"trunc(ry2+0.3::DOUBLE*{_W})"),
          (f"trunc({_RX})", f"trunc(ry2+1.3::DOUBLE*{_W})"), (f"trunc({_LX})", f"trunc(ry2+1.3::DOUBLE*{_W})")]}


def zones():
    c = F.col
    w, cx = c("rx2") - c("rx1"), (c("rx1") + c("rx2")) / 2
    plane = geo.zone_on_plane(w, (cx, c("ry2") + 2), (geo.num(0.8), geo.num(0.6)), (geo.num(-0.6), geo.num(0.8)),
                              ((c("part") % 4) / geo.num(10), geo.num(0.8)))
    sheared = geo.zone_sheared(c("rx1"), c("rx2"), c("ry2") + 4, (c("part") % 7) / geo.num(10))
    box = geo.box_corners(geo.zone_box(c("rx1"), c("ry2"), c("rx2")))
    pick = lambda i, k: F.when(c("site") == "A", plane[i][k]).when(c("site") == "N", sheared[i][k]).otherwise(box[i][k])
    return [(pick(i, 0), pick(i, 1)) for i in range(4)]


def _zone_case(i: int, k: int) -> str:
    z = ZONES_SQL
    return f"CASE site WHEN 'A' THEN {z['A'][i][k]} WHEN 'N' THEN {z['N'][i][k]} ELSE {z['R'][i][k]} END"


@query("p02_zone_corners", f"WITH {RIG} SELECT {ID_SQL}, " + ", ".join(
    f"{_zone_case(i, k)} AS {'xy'[k]}{i}" for i in range(4) for k in range(2)) + " FROM rig")
def p02(spark, sf):
    z = zones()
    return rigged(spark, sf).select(*ID, *[z[i][k].alias(f"{'xy'[k]}{i}") for i in range(4) for k in range(2)])


@query("p03_dropped_in_zone", f"""WITH {DET}, {MARKS}, rr AS (SELECT *, {RIM_SQL} FROM det),
zz AS (SELECT *, trunc((x1+x2)/2-0.52::DOUBLE*(x2-x1)) AS bx1, trunc((x1+x2)/2+0.52::DOUBLE*(x2-x1)) AS bx2,
  trunc(y2+0.3::DOUBLE*(x2-x1)) AS by1, trunc(y2+1.3::DOUBLE*(x2-x1)) AS by2 FROM rr)
SELECT mark, EXISTS (SELECT 1 FROM zz WHERE zz.video=marks.video AND zz.t BETWEEN mt-25920 AND mt+138240 AND x>=bx1 AND x<bx2
  AND y>=by1 AND y<by2) AS dropped FROM marks""")
def p03(spark, sf):
    corners = geo.box_corners(geo.zone_box(F.col("x1"), F.col("y2"), F.col("x2")))
    inside = with_rim(detections(spark, sf)).filter(geo.inside_polygon(corners, F.col("x"), F.col("y"))).select("video", "t")
    return zone_hits(marks(spark, sf), inside, ["video"], ["mark"], "mt", 0.3 * DAY, 1.6 * DAY, DAY).select("mark", "dropped")


ELL = """(pow(((x-(rx1+rx2)/2)*cos(radians(tilt))+({y}-(ry1+ry2)/2)*sin(radians(tilt)))/((rx2-rx1)/2), 2)
 +pow((({y}-(ry1+ry2)/2)*cos(radians(tilt))-(x-(rx1+rx2)/2)*sin(radians(tilt)))/((ry2-ry1)/2), 2))"""


@query("p04_in_ellipse", f"WITH {RIG} SELECT {ID_SQL}, {ELL.format(y='y')}<=1.0 AS inside FROM rig")
def p04(spark, sf):
    c = F.col
    ratio = geo.ellipse_ratio(c("x"), c("y"), c("rx1"), c("ry1"), c("rx2"), c("ry2"), c("tilt"))
    return rigged(spark, sf).select(*ID, (ratio <= 1.0).alias("inside"))


@query("p05_through_depth", f"""WITH {DET}, {MARKS}, q AS (SELECT video, seq, t,
  pow((x-250)/240.0::DOUBLE, 2)+pow((y-w/2-40)/50.0::DOUBLE, 2) AS ratio FROM det),
j AS (SELECT mark, t, 1-sqrt(ratio) AS depth, row_number() OVER (PARTITION BY mark ORDER BY 1-sqrt(ratio) DESC, t, q.seq) AS k
  FROM marks JOIN q USING (video) WHERE t BETWEEN mt-86400 AND mt+86400 AND ratio<1)
SELECT marks.mark, round(coalesce(depth, 0), 6) AS depth, round(t, 3) AS at FROM marks LEFT JOIN j ON j.mark=marks.mark AND k=1""")
def p05(spark, sf):
    ratio = geo.ellipse_ratio(F.col("x"), F.col("y") - F.col("w") / 2, 10.0, -10.0, 490.0, 90.0, 0.0)
    hits = detections(spark, sf).select("video", "seq", "t", ratio.alias("ratio"))
    out = through_depth(marks(spark, sf), hits, ["video"], ["mark"], "mt", DAY, DAY)
    return out.select("mark", r(F.col("depth")).alias("depth"), r(F.col("at"), 3).alias("at"))


@query("p06_three_point_call", f"""WITH {RIG}, s AS (SELECT *, 
  w*(24-ry1)-(h*2)*((rx1+rx2)/2-10) AS hs, w*(y-ry1)-(h*2)*(x-10) AS bs FROM rig)
SELECT {ID_SQL}, CASE WHEN line=7 THEN NULL WHEN hs=0 OR bs=0 THEN NULL ELSE (hs>0)<>(bs>0) END AS is_three FROM s""")
def p06(spark, sf):
    c = F.col
    p, q = (geo.num(10), c("ry1")), (geo.num(10) + c("w"), c("ry1") + c("h") * 2)
    body = (F.when(c("line") != 7, c("x")), F.when(c("line") != 7, c("y")))
    call = geo.across_line(p, q, ((c("rx1") + c("rx2")) / 2, geo.num(24)), body)
    return rigged(spark, sf).select(*ID, call.alias("is_three"))


@query("p07_line_margin", f"""WITH {RIG} SELECT {ID_SQL}, round(abs(((10.0::DOUBLE+w)-10.0::DOUBLE)*(y-ry1)-((ry1+h*2)-ry1)*(x-10.0::DOUBLE))/sqrt((10.0::DOUBLE-(10.0::DOUBLE+w))*(10.0::DOUBLE-(10.0::DOUBLE+w))+(ry1-(ry1+h*2))*(ry1-(ry1+h*2)))/12.0::DOUBLE, 6) AS margin FROM rig""")
def p07(spark, sf):
    c = F.col
    p, q = (geo.num(10), c("ry1")), (geo.num(10) + c("w"), c("ry1") + c("h") * 2)
    return rigged(spark, sf).select(*ID, r(geo.line_margin(p, q, (c("x"), c("y")), c("rx2") - c("rx1"))).alias("margin"))


def poses(spark, sf) -> DataFrame:
    """Each embedding read as a 17-point pose."""
    e = lambda i: F.col("embedding")[i].cast("double")
    kp = F.array(*[F.struct((e(3 * i) * 400 + 200).alias("x"), (e(3 * i + 1) * 400 + 200).alias("y"),
                            (F.abs(e(3 * i + 2)) * 5).alias("c")) for i in range(17)])
    return table(spark, sf, "embeddings").select("vec_id", "label", kp.alias("kp"))


_J = ", ".join(f"embedding[{3*i+1}]::DOUBLE*400+200 AS x{i}, embedding[{3*i+2}]::DOUBLE*400+200 AS y{i}, "
               f"abs(embedding[{3*i+3}]::DOUBLE)*5 AS c{i}" for i in range(17))


def _cnt(idx):
    return "(" + "+".join(f"(CASE WHEN c{i}>0.25 THEN 1 ELSE 0 END)" for i in idx) + ")"


def _mean(idx, ax):
    return "((" + "+".join(f"(CASE WHEN c{i}>0.25 THEN {ax}{i} ELSE 0 END)" for i in idx) + f")/nullif({_cnt(idx)}, 0))"


POSE = f"""kp AS (SELECT vec_id, label, {_J} FROM embeddings),
pp AS (SELECT *, c5>0.25 AND c6>0.25 AS sh, CASE WHEN c5>0.25 AND c6>0.25 THEN sqrt((x5-x6)*(x5-x6)+(y5-y6)*(y5-y6)) END AS sn,
  {_cnt((0, 1, 2))} AS face, {_cnt((3, 4))} AS ears, {_cnt((7, 8, 9, 10))} AS limbs, {_mean((7, 8, 9, 10), 'x')} AS lx,
  {_mean((7, 8, 9, 10), 'y')} AS ly, {_mean((0, 1, 2, 3, 4), 'x')} AS hx0, {_mean((0, 1, 2, 3, 4), 'y')} AS hy0,
  {_cnt((11, 12))} AS hips, {_cnt((5, 6))} AS shs, {_mean((11, 12), 'x')} AS hipx, {_mean((11, 12), 'y')} AS hipy,
  {_mean((5, 6), 'x')} AS shx, {_mean((5, 6), 'y')} AS shy FROM kp)"""


@query("p08_body_point", f"""WITH {POSE} SELECT vec_id, round(CASE WHEN hips>0 THEN hipx WHEN shs>0 THEN shx END, 6) AS bx,
  round(CASE WHEN hips>0 THEN hipy WHEN shs>0 THEN shy END, 6) AS by_ FROM pp""")
def p08(spark, sf):
    b = pose.body_point(F.col("kp"))
    return poses(spark, sf).select("vec_id", r(b["x"]).alias("bx"), r(b["y"]).alias("by_"))


FACING = f"""{POSE}, fa AS (SELECT *, -(y5-y6)/sn AS ax, (x5-x6)/sn AS ay FROM pp),
fb AS (SELECT *, ax*(lx-(x5+x6)/2)+ay*(ly-(y5+y6)/2) AS proj FROM fa),
fc AS (SELECT *, CASE WHEN face>=2 THEN true WHEN face=0 AND ears>=1 AND limbs=0 THEN false
  WHEN limbs>0 AND abs(proj)>sn*0.10 THEN (ay>0)=(proj>0) ELSE x5>x6 END AS cam FROM fb),
fd AS (SELECT *, CASE WHEN sn>=8 THEN CASE WHEN (ay>0)=cam THEN ax ELSE -ax END END AS fx,
  CASE WHEN sn>=8 THEN CASE WHEN (ay>0)=cam THEN ay ELSE -ay END END AS fy,
  coalesce(sn>=26, false) AND (face>=2 OR ears>=1 OR limbs>=2) AS readable FROM fc)"""


@query("p09_facing", f"""WITH {FACING} SELECT vec_id, round(fx, 6) AS fx, round(fy, 6) AS fy, readable,
  round(CASE WHEN readable THEN (fx*(500-(x5+x6)/2)+fy*(100-(y5+y6)/2))/sqrt((500-(x5+x6)/2)*(500-(x5+x6)/2)+
    (100-(y5+y6)/2)*(100-(y5+y6)/2)) END, 6) AS toward FROM fd""")
def p09(spark, sf):
    kp = F.col("kp")
    f = pose.facing(kp)
    cx, cy = (kp[5]["x"] + kp[6]["x"]) / 2, (kp[5]["y"] + kp[6]["y"]) / 2
    return poses(spark, sf).select("vec_id", r(f["x"]).alias("fx"), r(f["y"]).alias("fy"), pose.readable(kp).alias("readable"),
                                   r(pose.toward(kp, geo.num(500), geo.num(100), cx, cy)).alias("toward"))


@query("p10_side", f"""WITH {POSE}, a AS (SELECT *, coalesce(hx0, CASE WHEN sh THEN (x5+x6)/2 END) AS hx,
  greatest(12.0::DOUBLE, abs(x5-x6)) AS sw, {_cnt((9, 10))} AS nw FROM pp),
b AS (SELECT *, CASE WHEN c9>0.25 THEN (x9-hx)/sw END AS o1, CASE WHEN c10>0.25 THEN (x10-hx)/sw END AS o2 FROM a),
c AS (SELECT *, (coalesce(o1, 0)+coalesce(o2, 0))/nullif(nw, 0) AS m FROM b),
d AS (SELECT *, (nw=2 AND least(o1, o2)<-0.15 AND greatest(o1, o2)>0.15) OR abs(m)<0.15 AS flat, hx IS NOT NULL AND sh AND nw>0 AS ok FROM c)
SELECT vec_id, CASE WHEN ok THEN CASE WHEN flat THEN 0 WHEN m>0 THEN 1 ELSE -1 END END AS dir,
  round(CASE WHEN ok THEN CASE WHEN flat THEN 0 ELSE least(1.0::DOUBLE, abs(m)) END END, 6) AS strength,
  round(CASE WHEN ok THEN CASE WHEN flat THEN 0 WHEN (m>0)=(500>hx) THEN least(1.0::DOUBLE, abs(m)) ELSE -least(1.0::DOUBLE, abs(m)) END END, 6)
    AS toward_target FROM d""")
def p10(spark, sf):
    kp = F.col("kp")
    s = pose.side(kp)
    return poses(spark, sf).select("vec_id", s["dir"].alias("dir"), r(s["strength"]).alias("strength"),
                                   r(pose.side_toward(kp, geo.num(500), pose.head_x(kp))).alias("toward_target"))


@query("p11_orientation", f"""WITH {PTS}, wd AS (SELECT video, site, max(part%50+10) AS width FROM pts GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY width DESC, site) AS k FROM wd),
ask AS (SELECT DISTINCT video, CASE WHEN line=7 THEN 'X' ELSE site END AS site FROM pts)
SELECT ask.video, ask.site, CASE WHEN k IS NULL THEN 0 WHEN k=1 THEN 1 ELSE -1 END AS orientation FROM ask LEFT JOIN rk USING (video, site)""")
def p11(spark, sf):
    pts = points(spark, sf)
    widths = pts.groupBy("video", "site").agg(F.max(F.col("part") % 50 + 10).alias("width"))
    ask = pts.select("video", F.when(F.col("line") == 7, "X").otherwise(F.col("site")).alias("site")).distinct()
    return orientation(ask, widths, ["video"], "site", "width")


@query("p12_line_meet", f"""WITH {PTS}, a AS (SELECT *, x AS ax1, y AS ay1, x+w AS ax2, y+h AS ay2, x AS bx1, y+h AS by1, x+h AS bx2, y+w AS by2 FROM pts),
b AS (SELECT *, (ax1-ax2)*(by1-by2)-(ay1-ay2)*(bx1-bx2) AS det, ax1*ay2-ay1*ax2 AS ca, bx1*by2-by1*bx2 AS cb FROM a)
SELECT {ID_SQL}, round(CASE WHEN abs(det)>=1e-6 THEN (ca*(bx1-bx2)-(ax1-ax2)*cb)/det END, 4) AS mx,
  round(CASE WHEN abs(det)>=1e-6 THEN (ca*(by1-by2)-(ay1-ay2)*cb)/det END, 4) AS my FROM b""")
def p12(spark, sf):
    c = F.col
    m = geo.line_meet(((c("x"), c("y")), (c("x") + c("w"), c("y") + c("h"))),
                      ((c("x"), c("y") + c("h")), (c("x") + c("h"), c("y") + c("w"))))
    return points(spark, sf).select(*ID, r(m["x"], 4).alias("mx"), r(m["y"], 4).alias("my"))


@query("p13_direction_families", f"""WITH {PTS}, e AS (SELECT *, w-6 AS dx, h-5 AS dy, frame*10+line AS eid FROM pts),
g AS (SELECT *, sqrt(dx*dx+dy*dy) AS len, ((degrees(atan2(dy, dx))%180)+180)%180 AS ang FROM e),
b AS (SELECT video, arg_max(ang, (round(len, 9), -eid, -part)) AS base FROM g GROUP BY video)
SELECT {ID_SQL}, least(abs(ang-base), 180-abs(ang-base))<35 AS along FROM g JOIN b USING (video)""")
def p13(spark, sf):
    from flightline.operators.sites import direction_families
    c = F.col
    edges = points(spark, sf).withColumns({
        "ang": geo.direction_deg(0.0, 0.0, c("w") - 6, c("h") - 5), "eid": c("frame") * 10 + c("line"),
        "len": r(geo.dist(c("w"), c("h"), 6.0, 5.0), 9)})
    return direction_families(edges, ["video"], "ang", "len", ["eid", "part"]).select(*ID, "along")


@query("p14_axis_offsets", f"""WITH {RIG} SELECT {ID_SQL}, round(((x-(rx1+rx2)/2)*0.8::DOUBLE+(y-30)*0.6::DOUBLE)/12, 6) AS along_off,
  round(((x-(rx1+rx2)/2)*(-0.6::DOUBLE)+(y-30)*0.8::DOUBLE)/12, 6) AS into_off FROM rig""")
def p14(spark, sf):
    c = F.col
    o = ((c("rx1") + c("rx2")) / 2, geo.num(30))
    w = c("rx2") - c("rx1")
    a = geo.axis_offset(c("x"), c("y"), o, (geo.num(0.8), geo.num(0.6)), w)
    i = geo.axis_offset(c("x"), c("y"), o, (geo.num(-0.6), geo.num(0.8)), w)
    return rigged(spark, sf).select(*ID, r(a).alias("along_off"), r(i).alias("into_off"))


@query("p15_view_transform", f"""WITH {RIG} SELECT {ID_SQL}, round((x-((x+w)-x)*0.28::DOUBLE)/3840*100, 6) AS px, round((y-((y+h)-y)*0.28::DOUBLE)/2160*100, 6) AS py,
  round((((x+w)+((x+w)-x)*0.28::DOUBLE)-(x-((x+w)-x)*0.28::DOUBLE))/3840*100, 6) AS pw,
  round((((y+h)+((y+h)-y)*0.28::DOUBLE)-(y-((y+h)-y)*0.28::DOUBLE))/2160*100, 6) AS ph,
  round(greatest(0, x-((y+h)-y)*0.18::DOUBLE), 6) AS cx1, round(least(50, x+w+((y+h)-y)*0.18::DOUBLE), 6) AS cx2,
  round((x-rx1)*(640/12.0::DOUBLE), 6) AS vx, round((y-ry1)*(360/8.0::DOUBLE), 6) AS vy FROM rig""")
def p15(spark, sf):
    c = F.col
    b = [c("x"), c("y"), c("x") + c("w"), c("y") + c("h")]
    pct = geo.percent_box(b, (0, 0, 3840, 2160), 0.28)
    pad = geo.padded_clamped(b, 0.18, 50.0, 110.0)
    view = geo.into_view(b, (c("rx1"), c("ry1"), c("rx2"), c("ry2")), 640.0, 360.0)
    return rigged(spark, sf).select(*ID, *[r(v).alias(n) for v, n in zip(pct, ("px", "py", "pw", "ph"))],
                                    r(pad[0]).alias("cx1"), r(pad[2]).alias("cx2"), r(view[0]).alias("vx"), r(view[1]).alias("vy"))


@query("p16_landing_centre", f"""WITH {DET}, {MARKS}, j AS (SELECT mark, video, det.site, x, y, row_number() OVER (PARTITION BY mark ORDER BY t DESC, seq DESC) AS k
  FROM marks JOIN det USING (video) WHERE outcome='make' AND t BETWEEN mt-25920 AND mt+138240),
o AS (SELECT video, site, ((x-250)*0.8+(y-40)*0.6)/60 AS s, ((x-250)*(-0.6)+(y-40)*0.8)/60 AS d FROM j WHERE k=1)
SELECT coalesce(video::VARCHAR, '(all)') AS video, coalesce(site, '(all)') AS site, count(*) AS n, round(median(s), 6) AS along_med, round(stddev_pop(s), 6) AS along_sd,
  round(median(d), 6) AS into_med, round(stddev_pop(d), 6) AS into_sd FROM o GROUP BY GROUPING SETS ((video, site), (site), ())""")
def p16(spark, sf):
    makes = marks(spark, sf).filter(F.col("outcome") == "make")
    last = landing_points(makes, detections(spark, sf), ["video"], ["mark"], "mt", 0.3 * DAY, 1.6 * DAY, DAY)
    o = (geo.num(250), geo.num(40))
    off = last.select(F.col("video").cast("string").alias("video"), "site", geo.axis_offset(F.col("x"), F.col("y"), o, (geo.num(0.8), geo.num(0.6)), 60.0).alias("s"),
                      geo.axis_offset(F.col("x"), F.col("y"), o, (geo.num(-0.6), geo.num(0.8)), 60.0).alias("d"))
    return landing_summary(off, ["video", "site"], {"along": "s", "into": "d"})


@query("a08_box_distance", f"""WITH {RIG} SELECT {ID_SQL}, round(sqrt(pow(greatest(rx1-x, 0, x-rx2), 2)+pow(greatest(ry1-y, 0, y-ry2), 2)), 6) AS dist FROM rig""")
def a08(spark, sf):
    c = F.col
    return rigged(spark, sf).select(*ID, r(geo.box_distance(c("x"), c("y"), c("rx1"), c("ry1"), c("rx2"), c("ry2"))).alias("dist"))


