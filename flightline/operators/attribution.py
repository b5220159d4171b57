"""Who took the shot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightline.functions.geometry import box_distance, dist, dist2
from flightline.functions.kinematics import arc_x, arc_y
from flightline.operators.blocks import Series, drop_halo, with_halo
from flightline.operators.joins import point_in_interval
from flightline.runtime import cut

# fixed values
TOUCH, OPENED, SLACK, NEVER_HELD = 0.9, 0.6, 0.15, 4.0
REACH, ADMIT, FACE_TOWARD, FACE_AWAY, FACE_PULL = 110.0, 260.0, 0.20, -0.20, 60.0


def nearest_person(balls: DataFrame, people: DataFrame, keys: Sequence[str], back: int = 19, width: float = 64) -> DataFrame:
    """From the ball's frame back, the first frame holding anyone decides; there the nearest person wins."""
    spans = balls.select(*keys, "ball", F.col("frame").alias("_hi"), (F.col("frame") - back).alias("_lo"), F.col("x").alias("_bx"), F.col("y").alias("_by"))
    near = point_in_interval(people, spans, keys, "frame", "_lo", "_hi", width)
    d2 = dist2(F.col("x"), F.col("y"), F.col("_bx"), F.col("_by"))
    best = near.groupBy("ball").agg(F.min(F.struct((-F.col("frame")).alias("f"), d2.alias("d2"), F.col("person"))).alias("_b"))
    return balls.select("ball").join(best, "ball", "left").select(
        "ball", F.col("_b.person").alias("person"), (-F.col("_b.f")).alias("frame"), F.col("_b.d2").alias("d2"))


def with_next_gaps(series: DataFrame, s: Series, ahead: int) -> DataFrame:
    """Add ``after``: up to ``ahead`` following gaps, in order."""
    wide = with_halo(series, s, 0, ahead, ["gap"])
    w = s.window().rowsBetween(1, ahead)
    return drop_halo(wide.withColumn("after", F.collect_list("gap").over(w)))


def is_release(after: Column, gap: Column, touch: float = TOUCH, opened: float = OPENED, slack: float = SLACK) -> Column:
    """Hands on the ball, then a gap that keeps opening (never shrinking by more than the slack)."""
    steps = F.zip_with(F.slice(after, 1, F.size(after) - 1), F.slice(after, 2, F.size(after) - 1), lambda a, b: b >= a - slack)
    return (gap <= touch) & (F.size(after) >= 2) & F.forall(steps, lambda ok: ok) & (F.element_at(after, F.greatest(F.size(after), F.lit(1))) > gap + opened)


def releases(series: DataFrame, s: Series) -> DataFrame:
    """Each person's last release: the last moment the ball left those hands."""
    rows = with_next_gaps(series, s, 5)
    rows = rows.filter((F.col("gap") <= TOUCH) & (F.size("after") >= 2)).filter(is_release(F.col("after"), F.col("gap")))
    grew = F.element_at("after", -1) - F.col("gap")
    last = rows.groupBy(*s.keys).agg(F.max_by(F.struct(F.col(s.time).alias("t"), "gap", "lift", grew.alias("grew")), F.struct(*s.order)).alias("_r"))
    return last.select(*s.keys, "_r.*")


def candidates(series: DataFrame, s: Series, shot: Sequence[str], least: int = 4) -> DataFrame:
    """Everyone who let the ball go with hands up, nearest to the ball first."""
    seen = series.groupBy(*s.keys).agg(F.count("*").alias("n_seen"))
    rel = releases(series, s).join(seen, list(s.keys)).filter((F.col("n_seen") >= least) & (F.col("lift") > 0))
    person = [k for k in s.keys if k not in shot]
    w = Window.partitionBy(*shot).orderBy(F.col("gap"), F.col("t").desc(), *person)
    return rel.withColumn("rank", F.row_number().over(w))


def gate_report(series: DataFrame, s: Series) -> DataFrame:
    """Per person: frames, closest gap, highest hands, and whether a release was seen with hands up."""
    base = series.groupBy(*s.keys).agg(F.count("*").alias("frames"), F.min("gap").alias("min_gap"), F.max("lift").alias("max_lift"))
    j = base.join(releases(series, s).select(*s.keys, F.col("lift").alias("_l")), list(s.keys), "left")
    mark = F.when(F.col("_l").isNull(), "-").when(F.col("_l") > 0, "OK").otherwise("handsdown")
    return j.filter("frames >= 2").select(*s.keys, "frames", "min_gap", "max_lift", mark.alias("release"))


def people_at(moments: DataFrame, samples: DataFrame, keys: Sequence[str], moment: Sequence[str], person: str, t: str, reach: float = 0.25,
              hands_up: bool = False) -> DataFrame:
    """Each person's sample nearest the moment, without those who never held the ball or straddle with hands down.

    ``samples``: keys, person, t, gap, lift, side (null when unreadable).
    """
    never = samples.groupBy(*keys, person).agg(F.min("gap").alias("_g")).filter(F.coalesce("_g", F.lit(99.0)) > NEVER_HELD)
    usable = samples.join(never, [*keys, person], "left_anti")
    spans = moments.withColumns({"_lo": F.col(t) - reach, "_hi": F.col(t) + reach})
    near = point_in_interval(usable, spans.select(*keys, *moment, F.col(t).alias("_at"), "_lo", "_hi"), keys, "t", "_lo", "_hi", reach)
    cols = [c for c in samples.columns if c not in (*keys, person)]
    best = near.groupBy(*moment, person).agg(F.min_by(F.struct(*cols), F.struct(F.abs(F.col("t") - F.col("_at")).alias("d"), "t")).alias("_b"))
    return could_shoot(best.select(*moment, person, "_b.*"), hands_up)


def could_shoot(rows: DataFrame, hands_up: bool) -> DataFrame:
    """Without those who straddle with hands down; with ``hands_up`` only those with hands up."""
    up = F.coalesce(F.col("lift") > 0, F.lit(False))
    rows = rows.filter(~(F.coalesce(F.col("side") == 0, F.lit(False)) & ~up))
    return rows.filter(up) if hands_up else rows


def walk_back_among(flights: DataFrame, samples: DataFrame, keys: Sequence[str], shot: Sequence[str], reach: float = 90.0, back: float = 1.2, step: float = 1 / 60,
                    near: float = 0.25, hands_up: bool = False, order: str = "seq") -> DataFrame:
    """``walk_back`` with people who move: at every step each person stands where their sample nearest to that moment, at most ``near`` off, shows them.

    ``samples``: keys, person, t, ``order``, gap, lift, side, px1..py2; of equally near samples the earlier, of one moment the first by ``order``.  A sample serves the moments up to half way to
    its neighbours, so it meets only its own steps; a step meets one sample of each person, whatever the sampling rate.
    """
    steps = int(back / step)
    never = samples.groupBy(*keys, "person").agg(F.min("gap").alias("_g")).filter(F.coalesce("_g", F.lit(99.0)) > NEVER_HELD)
    seen = samples.join(never, [*keys, "person"], "left_anti")
    arcs = flights.select(*keys, *shot, "release_t", "t0", "a", "b", "c", "d", "e", (F.col("release_t") - back - near).alias("_lo"), (F.col("release_t") + near).alias("_hi"))
    rows = point_in_interval(seen, arcs, keys, "t", "_lo", "_hi", back + 2 * near)
    w = Window.partitionBy(*shot, "person").orderBy("t", order)
    rows = rows.withColumn("_before", F.lag("t").over(w)).filter("_before IS NULL OR _before < t")  # of samples of one moment the first
    rows = rows.withColumns({"_before": F.lag("t").over(w), "_after": F.lead("t").over(w)})
    number = lambda t: (F.col("release_t") - t) / step
    first = F.greatest(F.floor(number(F.least(F.col("t") + near, (F.col("t") + F.col("_after")) / 2))) - 1, F.lit(1))
    last = F.least(F.ceil(number(F.greatest(F.col("t") - near, (F.col("t") + F.col("_before")) / 2))) + 1, F.lit(steps))
    rows = rows.withColumn("_k", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn("_t", F.col("release_t") - F.col("_k") * step)
    off = lambda c: F.abs(F.col(c) - F.col("_t"))
    rows = rows.filter((off("t") <= near) & F.coalesce(off("t") < off("_before"), F.lit(True)) & F.coalesce(off("t") <= off("_after"), F.lit(True)))
    rows = could_shoot(rows, hands_up).withColumns({"_x": arc_x(F.col("_t")), "_y": arc_y(F.col("_t"))})
    rows = rows.withColumn("_d", box_distance(F.col("_x"), F.col("_y"), F.col("px1"), F.col("py1"), F.col("px2"), F.col("py2"))).filter(F.col("_d") <= reach)
    best = rows.groupBy(*shot).agg(F.min(F.struct(F.col("_k").alias("k"), F.col("person").alias("person"), F.col("_t").alias("t"), F.col("_x").alias("x"),
                                                  F.col("_y").alias("y"), F.col("_d").alias("dist"))).alias("_b"))
    return best.select(*shot, F.col("_b.k").alias("steps"), "_b.person", "_b.t", "_b.x", "_b.y", "_b.dist")


def walk_back(flights: DataFrame, people: DataFrame, shot: Sequence[str], reach: float = 90.0, back: float = 1.2, step: float = 1 / 60) -> DataFrame:
    """Run each parabola backwards until it comes within reach of someone's outline; the first such step wins."""
    steps = int(back / step)
    j = flights.join(people, list(shot))
    rows = j.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    t = F.col("release_t") - F.col("_k") * step
    rows = rows.withColumns({"_x": arc_x(t), "_y": arc_y(t), "_t": t})
    d = box_distance(F.col("_x"), F.col("_y"), F.col("px1"), F.col("py1"), F.col("px2"), F.col("py2"))
    hit = rows.withColumn("_d", d).filter(F.col("_d") <= reach)
    best = hit.groupBy(*shot).agg(F.min(F.struct(F.col("_k").alias("k"), F.col("person").alias("person"), F.col("_t").alias("t"), F.col("_x").alias("x"),
                                                 F.col("_y").alias("y"), F.col("_d").alias("dist"))).alias("_b"))
    return best.select(*shot, F.col("_b.k").alias("steps"), "_b.person", "_b.t", "_b.x", "_b.y", "_b.dist")


def attribute(shots: DataFrame, flights: DataFrame, people: DataFrame, cands: DataFrame, shot: Sequence[str], samples: DataFrame | None = None,
              caps: DataFrame | None = None, keys: Sequence[str] = (), near_s: float = 0.25, cap_s: float = 0.35) -> DataFrame:
    """Pick the shooter and say how: the arc's origin, walking the arc back, or the release shape.

    ``flights``: shot, release_t, release_x, release_y and fit.  ``people``: shot, person, box px1..py2, up (hands up),
    turn (wrists toward the hoop +/-, null unreadable), face (cosine to the hoop, null unreadable).  ``cands``: shot,
    person, rank.  People with hands up are tried first, everyone only for shots that leaves without an answer.
    With ``samples`` (as for ``walk_back_among``) people are looked up again at every step back, else they stand as in ``people``.
    With ``caps`` (keys, t, x, y, cap, w) a pick farther than ``REACH`` gives way to a cap at the release: ``how`` is "cap", ``person`` null, ``cap`` its id.
    Both need ``keys`` in ``flights``.
    """
    k = list(shot)
    near = flights.join(people, k).withColumn(
        "d", box_distance(F.col("release_x"), F.col("release_y"), F.col("px1"), F.col("py1"), F.col("px2"), F.col("py2")))
    people, near = cut(people), cut(near)
    answers, open_flights = [], flights
    for only_up in (True, False):
        mine = near.filter("up") if only_up else near
        mine = mine.filter(F.col("d") <= ADMIT)
        per = Window.partitionBy(*k)
        # people around one shot: a handful, so a window per shot is small
        mine = mine.withColumn("_n", F.count("*").over(per))
        out = F.coalesce((F.col("turn") < FACE_AWAY) | (F.col("turn") == 0.0), F.lit(False)) & (F.col("_n") > 1)
        mine = mine.withColumns({"_out": out, "_toward": F.max(F.coalesce(F.col("turn") > FACE_TOWARD, F.lit(False)) & (F.col("_n") > 1)).over(per)})
        mine = mine.withColumn("_left", F.sum(F.when(~F.col("_out"), 1).otherwise(0)).over(per))
        mine = mine.filter(~(F.col("_toward") & F.col("_out") & (F.col("_left") > 0)))
        mine = mine.withColumn("_n", F.count("*").over(per)).filter((F.col("d") <= REACH) | (F.col("_n") == 1))
        score = F.col("d") - F.coalesce(F.col("face"), F.lit(0.0)) * FACE_PULL
        arc = mine.withColumn("_s", score).groupBy(*k).agg(F.min(F.struct(F.col("_s").alias("s"), F.col("person").alias("person"), F.col("d").alias("d"))).alias("_b"))
        arc = arc.join(open_flights.select(*k), k, "left_semi").select(*k, "_b.person", F.col("_b.d").alias("dist"), F.lit("arc").alias("how"))
        arc = arc.join(flights.select(*k, F.col("release_t").alias("t"), F.col("release_x").alias("x"), F.col("release_y").alias("y")), k)
        rest = open_flights.join(arc.select(*k), k, "left_anti")
        if samples is None:
            back = walk_back(rest, people.filter("up") if only_up else people, k, REACH)
        else:
            back = walk_back_among(rest, samples, keys, k, REACH, near=near_s, hands_up=only_up)
        back = back.select(*k, "person", "dist", F.lit("walked back").alias("how"), "t", "x", "y")
        found = cut(arc.unionByName(back))
        answers.append(found)
        open_flights = cut(open_flights.join(found.select(*k), k, "left_anti"))
    by_arc = reduce(DataFrame.unionByName, answers)
    if caps is not None:
        origins = by_arc.join(flights.select(*keys, *k), k).select(*keys, *k, "t", "x", "y", F.col("dist").alias("wrist"))
        capped = cut(cap_fallback(origins, caps, keys, k, cap_s).withColumnRenamed("dist", "_cap_dist"))
        by_arc = by_arc.join(capped, k, "left").withColumns({
            "person": F.when(F.col("cap").isNull(), F.col("person")), "dist": F.coalesce("_cap_dist", "dist"), "how": F.when(F.col("cap").isNull(), F.col("how")).otherwise("cap")})
    by_arc = by_arc.drop("t", "x", "y", "_cap_dist")
    by_release = cands.filter("rank = 1").select(*k, "person", F.lit(None).cast("double").alias("dist"), F.lit("release").alias("how"))
    by_release = by_release.join(by_arc.select(*k), k, "left_anti")
    return shots.select(*k).join(by_arc.unionByName(by_release, allowMissingColumns=True), k, "left").withColumn("how", F.coalesce("how", F.lit("none")))


def cap_fallback(origins: DataFrame, caps: DataFrame, keys: Sequence[str], shot: Sequence[str], near_s: float = 0.35, widths: float = 5.0,
                 least_w: float = 28.0) -> DataFrame:
    """The cap at the release, only where no wrist explains it.  ``origins``: keys, shot, t, x, y, wrist (distance or null)."""
    lost = origins.filter(F.coalesce(F.col("wrist") > REACH, F.lit(True))).select(
        *keys, *shot, F.col("x").alias("_ox"), F.col("y").alias("_oy"), (F.col("t") - near_s).alias("_lo"), (F.col("t") + near_s).alias("_hi"))
    near = point_in_interval(caps, lost, keys, "t", "_lo", "_hi", max(near_s, 1e-9)).withColumn("_d", dist(F.col("x"), F.col("y"), F.col("_ox"), F.col("_oy")))
    best = near.groupBy(*shot).agg(F.min(F.struct(F.col("_d").alias("d"), F.col("cap").alias("cap"), F.col("w").alias("w"))).alias("_b"))
    return best.filter(F.col("_b.d") <= widths * F.greatest(F.lit(least_w), F.col("_b.w"))).select(*shot, F.col("_b.cap").alias("cap"), F.col("_b.d").alias("dist"))


def origin_candidate(flights: DataFrame, people: DataFrame, keys: Sequence[str], shot: Sequence[str], before: float = 0.40, after: float = 0.10) -> DataFrame:
    """The person track passing closest to the flight around the release.  ``people``: keys, person, t, px1..py2."""
    spans = flights.withColumns({"_lo": F.col("release_t") - before, "_hi": F.col("release_t") + after})
    near = point_in_interval(people, spans, keys, "t", "_lo", "_hi", max(before + after, 1e-9))
    d = box_distance(arc_x(F.col("t")), arc_y(F.col("t")), F.col("px1"), F.col("py1"), F.col("px2"), F.col("py2"))
    best = near.withColumn("_d", d).groupBy(*shot).agg(F.min(F.struct(F.col("_d").alias("d"), F.col("person").alias("person"))).alias("_b"))
    return best.select(*shot, F.col("_b.person").alias("person"), F.col("_b.d").alias("dist"))


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """How many rows reach each stage: a row reaches a stage when it passes it and all before."""
    reached, cols = F.lit(True), []
    for name, ok in stages:
        reached = reached & F.coalesce(ok, F.lit(False))
        cols.append(F.count_if(reached).alias(name))
    wide = df.agg(*cols)
    rows = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("stage_no"), F.lit(n).alias("stage"), F.col(n).alias("reached")) for i, (n, _) in enumerate(stages)]))
    return wide.select(rows.alias("_r")).select("_r.*")


