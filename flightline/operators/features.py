"""Rim-relative flight features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightline.functions.geometry import dist, in_box


def flight_features(points: DataFrame, keys: Sequence[str], t: str = "t", seq: str = "seq", min_points: int = 4, whole: bool = False,
                    more: Mapping[str, Column] | None = None) -> DataFrame:
    """22 features per flight, in rim widths.  ``points`` carry x, y, conf, prev_x, prev_y, prev_t (null at the first
    point) and the rim x1, y1, x2, y2.  ``more`` are further aggregates of a flight's points.

    Three aggregations over the same rows: where the apex is, where the fall first crosses the rim's height, and
    what happens from there on.  With ``whole`` a flight's rows already lie together (a series of whole keys): the first two are
    frames over the flight, and nothing is shuffled or joined.
    """
    k = list(keys)
    order = F.struct(t, seq)
    x, y = F.col("x"), F.col("y")
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    rw = F.greatest(F.lit(1.0), F.col("x2") - F.col("x1"))
    inside = in_box(x, y, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    frame = {"rw": F.max(rw), "cx": F.max(cx), "cy": F.max(cy), "n_det": F.count("*"),
             "_apex": F.min(F.struct(F.col("y").alias("y"), F.col(t).alias("t"), F.col(seq).alias("q")))}
    plain = {"_lo": F.min("y"), "_hi": F.max("y"), "dur": F.max(t) - F.min(t), "conf_max": F.max("conf"), "conf_mean": F.avg("conf"),
             "_md": F.min(dist(x, y, cx, cy)), "n_inside": F.count_if(inside), **(more or {})}
    falling = order >= F.struct(F.col("_apex.t").alias(t), F.col("_apex.q").alias(seq))
    # the pair's earlier point has to be on the falling side too
    first = (F.col(t) == F.col("_apex.t")) & (F.col(seq) == F.col("_apex.q"))
    crosses = ~first & (F.col("prev_y") <= F.col("cy")) & (F.col("cy") <= y) & (y > F.col("prev_y"))
    frac = (F.col("cy") - F.col("prev_y")) / F.greatest(F.lit(1e-6), y - F.col("prev_y"))
    dt = F.greatest(F.lit(1e-6), F.col(t) - F.col("prev_t"))
    cross = F.struct(F.col(t).alias("o"), F.col(seq).alias("q"), (F.col("prev_x") + frac * (x - F.col("prev_x"))).alias("x"),
                     (F.col("prev_t") + frac * (F.col(t) - F.col("prev_t"))).alias("t"), ((x - F.col("prev_x")) / dt).alias("vx"),
                     ((y - F.col("prev_y")) / dt).alias("vy"))
    tt = F.col(t) - F.col("_apex.t")
    past = F.col(t) > F.col("_c.t")

    def named(aggregates: Mapping[str, Column]) -> list[Column]:
        return [v.alias(n) for n, v in aggregates.items()]

    def fallen(on=lambda c: c) -> dict[str, Column]:
        return {"desc_n": F.count(on(F.lit(1))), "_vx": F.var_pop(on(x)), "_vt": F.var_pop(on(tt)), "_cv": F.covar_pop(on(x), on(tt))}

    def passed(on=lambda c: c) -> dict[str, Column]:
        return {"n_after": F.count(on(F.lit(1))), "_l": F.max_by(on(F.struct("x", "y")), on(order)), "_mx": F.max(on(F.abs(x - F.col("_c.x")))),
                "_sx": F.stddev_pop(on(x))}

    if whole:
        flight = Window.partitionBy(*k)
        known = points.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in k]))
        rows = known.withColumns({n: v.over(flight) for n, v in frame.items()}).filter(F.col("n_det") >= min_points)
        rows = rows.withColumn("_fell", falling).withColumn("_c", F.min(F.when(F.col("_fell") & crosses, cross)).over(flight))
        j = rows.groupBy(*k).agg(*[F.first(c).alias(c) for c in (*frame, "_c")], *named(plain), *named(fallen(lambda v: F.when(F.col("_fell"), v))),
                                 *named(passed(lambda v: F.when(F.col("_fell") & past, v))))
    else:
        base = points.groupBy(*k).agg(*named(frame), *named(plain)).filter(F.col("n_det") >= min_points)
        fall = points.join(base, k).filter(falling)
        down = fall.groupBy(*k).agg(*named(fallen()), F.min(F.when(crosses, cross)).alias("_c"))
        cd = down.select(*k, "_c").filter(F.col("_c").isNotNull())
        after = fall.join(cd, k).filter(past).groupBy(*k).agg(*named(passed()))
        j = base.join(down, k).join(after, k, "left")
    c, zero, w = F.col("_c"), F.lit(0.0), F.col("rw")
    slope = F.col("_cv") / F.when(F.col("_vt") > 0, F.col("_vt")).otherwise(1e-6)
    resid = F.sqrt(F.greatest(zero, F.col("_vx") - 2 * slope * F.col("_cv") + slope * slope * F.col("_vt")))
    out = {
        "peak_above": (F.col("cy") - F.col("_lo")) / w, "total_drop": (F.col("_hi") - F.col("_lo")) / w, "n_det": F.col("n_det").cast("double"),
        "dur": F.col("dur"), "conf_max": F.col("conf_max"), "conf_mean": F.col("conf_mean"), "min_dist": F.col("_md") / w,
        "n_inside": F.col("n_inside").cast("double"), "frac_inside": F.col("n_inside") / F.col("n_det"), "desc_n": F.col("desc_n").cast("double"),
        "crossed": F.when(c.isNotNull(), 1.0).otherwise(0.0), "cross_dx": F.coalesce((c["x"] - F.col("cx")) / w, zero),
        "cross_adx": F.coalesce(F.abs(c["x"] - F.col("cx")) / w, zero),
        "cross_angle": F.coalesce(F.degrees(F.atan2(F.abs(c["vy"]), F.abs(c["vx"]) + 1e-6)), zero),
        "cross_vratio": F.coalesce(F.abs(c["vx"]) / (F.abs(c["vy"]) + 1e-6), zero), "n_after": F.coalesce(F.col("n_after"), F.lit(0)).cast("double"),
        "dx_after": F.coalesce(F.abs(F.col("_l.x") - c["x"]) / w, zero), "dy_after": F.coalesce((F.col("_l.y") - F.col("cy")) / w, zero),
        "max_dx_after": F.coalesce(F.col("_mx") / w, zero), "x_spread_after": F.coalesce(F.col("_sx") / w, zero),
        "desc_x_resid": F.when(F.col("desc_n") >= 4, resid / w).otherwise(zero),
        "desc_x_slope": F.when(F.col("desc_n") >= 4, F.abs(slope) / w).otherwise(zero),
    }
    return j.select(*k, *named(out), *(more or {}))


FEATURES = sorted([
    "peak_above", "total_drop", "n_det", "dur", "conf_max", "conf_mean", "min_dist", "n_inside", "frac_inside", "desc_n", "crossed", "cross_dx",
    "cross_adx", "cross_angle", "cross_vratio", "n_after", "dx_after", "dy_after", "max_dx_after", "x_spread_after", "desc_x_resid", "desc_x_slope"])
