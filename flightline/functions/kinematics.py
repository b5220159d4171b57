"""Ballistic least squares from moment sums, so that partial aggregation works.

x = d t + e and y = a t^2 + b t + c, with t counted from the group's first row to keep the sums well conditioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment_sums(t: Column, x: Column, y: Column) -> list[Column]:
    """The sums a fit needs; ``t`` must already be relative."""
    terms = {"n": F.lit(1.0), "s1": t, "s2": t * t, "s3": t * t * t, "s4": t * t * t * t, "sx": x, "stx": t * x,
             "sxx": x * x, "sy": y, "sty": t * y, "stty": t * t * y, "syy": y * y}
    return [F.sum(e).alias(k) for k, e in terms.items()]


def solve_xy(df: DataFrame) -> DataFrame:
    """Coefficients a..e from moment columns; null where fewer than four points or singular."""
    n, s1, s2, s3, s4, sy, sty, stty, sx, stx = (
        F.col(k) for k in ("n", "s1", "s2", "s3", "s4", "sy", "sty", "stty", "sx", "stx"))
    den = n * s2 - s1 * s1
    # Cramer's rule on [[s4,s3,s2],[s3,s2,s1],[s2,s1,n]]
    det = s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2)
    da = stty * (s2 * n - s1 * s1) - s3 * (sty * n - s1 * sy) + s2 * (sty * s1 - s2 * sy)
    db = s4 * (sty * n - s1 * sy) - stty * (s3 * n - s1 * s2) + s2 * (s3 * sy - sty * s2)
    dc = s4 * (s2 * sy - sty * s1) - s3 * (s3 * sy - sty * s2) + stty * (s3 * s1 - s2 * s2)
    # det of the normal matrix, relative to its size, tells whether the times are distinct enough
    ok = (n >= 4) & (F.abs(den) >= 1e-9) & (F.abs(det) > F.abs(s4 * s2 * n) * 1e-13)
    slope = (n * stx - s1 * sx) / den
    return df.withColumns({
        "a": F.when(ok, da / det), "b": F.when(ok, db / det), "c": F.when(ok, dc / det),
        "d": F.when(ok, slope), "e": F.when(ok, (sx - slope * s1) / n)})


def fit_arcs(df: DataFrame, keys: Sequence[str], t: str = "t", x: str = "x", y: str = "y") -> DataFrame:
    """One ballistic fit per group with its combined rms residual."""
    # x and y are centred as well: their sums of squares would otherwise swallow the residual
    ref = df.groupBy(*keys).agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    rel = df.join(ref, list(keys)).withColumn("_t", F.col(t) - F.col("t0"))
    sums = rel.groupBy(*keys).agg(F.first("t0").alias("t0"), F.first("t1").alias("t1"), F.first("_mx").alias("_mx"),
                                  F.first("_my").alias("_my"),
                                  *moment_sums(F.col("_t"), F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")))
    sol = solve_xy(sums)
    rss_x = F.col("sxx") - F.col("d") * F.col("stx") - F.col("e") * F.col("sx")
    rss_y = F.col("syy") - F.col("a") * F.col("stty") - F.col("b") * F.col("sty") - F.col("c") * F.col("sy")
    rms = F.sqrt(F.greatest(rss_x + rss_y, F.lit(0.0)) / F.col("n"))
    return sol.select(*keys, F.col("n").cast("long").alias("n"), "t0", "t1", "a", "b",
                      (F.col("c") + F.col("_my")).alias("c"), "d", (F.col("e") + F.col("_mx")).alias("e"),
                      F.when(F.col("a").isNotNull(), rms).alias("rms"))


def arc_x(t: Column) -> Column:
    return F.col("d") * (t - F.col("t0")) + F.col("e")


def arc_y(t: Column) -> Column:
    tt = t - F.col("t0")
    return F.col("a") * tt * tt + F.col("b") * tt + F.col("c")


def sag(a: Column, t_from: Column, t_to: Column) -> Column:
    """Greatest distance between an arc and the straight line across it."""
    return F.abs(a) * (t_to - t_from) * (t_to - t_from) / 8.0


def polyline(t_from: Column, t_to: Column, steps: int = 24) -> Column:
    """``steps + 1`` evenly spaced arc points as ARRAY<STRUCT<i,t,x,y>>."""
    def point(i: Column) -> Column:
        t = t_from + (t_to - t_from) * i / steps
        return F.struct(i.alias("i"), t.alias("t"), arc_x(t).alias("x"), arc_y(t).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), point)
