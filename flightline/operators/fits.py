"""Line fits with rejection, series summaries and before/after comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.operators.blocks import Series, running
from flightline.operators.joins import point_in_interval
from flightline.operators.quantiles import quantiles
from flightline.runtime import cut


def _median_of(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return quantiles(df, keys, value, {"_med": 0.5}).select(*keys, "_med")


def robust_line(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", floor: float = 18.0, passes: int = 2,
                least: int = 8) -> DataFrame:
    """y = slope x + intercept per group; twice drop residuals over max(floor, 2 medians), keeping at least ``least``."""
    k = list(keys)
    rows = df.select(*k, F.col(x).alias("x"), F.col(y).alias("y"))
    fit = lambda d: d.groupBy(*k).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    rows = rows.join(rows.groupBy(*k).count().filter(F.col("count") >= least).drop("count"), k, "left_semi")
    for _ in range(passes):
        res = cut(rows.join(fit(rows), k).withColumn("_r", F.abs(F.col("y") - (F.col("slope") * F.col("x") + F.col("intercept")))).drop("n", "slope", "intercept"))
        marked = res.join(_median_of(res, k, "_r"), k).withColumn("_keep", F.col("_r") <= F.greatest(F.lit(floor), 2 * F.col("_med")))
        enough = marked.groupBy(*k).agg((F.count_if("_keep") >= least).alias("_ok"))
        rows = marked.join(enough, k).filter(F.col("_keep") | ~F.col("_ok")).select(*k, "x", "y")
    return fit(cut(rows))


def principal_direction(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", floor: float = 14.0, passes: int = 2,
                        least: int = 10) -> DataFrame:
    """Direction of greatest spread per group, twice dropping points far off the axis; unit vector (dx, dy), dx >= 0."""
    k = list(keys)
    rows = df.select(*k, F.col(x).alias("x"), F.col(y).alias("y"))
    rows = rows.join(rows.groupBy(*k).count().filter(F.col("count") >= least).drop("count"), k, "left_semi")

    def axis(d: DataFrame) -> DataFrame:
        m = d.groupBy(*k).agg(F.count("*").alias("n"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.var_pop("x").alias("_sxx"),
                              F.var_pop("y").alias("_syy"), F.covar_pop("x", "y").alias("_sxy"))
        half = F.atan2(2 * F.col("_sxy"), F.col("_sxx") - F.col("_syy")) / 2
        return m.select(*k, "n", "_mx", "_my", F.cos(half).alias("dx"), F.sin(half).alias("dy"))

    for _ in range(passes):
        off = F.abs((F.col("y") - F.col("_my")) * F.col("dx") - (F.col("x") - F.col("_mx")) * F.col("dy"))
        res = cut(rows.join(axis(rows), k).withColumn("_r", off).select(*k, "x", "y", "_r"))
        marked = res.join(_median_of(res, k, "_r"), k).withColumn("_keep", F.col("_r") <= F.greatest(F.lit(floor), 2 * F.col("_med")))
        enough = marked.groupBy(*k).agg((F.count_if("_keep") >= least).alias("_ok"))
        rows = marked.join(enough, k).filter(F.col("_keep") | ~F.col("_ok")).select(*k, "x", "y")
    return axis(cut(rows)).select(*k, "n", "dx", "dy")


def series_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    q = quantiles(df, keys, value, {"median": 0.5, "p60": 0.6, "p95": 0.95})
    a = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.stddev_pop(value).alias("sd"))
    return q.join(a, list(keys))


def energy_ratio(labels: DataFrame, frames: DataFrame, keys: Sequence[str], t: str, loud: tuple[float, float], quiet: tuple[float, float],
                 width: float, floor: float = 0.01, still: float = 0.85) -> DataFrame:
    """80th percentile of frame energy after a label over the same before it; null where the quiet part is silent.

    ``frames``: keys, t, energy - one row per frame, so a label's window is short.
    """
    lo, hi = min(loud[0], quiet[0]), max(loud[1], quiet[1])
    spans = labels.select(*keys, "mark", F.col(t).alias("_at"), (F.col(t) + lo).alias("_lo"), (F.col(t) + hi).alias("_hi"))
    near = point_in_interval(frames, spans, keys, "t", "_lo", "_hi", width).withColumn("_d", F.col("t") - F.col("_at"))
    p80 = lambda w: F.percentile(F.when((F.col("t") >= F.col("_at") + w[0]) & (F.col("t") <= F.col("_at") + w[1]), F.col("energy")), F.lit(0.8))
    out = near.groupBy("mark").agg(p80(loud).alias("loud"), p80(quiet).alias("quiet"))
    ratio = F.when(F.col("quiet") > floor, F.col("loud") / F.col("quiet"))
    return labels.select("mark").join(out, "mark", "left").select("mark", ratio.alias("ratio"), (ratio < still).alias("still"))


def baseline_deviation(df: DataFrame, keys: Sequence[str], frame: str, cell: str, value: str, least: int = 4, level: float = 18.0) -> DataFrame:
    """Share of cells leaving their own starting value, per frame: peak, when, and mean over the group's frames.

    The baseline of a cell is its median over the first third of the group's frames (at least ``least``).
    """
    k = list(keys)
    fr = df.select(*k, frame).distinct()
    place = running(fr, Series(tuple(k), frame, frame, 1024.0), {"_p": ("sum", F.lit(1).cast("long"))})
    total = fr.groupBy(*k).agg(F.count("*").alias("_n"))
    early = place.join(total, k).filter(F.col("_p") <= F.greatest(F.lit(least), F.floor(F.col("_n") / 3))).select(*k, frame)
    base = quantiles(df.join(early, [*k, frame], "left_semi"), [*k, cell], value, {"_b": 0.5}).select(*k, cell, "_b")
    dev = df.join(base, [*k, cell])
    share = dev.groupBy(*k, frame).agg(F.avg(F.when(F.abs(F.col(value) - F.col("_b")) > level, 1.0).otherwise(0.0)).alias("s"))
    return share.groupBy(*k).agg(F.max("s").alias("peak"), F.min(F.struct((-F.col("s")).alias("s"), F.col(frame).alias("f"))).alias("_p"),
                                 F.avg("s").alias("mean")).select(*k, "peak", F.col("_p.f").alias("at"), "mean")
