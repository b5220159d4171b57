"""Why shots were missed, and whether footage is usable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightline.functions.geometry import in_box
from flightline.operators.joins import point_in_interval
from flightline.operators.quantiles import quantiles
from flightline.operators.scoring import one


def detector_density(labels: DataFrame, hits: DataFrame, keys: Sequence[str], t: str, t_end: str, settings: Sequence[float], pad: float,
                     near_x: tuple[float, float], near_y: tuple[float, float], width: float) -> DataFrame:
    """Sightings near the rim per shot for several confidence floors: median, thin (<= 2) and dense (>= 6) shots."""
    spans = labels.select(*keys, "mark", (F.col(t) - pad).alias("_lo"), (F.col(t_end) + pad).alias("_hi"))
    close = hits.filter(in_box(F.col("x"), F.col("y"), near_x[0], near_y[0], near_x[1], near_y[1]))
    seen = point_in_interval(close, spans, keys, "t", "_lo", "_hi", width).groupBy("mark").agg(
        *[F.count_if(F.col("conf") >= c).alias(f"n{i}") for i, c in enumerate(settings)])
    per = labels.select("mark").join(seen, "mark", "left").na.fill(0)
    rows = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("setting"), F.col(f"n{i}").alias("seen")) for i, c in enumerate(settings)]))
    long = per.select(rows.alias("_r")).select("_r.*")
    q = quantiles(long, ["setting"], "seen", {"median": 0.5}).select("setting", "median")
    out = long.groupBy("setting").agg(F.sum(one(F.col("seen") <= 2)).alias("thin"), F.sum(one(F.col("seen") >= 6)).alias("dense")).join(q, "setting")
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("dense").desc(), "thin", "setting")
    return out.withColumn("best", F.row_number().over(w) == 1)


def miss_reasons(missed: DataFrame, hits: DataFrame, runs: DataFrame, keys: Sequence[str], seen_s: float, run_s: float, width: float,
                 few: int = 12, tiny: int = 3) -> DataFrame:
    """Per missed mark: sightings nearby, the longest run, and why the biggest rejected run failed.

    A shot hardly seen is the detector's miss, one seen in crumbs is the tracker's; only then is it a gate's.
    """
    near = missed.select(*keys, "mark", (F.col("mt") - seen_s).alias("_lo"), (F.col("mt") + seen_s).alias("_hi"))
    seen = point_in_interval(hits, near, keys, "t", "_lo", "_hi", width).groupBy("mark").agg(F.count("*").alias("seen"))
    around = missed.select(*keys, "mark", (F.col("mt") - run_s).alias("_lo"), (F.col("mt") + run_s).alias("_hi"))
    r = point_in_interval(runs, around, keys, "t0", "_lo", "_hi", width)
    order = F.struct("n", "seq0")
    per = r.groupBy("mark").agg(F.max("n").alias("longest"), F.max_by("reason", F.when(F.col("reason").isNotNull(), order)).alias("reason"))
    j = missed.select("mark").join(seen, "mark", "left").join(per, "mark", "left").na.fill(0, ["seen", "longest"])
    why = (F.when(F.col("seen") < few, "detector: barely seen").when(F.col("longest") <= tiny, "fragmented: many sightings, tiny runs")
           .otherwise(F.coalesce("reason", F.lit("no run built at all"))))
    return j.select("mark", "seen", "longest", why.alias("why"))


def footage_report(df: DataFrame, keys: Sequence[str], tracks: DataFrame | None = None, frame: str = "frame") -> DataFrame:
    """Detections per frame (empty frames count as zero), confidence, box size, and two verdicts."""
    k = list(keys)
    per = df.groupBy(*k, frame).agg(F.count("*").alias("_c"))
    f = per.groupBy(*k).agg((F.max(frame) - F.min(frame) + 1).alias("frames"), F.count("*").alias("_seen"), F.max("_c").alias("max_per_frame"), F.sum("_c").alias("_n"))
    conf = df.groupBy(*k).agg(F.avg("conf").alias("mean_conf"))
    area = quantiles(df.withColumn("_a", F.col("w") * F.col("w") / 2500.0), k, "_a", {"median_area_pct": 0.5}).select(*k, "median_area_pct")
    out = f.join(conf, k).join(area, k)
    empty = 1 - F.col("_seen") / F.col("frames")
    return out.select(*k, "frames", (F.col("_n") / F.col("frames")).alias("mean_per_frame"), "max_per_frame", empty.alias("empty_share"), "mean_conf",
                      "median_area_pct", (empty <= 0.7).alias("enough_seen"), (F.col("median_area_pct") >= 0.05).alias("big_enough"))
