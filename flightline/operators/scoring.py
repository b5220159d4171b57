"""Score tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightline.operators.blocks import Series, running
from flightline.operators.sweeps import counts_from


def one(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def retention(df: DataFrame, real: str, fields: Mapping[str, Sequence[float]]) -> DataFrame:
    """Real and false rows kept at each threshold of several fields: no-op thresholds left out, ending at no false rows."""
    parts = []
    for name, thresholds in fields.items():
        counts = {"kept_real": one(F.col(real)), "kept_false": one(~F.col(real))}
        parts.append(counts_from(df, F.col(name), thresholds, counts).select(F.lit(name).alias("field"), "threshold", *counts))
    rows = reduce(DataFrame.unionByName, parts)
    total = df.agg(F.sum(one(F.col(real))).alias("_r"), F.sum(one(~F.col(real))).alias("_f"))
    rows = rows.withColumns({"_r": total.select("_r").scalar(), "_f": total.select("_f").scalar()})
    rows = rows.filter((F.col("kept_real") != F.col("_r")) | (F.col("kept_false") != F.col("_f")))
    past = Window.partitionBy("field").orderBy("threshold").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_z", F.coalesce(F.sum(one(F.col("kept_false") == 0)).over(past), F.lit(0)))
    return rows.filter("_z = 0").select("field", "threshold", "kept_real", "kept_false")


def rank_auc(df: DataFrame, score: str, positive: Column, bins: float, keys: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve with mid-ranks for ties, from counts per distinct score.

    Distinct scores are walked in order through value blocks ``bins`` wide, so no task sorts everything.
    """
    k = list(keys) or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(1))
    per = base.groupBy(*k, F.col(score).alias("_s")).agg(F.sum(one(positive)).alias("_p"), F.sum(one(~positive)).alias("_n"))
    s = Series(tuple(k), "_s", "_s", bins, "_vb")
    per = running(per, s, {"_below": ("sum", F.col("_n"))}, inclusive=False)
    below = F.coalesce("_below", F.lit(0))
    agg = per.groupBy(*k).agg(F.sum(F.col("_p") * (below + F.col("_n") / 2)).alias("_u"), F.sum("_p").alias("positives"),
                              F.sum("_n").alias("negatives"))
    return agg.select(*keys, "positives", "negatives",
                      (F.col("_u") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0))).alias("auc"))
