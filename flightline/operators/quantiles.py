"""Exact interpolated quantiles of groups of any size.

``percentile``/``median`` keep all distinct values of a group in one buffer.  Here only counts are kept: values
are counted into equal-width bins, the bins holding the wanted ranks are found, and only those bins are sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024
UPPER_MEDIAN = "upper"  # the element at n // 2, which is not the median of an even count


def quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float | str], bins: int = BINS, times: str | None = None) -> DataFrame:
    """One row per group with linearly interpolated quantiles, e.g. ``{"med": 0.5}``, and the count ``n``.  ``times``: how often a row counts."""
    k = list(keys) or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(1))
    v = F.col(value).cast("double")
    counts = base.filter(v.isNotNull()).groupBy(*k, v.alias("_v")).agg((F.sum(times) if times else F.count("*")).alias("_c"))
    span = counts.groupBy(*k).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("n"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(
        (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    binned = counts.join(span, k).withColumn("_bin", place)
    upto = Window.partitionBy(*k).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = binned.groupBy(*k, "_bin").agg(F.sum("_c").alias("_bc"), F.first("n").alias("_n"))
    per_bin = per_bin.withColumn("_start", F.coalesce(F.sum("_bc").over(upto), F.lit(0)))
    ranks = {}
    for name, q in wanted.items():
        pos = F.floor(F.col("_n") / 2) * 1.0 if q == UPPER_MEDIAN else F.lit(float(q)) * (F.col("_n") - 1)
        ranks[name] = (F.floor(pos), F.ceil(pos), pos - F.floor(pos))
    holds = reduce(lambda a, b: a | b, [
        (r >= F.col("_start")) & (r < F.col("_start") + F.col("_bc")) for lo, hi, _ in ranks.values() for r in (lo, hi)])
    needed = per_bin.filter(holds).select(*k, "_bin", "_start", "_n")
    inside = Window.partitionBy(*k, "_bin").orderBy("_v")
    rows = binned.join(needed, [*k, "_bin"]).withColumn("_end", F.col("_start") + F.sum("_c").over(inside))
    at = lambda r: F.max(F.when((r < F.col("_end")) & (r >= F.col("_end") - F.col("_c")), F.col("_v")))
    picked = rows.groupBy(*k).agg(
        F.first("_n").alias("_n"), *[at(lo).alias(f"_a_{n}") for n, (lo, _, _) in ranks.items()],
        *[at(hi).alias(f"_b_{n}") for n, (_, hi, _) in ranks.items()])
    return picked.select(*keys, F.col("_n").alias("n"), *[
        (F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * frac).alias(n) for n, (_, _, frac) in ranks.items()])
