"""Parameter sweeps over counted rows: one pass over the data whatever the number of settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reached(value: Column, thresholds: Sequence[float], passes=lambda v, t: v >= t) -> Column:
    """How many of the ordered thresholds the value passes."""
    return reduce(lambda a, b: a + b, [F.when(passes(value, F.lit(float(t))), 1).otherwise(0) for t in thresholds])


def counts_from(df: DataFrame, value: Column, thresholds: Sequence[float], counts: Mapping[str, Column],
                keys: Sequence[str] = (), passes=lambda v, t: v >= t) -> DataFrame:
    """Sum each of ``counts`` over the rows passing each threshold (passing one must imply passing the earlier ones).

    Rows are first counted per number of thresholds passed, then that short table is unrolled.
    """
    per = df.groupBy(*keys, reached(value, thresholds, passes).alias("_k")).agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(thresholds)])
    rows = per.withColumn("_s", F.explode(steps))
    hit = F.col("_s.i") < F.col("_k")
    return rows.groupBy(*keys, F.col("_s.threshold").alias("threshold")).agg(
        *[F.sum(F.when(hit, F.col(n)).otherwise(0)).alias(n) for n in counts])


def grid_counts(df: DataFrame, a: Column, a_steps: Sequence[float], b: Column, b_steps: Sequence[float],
                counts: Mapping[str, Column], a_pass, b_pass, either: bool) -> DataFrame:
    """Two-threshold grid: sum over rows passing both, or either, of a and b."""
    per = df.groupBy(reached(a, a_steps, a_pass).alias("_i"), reached(b, b_steps, b_pass).alias("_j")).agg(
        *[F.sum(c).alias(n) for n, c in counts.items()])
    steps = lambda v: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("v")) for i, t in enumerate(v)])
    rows = per.withColumn("_a", F.explode(steps(a_steps))).withColumn("_b", F.explode(steps(b_steps)))
    pa, pb = F.col("_a.i") < F.col("_i"), F.col("_b.i") < F.col("_j")
    hit = pa | pb if either else pa & pb
    return rows.groupBy(F.col("_a.v").alias("a"), F.col("_b.v").alias("b")).agg(
        *[F.sum(F.when(hit, F.col(n)).otherwise(0)).alias(n) for n in counts])


def prf(tp: Column, fp: Column, total: Column) -> dict[str, Column]:
    """Recall, precision and F1 with the usual guards against empty denominators."""
    rec = F.when(total > 0, tp / total)
    prec = tp / F.greatest(F.lit(1), tp + fp)
    f1 = 2 * rec * prec / F.greatest(F.lit(1e-9), rec + prec)
    return {"recall": rec, "precision": prec, "f1": f1}


def flag_first_max(df: DataFrame, score: Column, order: Sequence[Column], name: str = "best") -> DataFrame:
    """Mark the row with the highest score, the first in ``order`` on a tie.  For short result tables."""
    w = Window.partitionBy(F.lit(1)).orderBy(score.desc(), *order)
    return df.withColumn(name, F.row_number().over(w) == 1)
