"""Range, nearest and as-of joins expressed as equi joins on time buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightline.operators.blocks import Series, running

BUCKET = "_bucket"


def point_in_interval(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, lo: str, hi: str,
                      width: float, how: str = "inner") -> DataFrame:
    """Pairs with equal ``keys`` and ``lo <= time <= hi``.

    A point sits in one bucket, a span is listed in each bucket it touches, so every pair meets exactly
    once and the shuffle key is (keys, bucket) rather than the possibly hot keys alone.  ``spans`` must not
    share column names with ``points`` other than ``keys``.  ``left_semi``/``left_anti`` keep points.
    """
    p = points.withColumn(BUCKET, F.floor(F.col(time) / F.lit(float(width))))
    # lo > hi is an empty span: sequence() would count backwards
    touched = F.when(F.col(lo) <= F.col(hi),
                     F.sequence(F.floor(F.col(lo) / F.lit(float(width))), F.floor(F.col(hi) / F.lit(float(width)))))
    q = spans.withColumn(BUCKET, F.explode(touched))
    same = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in [*keys, BUCKET]]
    on = [*same, F.col(f"p.{time}").between(F.col(f"q.{lo}"), F.col(f"q.{hi}"))]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = p.alias("p").join(q.alias("q"), cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop(BUCKET)
    extra = [F.col(f"q.{c}") for c in q.columns if c not in (*keys, BUCKET)]
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *extra)


def nearest_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: Sequence[str], lt: str, rt: str,
                   reach: float, order: Sequence[str], width: float | None = None) -> DataFrame:
    """For every left row the right row nearest in time, at most ``reach`` away; unmatched rows are absent.

    Ties go to the smallest ``order`` columns.  Adds ``dt``; the right columns keep their names.
    """
    spans = left.withColumns({"_lo": F.col(lt) - F.lit(reach), "_hi": F.col(lt) + F.lit(reach)})
    pairs = point_in_interval(right, spans, keys, rt, "_lo", "_hi", width or max(reach, 1e-9))
    pairs = pairs.withColumn("dt", F.abs(F.col(rt) - F.col(lt)))
    rank = F.struct(F.col("dt"), *[F.col(c) for c in order])
    keep = [c for c in right.columns if c not in keys and c not in left_id]
    best = pairs.groupBy(*left_id).agg(F.min_by(F.struct("dt", *keep), rank).alias("_b"))
    return best.select(*left_id, "_b.*")


def nearest_any(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, seq: str, payload: Sequence[str],
                width: float) -> DataFrame:
    """Nearest right row at any distance (the earlier one on a tie), by an as-of look both ways.

    Both sides carry ``keys``, ``time`` and an integer ``seq``.  Rows are laid out in one series; nothing is paired
    up, so the cost stays linear however dense a key is.  Adds ``hit`` (struct of ``time`` and payload) and ``dt``.
    """
    pay = F.struct(F.col(time).alias("at"), *[F.col(c) for c in payload])
    lcols = [c for c in left.columns if c not in (*keys, time, seq)]
    a = left.select(*keys, time, F.lit(1).alias("_side"), F.col(seq).alias("_q"), F.struct(seq, *lcols).alias("_l"),
                    F.lit(None).alias("_r"))
    b = right.select(*keys, time, F.lit(0).alias("_side"), F.col(seq).alias("_q"), F.lit(None).alias("_l"),
                     pay.alias("_r"))
    both = a.select(*keys, time, "_side", "_q", "_l", F.col("_r").cast(b.schema["_r"].dataType)).unionByName(
        b.select(*keys, time, "_side", "_q", F.col("_l").cast(a.schema["_l"].dataType), "_r"))
    # among right rows of one instant the smallest seq must come last, because "last" wins
    both = both.withColumns({"_o": F.struct(F.col("_side"), -F.col("_q")), "_nt": -F.col(time)})
    past = Series(tuple(keys), time, "_o", width, "_pb")
    ahead = Series(tuple(keys), "_nt", "_o", width, "_nb")
    both = running(both, past, {"_before": ("last", F.col("_r"))})
    both = running(both, ahead, {"_after": ("last", F.col("_r"))}).filter(F.col("_l").isNotNull())
    db, da = F.col(time) - F.col("_before.at"), F.col("_after.at") - F.col(time)
    use_before = F.col("_after").isNull() | (db <= da)
    return both.select(*keys, time, "_l.*", F.when(use_before, F.col("_before")).otherwise(F.col("_after")).alias("hit"),
                       F.when(use_before, db).otherwise(da).alias("dt"))


def greatest0(*cols: Column) -> Column:
    return F.greatest(*cols, F.lit(0.0))
