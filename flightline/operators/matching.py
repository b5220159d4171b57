"""Pairing calls with marks.  Four rules, because they give different scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightline.operators.blocks import Series, islands, running, scan_blocks
from flightline.operators.joins import nearest_any, point_in_interval
from flightline.runtime import cut


def candidate_pairs(marks: DataFrame, calls: DataFrame, keys: Sequence[str], tol: float) -> DataFrame:
    """Mark/call pairs at most ``tol`` apart whose hoops agree or are not both known; adds ``dt``."""
    spans = marks.withColumns({"_lo": F.col("mt") - tol, "_hi": F.col("mt") + tol})
    near = point_in_interval(calls, spans, keys, "ct", "_lo", "_hi", max(tol, 1e-9)).drop("_lo", "_hi")
    agree = F.col("mhoop").isNull() | F.col("choop").isNull() | (F.col("mhoop") == F.col("choop"))
    return near.filter(agree).withColumn("dt", F.abs(F.col("ct") - F.col("mt")))


def greedy_pairs(pairs: DataFrame, left: Sequence[str], right: Sequence[str], rank: Sequence[Column]) -> DataFrame:
    """Best-first one-to-one choice under a strict total order ``rank`` (smallest first).

    A pair that is the best of both its ends is certainly chosen, so whole rounds of such pairs are taken at
    once; the result equals sorting all pairs and walking down the list.  Each round is two map-side-combined
    aggregations, so no mark, call or group has to fit in one task.
    """
    ranked = cut(pairs.withColumn("_rank", F.struct(*rank)))
    chosen = None
    while not ranked.isEmpty():
        by_left = ranked.groupBy(*left).agg(F.min("_rank").alias("_bl"))
        by_right = ranked.groupBy(*right).agg(F.min("_rank").alias("_br"))
        best = (ranked.join(by_left, list(left)).join(by_right, list(right))
                .filter((F.col("_rank") == F.col("_bl")) & (F.col("_rank") == F.col("_br"))).drop("_bl", "_br"))
        best = cut(best)
        chosen = best if chosen is None else chosen.unionByName(best)
        ranked = cut(ranked.join(best.select(*left), list(left), "left_anti")
                     .join(best.select(*right), list(right), "left_anti"))
    return (chosen if chosen is not None else ranked).drop("_rank")


WALK = 50_000  # pairs of one part of the candidate graph that a task walks through; a larger part goes in rounds


def walked(pairs: DataFrame, part: Sequence[str], n: int, left: Sequence[str], right: Sequence[str], rank: Sequence[Column], walk: int = WALK) -> DataFrame:
    """The choice of :func:`greedy_pairs` for ``n`` pairs whose parts share no end: parts are dealt out and a task chooses for those it gets."""
    columns, by = pairs.columns, [f"_r{i}" for i in range(len(rank))]
    left, right = list(left), list(right)

    def chosen(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(by, ignore_index=True)
        a, b = (rows.groupby(c, sort=False, dropna=False).ngroup().to_numpy() for c in (left, right))
        live, kept = np.arange(len(rows)), []
        first, second = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        while len(live):
            # written from the last pair to the first, so that each end's best pair stays
            first[a[live][::-1]] = live[::-1]
            second[b[live][::-1]] = live[::-1]
            best = live[(first[a[live]] == live) & (second[b[live]] == live)]
            kept.append(best)
            first[a[best]], second[b[best]] = -1, -1
            live = live[(first[a[live]] >= 0) & (second[b[live]] >= 0)]
        return rows.iloc[np.sort(np.concatenate(kept))][columns] if kept else rows[columns]

    groups = -(-n // max(1, walk // 4))  # so that parts dealt out by hash come to about a quarter of ``walk`` pairs in each group
    dealt = pairs.withColumns({"_group": F.pmod(F.xxhash64(*part), F.lit(max(1, groups))), **dict(zip(by, rank))}).select(*columns, "_group", *by)
    return dealt.groupBy("_group").applyInPandas(chosen, pairs.schema)


def greedy_in_groups(pairs: DataFrame, keys: Sequence[str], left: Sequence[str], right: Sequence[str], rank: Sequence[Column], walk: int = WALK) -> DataFrame:
    """:func:`greedy_pairs` for pairs whose ends belong to one group of ``keys`` each: groups of up to ``walk`` pairs are dealt out, larger ones go in rounds."""
    left, right = list(dict.fromkeys([*keys, *left])), list(dict.fromkeys([*keys, *right]))
    pairs = cut(pairs)
    sizes = pairs.groupBy(*keys).agg(F.count("*").alias("_n"))
    held = sizes.agg(F.max("_n").alias("longest"), F.sum("_n").alias("all")).first()
    n = held["all"] or 0
    if (held["longest"] or 0) <= walk:
        return walked(pairs, keys, n, left, right, rank, walk)
    large = sizes.filter(F.col("_n") > walk).select(*keys)
    return walked(pairs.join(large, list(keys), "left_anti"), keys, n, left, right, rank, walk).unionByName(
        greedy_pairs(pairs.join(large, list(keys), "left_semi").select(*pairs.columns), left, right, rank).select(*pairs.columns))


def greedy_in_parts(pairs: DataFrame, s: Series, left: Sequence[str], right: Sequence[str], rank: Sequence[Column], end: Column, walk: int = WALK) -> DataFrame:
    """:func:`greedy_pairs` in a fixed number of steps for pairs that lie in time: each covers ``s.time`` to ``end``.

    Pairs that share an end overlap, so where no pair covers a moment the candidate graph falls apart, and the parts can be chosen from one by one.  Parts of
    up to ``walk`` pairs are dealt out and a task walks down the sorted list of those it gets.  Where no key has more pairs than that, the keys are the parts;
    else one round takes the pairs that are best for both ends first, which leaves few.  The result is that of one walk down the list of all pairs of a key.
    """
    columns, keys = pairs.columns, list(s.keys)
    left, right = list(dict.fromkeys([*keys, *left])), list(dict.fromkeys([*keys, *right]))
    pairs = cut(pairs)
    held = pairs.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n").alias("longest"), F.sum("_n").alias("all")).first()
    if (held["longest"] or 0) <= walk:
        return walked(pairs, keys, held["all"] or 0, left, right, rank, walk)
    ranked = pairs.withColumn("_rank", F.struct(*rank))
    by_left, by_right = ranked.groupBy(*left).agg(F.min("_rank").alias("_bl")), ranked.groupBy(*right).agg(F.min("_rank").alias("_br"))
    first = cut(ranked.join(by_left, list(left)).join(by_right, list(right)).filter((F.col("_rank") == F.col("_bl")) & (F.col("_rank") == F.col("_br"))).select(*columns))
    rest = ranked.join(first.select(*left), list(left), "left_anti").join(first.select(*right), list(right), "left_anti").drop("_rank")
    rest = running(rest.withColumn("_end", end), s, {"_reach": ("max", F.col("_end"))}, inclusive=False)
    parts = islands(rest, s, F.col("_reach").isNull() | (F.col(s.time) > F.col("_reach")), "_part").select(*columns, "_part")
    sizes = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    parts = cut(parts.join(sizes, [*keys, "_part"]))
    small, large = parts.filter(F.col("_n") <= walk), parts.filter(F.col("_n") > walk)
    return first.unionByName(walked(small.select(*columns, "_part"), [*keys, "_part"], small.count(), left, right, rank, walk).drop("_part")).unionByName(greedy_pairs(large.select(*columns), left, right, rank))


def match_events(marks: DataFrame, calls: DataFrame, keys: Sequence[str], tol: float, mark_first: bool = True) -> DataFrame:
    """Globally nearest-first matching; ties by (mark, call) or, for the gate fits, by (call, mark)."""
    pairs = candidate_pairs(marks, calls, keys, tol)
    pairs = pairs.select(*keys, "mark", "call", "dt", F.least("mt", "ct").alias("_from"), F.greatest("mt", "ct").alias("_to"), F.struct("mark", "call").alias("_pair"))
    ids = [F.col("mark"), F.col("call")] if mark_first else [F.col("call"), F.col("mark")]
    s = Series(tuple(keys), "_from", "_pair", 256 * max(tol, 1e-9))
    return greedy_in_parts(pairs, s, ["mark"], ["call"], [F.col("dt"), *ids], F.col("_to")).select(*keys, "mark", "call", "dt")


def in_order(marks: DataFrame, calls: DataFrame, keys: Sequence[str], tol: float, nearest: bool, use_hoop: bool,
             width: float) -> DataFrame:
    """Marks in time order each take one unused call: the first within ``tol``, or the nearest when ``nearest``.

    With ``use_hoop`` a call that names a hoop fits only marks that name the same one; a call that names none fits all.
    A mark is laid into the stream ``tol`` late, when every call it may take has gone by; the state is the short
    list of calls not taken yet.
    """
    a = calls.select(*keys, F.col("ct").alias("at"), F.lit(0).alias("kind"), F.col("call").alias("id"), F.col("ct").alias("t"),
                     F.coalesce(F.col("choop").cast("long"), F.lit(-1)).alias("hoop"))
    b = marks.select(*keys, (F.col("mt") + tol).alias("at"), F.lit(1).alias("kind"), F.col("mark").alias("id"), F.col("mt").alias("t"),
                     F.coalesce(F.col("mhoop").cast("long"), F.lit(-1)).alias("hoop"))
    s = Series(tuple(keys), "at", "q", width)
    # at one moment calls before marks, then by id, as one sortable text; ids are shifted so that none is negative
    shifted = (F.col("id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")
    stream = a.unionByName(b).na.drop(subset=list(keys)).withColumn("q", F.concat(F.col("kind").cast("string"), F.lpad(shifted, 20, "0")))

    def step(rows, state):
        free = state or []
        got = []
        for kind, i, t, hoop in zip(*[rows[c].tolist() for c in ("kind", "id", "t", "hoop")]):
            if kind == 0:
                free.append([i, t, hoop])
                continue
            best = None
            for c in free:
                dt = abs(c[1] - t)
                if dt > tol or (use_hoop and c[2] >= 0 and c[2] != hoop):
                    continue
                if best is None or (nearest and dt < best[0]):
                    best = (dt, c)
                    if not nearest:
                        break
            if best is not None:
                free.remove(best[1])
                got.append((i, best[1][0], best[0]))
            free = [c for c in free if c[1] >= t - 2 * tol]
        end = float(rows["at"][-1]) - 2 * tol
        found = dict(zip(("mark", "call", "dt"), zip(*got))) if got else {}
        return ([0] * len(got), found), [c for c in free if c[1] >= end]

    return scan_blocks(stream, s, step, "mark long, call long, dt double", arrays=True)


def nearest_mark(calls: DataFrame, marks: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Each call with its nearest mark whether or not another call has it too."""
    left = calls.select(*keys, F.col("ct").alias("t"), F.col("call").alias("id"), "fall")
    right = marks.select(*keys, F.col("mt").alias("t"), F.col("mark").alias("id"), F.col("mark"))
    out = nearest_any(left, right, keys, "t", "id", ["mark"], width)
    return out.select(*keys, F.col("id").alias("call"), F.col("hit.mark").alias("mark"), "dt", "fall", F.col("t").alias("ct"))


def covered(marks: DataFrame, windows: DataFrame, keys: Sequence[str], slack: float, width: float, how: str = "left_semi") -> DataFrame:
    """Marks inside any scanned window [lo, hi], give or take ``slack``; ``left_anti`` for those outside."""
    spans = windows.select(*keys, (F.col("lo") - slack).alias("_lo"), (F.col("hi") + slack).alias("_hi"))
    return point_in_interval(marks, spans, keys, "mt", "_lo", "_hi", width, how)


def box_agreement(a: DataFrame, b: DataFrame, frame: str, tol: float) -> DataFrame:
    """Per frame the share of A boxes with a B box whose corners all differ by at most ``tol``, and the reverse."""
    corner = ["x1", "y1", "x2", "y2"]
    pairs = a.select(frame, "aid", *[F.col(c).alias(f"a{c}") for c in corner]).join(
        b.select(frame, "bid", *[F.col(c).alias(f"b{c}") for c in corner]), frame)
    close = F.greatest(*[F.abs(F.col(f"a{c}") - F.col(f"b{c}")) for c in corner]) <= tol
    hits = pairs.filter(close)
    na, nb = (d.groupBy(frame).agg(F.count("*").alias(n)) for d, n in ((a, "na"), (b, "nb")))
    ha = hits.groupBy(frame).agg(F.count_distinct("aid").alias("ha"), F.count_distinct("bid").alias("hb"))
    out = na.join(nb, frame, "full").join(ha, frame, "left")
    share = lambda h, n: F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(1.0)).otherwise(F.coalesce(h, F.lit(0)) / n)
    return out.select(frame, share(F.col("ha"), F.col("na")).alias("a_in_b"), share(F.col("hb"), F.col("nb")).alias("b_in_a"))
