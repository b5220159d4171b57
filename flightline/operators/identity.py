"""Colours and who is who."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightline.functions import color
from flightline.operators.blocks import Series, islands, map_blocks, running
from flightline.operators.matching import greedy_pairs
from flightline.operators.quantiles import quantiles
from flightline.runtime import cut

MAX_REFS = 64


def calibrate(samples: DataFrame, name: Sequence[str]) -> DataFrame:
    """One reference per colour: circular mean hue, median saturation and value."""
    hue = samples.groupBy(*name).agg(color.circular_mean_hue(F.col("h")).alias("h"))
    s = quantiles(samples, name, "s", {"s": 0.5}).select(*name, "s")
    v = quantiles(samples, name, "v", {"v": 0.5}).select(*name, "v")
    return hue.join(s, list(name)).join(v, list(name))


def classify(obs: DataFrame, refs: DataFrame, name: str = "name") -> DataFrame:
    """Nearest reference and the margin to the runner-up.

    A palette is a handful of colours; its size is checked, and up to ``MAX_REFS`` become constants of one generated expression.  A larger one
    enters as one array; the results are the same.
    """
    palette = refs.select(name, "h", "s", "v").orderBy(name).limit(MAX_REFS + 1).collect()
    if len(palette) > MAX_REFS:
        return classify_by_array(obs, refs, name)
    if not palette:
        return obs.withColumns({"match": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    scored = [F.struct(color.color_distance(F.col("h"), F.col("s"), F.col("v"), F.lit(p["h"]), F.lit(p["s"]), F.lit(p["v"])).alias("d"),
                       F.lit(p[name]).alias("name")) for p in palette]
    if len(scored) == 1:
        return obs.withColumns({"match": scored[0]["name"], "confidence": F.lit(1.0)})
    rows = obs.withColumns({f"_r{i}": c for i, c in enumerate(scored)})
    cols = [F.col(f"_r{i}") for i in range(len(scored))]
    rows = rows.withColumn("_best", F.least(*cols))
    second = F.array_min(F.array(*[F.when(c != F.col("_best"), c["d"]) for c in cols]))
    return rows.withColumns({"match": F.col("_best.name"), "confidence": color.margin(F.col("_best.d"), second)}).drop(
        "_best", *[f"_r{i}" for i in range(len(scored))])


def classify_by_array(obs: DataFrame, refs: DataFrame, name: str = "name") -> DataFrame:
    """``classify`` for palettes of any size that fit into one row."""
    palette = refs.agg(F.collect_list(F.struct(F.col(name).alias("name"), "h", "s", "v")).alias("_p")).select("_p").scalar()
    distance = lambda p: F.struct(color.color_distance(F.col("h"), F.col("s"), F.col("v"), p["h"], p["s"], p["v"]).alias("d"), p["name"].alias("name"))
    rows = obs.withColumn("_p", palette).withColumn("_d", F.transform("_p", distance)).withColumn("_best", F.array_min("_d"))
    second = F.array_min(F.transform(F.filter("_d", lambda s: s != F.col("_best")), lambda s: s["d"]))
    return rows.withColumns({"match": F.col("_best.name"), "confidence": color.margin(F.col("_best.d"), second)}).drop("_p", "_d", "_best")


def hue_vote(df: DataFrame, keys: Sequence[str], hue: str, order: Sequence[str]) -> DataFrame:
    """The hue most samples agree on: biggest 30-degree band (the earlier on a tie), median inside it; -1 for white."""
    k = list(keys)
    rows = df.filter(F.col(hue).isNotNull()).withColumn("band", color.hue_band(F.col(hue)))
    n = rows.groupBy(*k, "band").agg(F.count("*").alias("votes"), F.min(F.struct(*order)).alias("_o"))
    top = n.groupBy(*k).agg(F.min_by(F.struct("band", "votes"), F.struct((-F.col("votes")).alias("v"), "_o")).alias("_b")).select(*k, "_b.*")
    med = quantiles(rows.join(top.select(*k, "band"), [*k, "band"], "left_semi"), k, hue, {"_m": 0.5}).select(*k, "_m")
    return top.join(med, k).select(*k, "band", "votes", F.when(F.col("band") < 0, F.lit(-1.0)).otherwise(F.col("_m")).alias("hue"))


def hue_histogram(df: DataFrame, keys: Sequence[str], hue: str, width: str, step: int) -> DataFrame:
    """Counts and median width per hue bin; strong bins hold at least max(3, 5 %)."""
    k = list(keys)
    rows = df.withColumn("bin", (F.floor(F.col(hue) / step) * step).cast("long"))
    n = rows.groupBy(*k).agg(F.count("*").alias("_n"))
    h = quantiles(rows, [*k, "bin"], width, {"median_w": 0.5})
    return h.join(n, k).select(*k, "bin", "n", "median_w", (F.col("n") >= F.greatest(F.lit(3.0), 0.05 * F.col("_n"))).alias("strong"))


def overlap_groups(df: DataFrame, s: Series, end: str, name: str = "overlap_group") -> DataFrame:
    """Transitive overlap (touching counts): a group starts where no earlier interval reaches."""
    rows = cut(running(df, s, {"_reach": ("max", F.col(end))}, inclusive=False))
    starts = F.col("_reach").isNull() | (F.col(s.time) > F.col("_reach"))
    return islands(rows, s, starts, name).drop("_reach")


def assign(tracklets: DataFrame, roster: DataFrame, group: Sequence[str], tid: str, min_score: float = 0.15) -> DataFrame:
    """Give each tracklet of an overlap group at most one player, each player at most one tracklet.

    ``tracklets``: group, tid, votes MAP<colour, weight>.  ``roster``: colour, player.  A lone tracklet and a lone
    player left over are put together at 0.5; the others stay unassigned.
    """
    g = list(group)
    votes = tracklets.select(*g, tid, F.explode("votes").alias("colour", "weight"))
    total = votes.groupBy(*g, tid).agg(F.sum("weight").alias("_w"))
    score = votes.join(roster, "colour").groupBy(*g, tid, "player").agg(F.sum("weight").alias("_s")).join(total, [*g, tid])
    pairs = score.filter(F.col("_w") > 0).select(*g, tid, "player", (F.col("_s") / F.col("_w")).alias("score")).filter(F.col("score") >= min_score)
    taken = cut(greedy_pairs(pairs, [*g, tid], [*g, "player"], [-F.col("score"), F.col(tid), F.col("player")]))
    left = cut(tracklets.select(*g, tid).join(taken.select(*g, tid), [*g, tid], "left_anti"))
    spare_t = left.groupBy(*g).agg(F.count("*").alias("_nt"), F.min(tid).alias("_t"))
    players = roster.select("player").distinct().agg(F.collect_set("player").alias("_all"))
    used = taken.groupBy(*g).agg(F.collect_set("player").alias("_used"))
    spare = spare_t.join(used, g, "left").withColumn("_all", players.scalar())
    free = F.array_except("_all", F.coalesce("_used", F.array().cast("array<string>")))
    last = spare.withColumn("_f", free).filter((F.col("_nt") == 1) & (F.size("_f") == 1)).select(*g, F.col("_t").alias(tid), F.get("_f", F.lit(0)).alias("player"))
    rest = left.join(last, [*g, tid], "left").select(*g, tid, "player", F.when(F.col("player").isNotNull(), 0.5).otherwise(0.0).alias("confidence"))
    return taken.select(*g, tid, "player", F.round("score", 3).alias("confidence")).unionByName(rest)


def known_colours(colour: Column, allowed: Column) -> Column:
    """Only colours present in the recording; an empty list allows all."""
    return (F.size(allowed) == 0) | F.array_contains(allowed, colour)


# how far a blob's kind is trusted as a cap (fixed values)
BLOB_WEIGHT = {"A": 1.0, "N": 0.75, "R": 0.55}


def best_blob(blobs: DataFrame, box: Sequence[str], order: Sequence[str], min_area: float, max_area: float, box_h: Column) -> DataFrame:
    """The most cap-like blob of each person box: right size, not too long, well filled, in the upper part."""
    w, h, a = F.col("w"), F.col("h"), F.col("area")
    long_side = F.greatest(w, h) / F.greatest(F.lit(1e-9), F.least(w, h))
    ok = a.between(min_area, max_area) & (long_side <= 2.8) & (a / (w * h) >= 0.45) & (F.col("cy") <= 0.75 * box_h)
    weight = F.lit(None).cast("double")
    for kind, v in BLOB_WEIGHT.items():
        weight = F.when(F.col("kind") == kind, F.lit(v)).otherwise(weight)
    rows = blobs.filter(ok).withColumn("score", a * weight)
    return rows.groupBy(*box).agg(F.min_by(F.struct("kind", "hue", "score"), F.struct((-F.col("score")).alias("s"), *order)).alias("_b")).select(*box, "_b.*")


def uncovered(caps: DataFrame, boxes: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Caps lying in no person box of their frame, with a body estimated from the cap."""
    a, b = caps.alias("a"), boxes.alias("b")
    on = F.lit(True)
    for f in frame:
        on = on & (F.col(f"a.{f}") == F.col(f"b.{f}"))
    on = on & F.col("a.x").between(F.col("b.x1"), F.col("b.x2")) & F.col("a.y").between(F.col("b.y1"), F.col("b.y2"))
    lone = a.join(b, on, "left_anti")
    w = F.col("w")
    return lone.withColumns({"bx1": F.col("x") - w * 1.2, "by1": F.col("y") - w * 0.6, "bx2": F.col("x") + w * 1.2, "by2": F.col("y") + w * 4.0})


def reading_above(df: DataFrame, keys: Sequence[str], hue: str, sat: str, water: float, least: int = 20) -> DataFrame:
    """Median hue of strongly coloured samples away from the water's hue; groups with under ``least`` samples drop out."""
    k = list(keys)
    p = quantiles(df, k, sat, {"_p92": 0.92}).select(*k, "_p92")
    gap = F.least(F.abs(F.col(hue) - water) % 180, 180 - F.abs(F.col(hue) - water) % 180)
    rows = df.join(p, k).filter((F.col(sat) >= F.greatest(F.col("_p92"), F.lit(90.0))) & (gap > 15))
    return quantiles(rows, k, hue, {"hue": 0.5}).filter(F.col("n") >= least).select(*k, "n", "hue")


def _pair_sums(df: DataFrame, same: bool, threshold: float | None, tile: int) -> DataFrame:
    """Sums over embedding pairs without ever writing a pair down: numpy multiplies one tile with another.

    ``same``: pairs of one identity at least two frames apart; else pairs of one frame with different identities.
    A key's rows are dealt by a hash of their id into tiles of about ``tile`` rows, however far its ids lie apart, so a vector is copied once for
    each tile of its key.  Keys of one tile stream by; the pairs of the others' tiles are dealt out.
    """
    import numpy as np
    import pandas as pd
    key, other = ("identity", "frame") if same else ("frame", "identity")
    sizes = df.groupBy(key).agg(F.ceil(F.count("*") / F.lit(tile)).alias("_tiles"))
    rows = df.select(key, other, "id", "vec").join(sizes, key)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def told(a, b, crossed: bool) -> tuple[int, float, float, int]:
        dots = np.stack(a["vec"]) @ np.stack(b["vec"]).T
        oa, ob = a[other][:, None], b[other][None, :]
        ok = (np.abs(ob - oa) >= 2) if same else (oa != ob)
        if not crossed:
            ok &= a["id"][:, None] < b["id"][None, :]
        v = dots[ok]
        return len(v), float(v.sum()), float((v * v).sum()), int((v > threshold).sum()) if threshold is not None else 0

    def within(block):
        return [0], {c: [v] for c, v in zip(("n", "s", "ss", "above"), told(block, block, False))}

    def between(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        got = told(*[{c: d[c].to_numpy() for c in ("id", other, "vec")} for d in (a, b)], a["_a"].iloc[0] != a["_b"].iloc[0])
        return pd.DataFrame([got], columns=["n", "s", "ss", "above"])

    alone = map_blocks(rows.filter("_tiles = 1").drop("_tiles"), [key], ["id"], within, "n long, s double, ss double, above long")
    dealt = rows.filter("_tiles > 1").withColumn("_t", F.pmod(F.xxhash64("id"), F.col("_tiles")))
    upto = dealt.withColumn("_b", F.explode(F.sequence("_t", F.col("_tiles") - 1))).withColumnRenamed("_t", "_a")
    down = dealt.withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), "_t"))).withColumnRenamed("_t", "_b")
    upto, down = upto.toDF(*upto.columns), down.toDF(*down.columns)  # two reads of one source: keep their columns apart
    parts = [key, "_a", "_b"]
    tiled = (upto.repartition(n, *parts).groupBy(*parts).cogroup(down.repartition(n, *parts).groupBy(*parts))
             .applyInPandas(lambda a, b: between(a, b) if len(a) and len(b) else pd.DataFrame(columns=["n", "s", "ss", "above"]), "n long, s double, ss double, above long"))
    return alone.unionByName(tiled).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("above").alias("above"))


def separability(df: DataFrame, tile: int = 1024) -> DataFrame:
    """How well appearance tells people apart: cosines of one identity over time against others in one frame.

    ``df``: id, identity, frame, vec (unit length).  Means and deviations come first; counting hits of the midpoint
    threshold is a second pass over the same tiles.
    """
    first = {}
    for name, same in (("same", True), ("diff", False)):
        row = _pair_sums(df, same, None, tile).first()
        n, mean = row["n"], row["s"] / row["n"]
        first[name] = (n, mean, max(row["ss"] / n - mean * mean, 0.0) ** 0.5)
    mid = (first["same"][1] + first["diff"][1]) / 2
    s = _pair_sums(df, True, mid, tile).select(F.col("above").alias("s_above"), F.lit(1).alias("_one"))
    d = _pair_sums(df, False, mid, tile).select((F.col("n") - F.col("above")).alias("d_below"), F.lit(1).alias("_one"))
    (ns, ms, ss), (nd, md, sd) = first["same"], first["diff"]
    pooled = ((ss * ss + sd * sd) / 2) ** 0.5
    return s.join(d, "_one").select(
        F.lit(ns).cast("long").alias("n_same"), F.lit(ms).alias("mean_same"), F.lit(ss).alias("sd_same"), F.lit(nd).cast("long").alias("n_diff"),
        F.lit(md).alias("mean_diff"), F.lit(sd).alias("sd_diff"), F.lit(ms - md).alias("gap"), F.lit((ms - md) / (pooled + 1e-9)).alias("gap_sd"),
        ((F.col("s_above") + F.col("d_below")) / F.lit(ns + nd)).alias("accuracy"))
