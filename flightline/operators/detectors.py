"""Comparing detector runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.operators.blocks import whole_blocks
from flightline.operators.quantiles import UPPER_MEDIAN, quantiles
from flightline.runtime import cut


def nearest_unused(image: np.ndarray, px: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, bx: np.ndarray, by: np.ndarray, reach: float) -> np.ndarray:
    """Errors, in widths, of the labels that find a box: of every image the first label takes its nearest box, then the second the nearest left, and so on.

    Labels lie in order of ``image`` (numbers from 0) and turn, boxes in order of their image ``at``; of equally near boxes the first is taken.
    """
    n = int(max(image.max(initial=-1), at.max(initial=-1))) + 1
    boxes = np.bincount(at, minlength=n)
    begin = np.cumsum(boxes) - boxes
    labels = np.bincount(image, minlength=n)
    turn = np.arange(len(image)) - (np.cumsum(labels) - labels)[image]
    used, errors = np.zeros(len(at), bool), [np.zeros(0)]
    for k in range(int(turn.max(initial=-1)) + 1):
        mine = np.flatnonzero((turn == k) & (boxes[image] > 0))
        if not len(mine):
            continue
        count = boxes[image[mine]]
        ends = np.cumsum(count)
        label = np.repeat(np.arange(len(mine)), count)
        box = np.arange(len(label)) - np.repeat(ends - count, count) + begin[image[mine]][label]
        far = np.sqrt((bx[box] - px[mine][label]) ** 2 + (by[box] - y[mine][label]) ** 2) / np.fmax(w[mine], 0.01)[label]
        far[used[box] | np.isnan(far)] = np.inf  # without a place neither is near
        least = np.minimum.reduceat(far, ends - count)
        hit = np.flatnonzero((far == least[label]) & (far <= reach))
        hit = hit[np.concatenate([[True], label[hit][1:] != label[hit][:-1]])] if len(hit) else hit
        used[box[hit]] = True
        errors.append(far[hit])
    return np.concatenate(errors)


def recall_at(labels: DataFrame, boxes: DataFrame, image: str, order: Sequence[str], confs: Sequence[float],
              reach: float) -> DataFrame:
    """Per confidence floor: labels found, labels, unclaimed boxes and the median centre error in widths.

    Labels in order each take the nearest unused box within ``reach`` widths.  Images are independent and hold
    a detector's output for one picture, so images stream through tasks, many in each batch of arrays.  Boxes of images without labels don't count.
    """
    sides = [(labels, F.lit(0), F.col("w"), F.lit(None)), (boxes.filter(F.col(image).isNotNull()), F.lit(1), F.lit(None), F.col("conf"))]
    both = [d.select(F.col(image).alias("_image"), side.alias("_side"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col("x").cast("double").alias("px"),
                     F.col("y").cast("double").alias("y"), w.cast("double").alias("w"), conf.cast("double").alias("conf")) for d, side, w, conf in sides]
    turns = ["_image", "_side", *[f"_o{i}" for i in range(len(order))], "px", "y", "w", "conf"]
    rows = both[0].unionByName(both[1]).repartition("_image").sortWithinPartitions(*turns).select("_image", "_side", "px", "y", "w", "conf")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, cuts in whole_blocks(batches, ["_image"]):
            number = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            px, y, w, conf = (frame[c].to_numpy(dtype=float) for c in ("px", "y", "w", "conf"))
            label = frame["_side"].to_numpy() == 0
            told = np.bincount(number[label], minlength=len(cuts) - 1) > 0
            for c in confs:
                box = ~label & (conf >= c) & told[number]
                errors = nearest_unused(number[label], px[label], y[label], w[label], number[box], px[box], y[box], reach)
                e, times = np.unique(errors, return_counts=True)
                none = np.zeros_like(times)  # one row more, without an error, tells the labels and boxes
                yield pd.DataFrame({"conf": float(c), "e": np.append(e, np.nan), "n": np.append(times, 0), "labels": np.append(none, label.sum()), "boxes": np.append(none, box.sum())})

    made = rows.mapInPandas(run, "conf double, e double, n long, labels long, boxes long")
    made = cut(made.groupBy("conf", "e").agg(*[F.sum(c).alias(c) for c in ("n", "labels", "boxes")]))  # read several times below
    totals = made.groupBy("conf").agg(F.sum("n").alias("hits"), F.sum("labels").alias("labels"), (F.sum("boxes") - F.sum("n")).alias("false_boxes"))
    med = quantiles(made.filter("e IS NOT NULL"), ["conf"], "e", {"median_error": UPPER_MEDIAN}, times="n").select("conf", "median_error")
    return totals.join(med, "conf", "left")


def compare_runs(before: DataFrame, after: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Sightings and time span gained per key, with the overall percentage beside each row."""
    def one(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(f"{tag}_n"), (F.max(t) - F.min(t)).alias(f"{tag}_s"))

    j = one(before, "before").join(one(after, "after"), list(keys), "full").na.fill(0)
    tot = j.agg(F.sum("before_n").alias("_b"), F.sum("after_n").alias("_a"))
    j = j.withColumns({"_b": tot.select("_b").scalar(), "_a": tot.select("_a").scalar()})
    return j.select(*keys, "before_n", "after_n", (F.col("after_n") - F.col("before_n")).alias("gained"),
                    (F.col("after_s") - F.col("before_s")).alias("span_gained"),
                    (F.lit(100.0) * (F.col("_a") - F.col("_b")) / F.greatest(F.lit(1), F.col("_b"))).alias("total_pct"))


