"""Where the ball came down around a labelled moment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.operators.joins import point_in_interval
from flightline.operators.quantiles import quantiles


def around(labels: DataFrame, hits: DataFrame, keys: Sequence[str], label_id: Sequence[str], t: str, before: float,
           after: float, width: float) -> DataFrame:
    """All sightings from ``before`` ahead of each label to ``after`` behind it."""
    spans = labels.select(*keys, *label_id, (F.col(t) - before).alias("_lo"), (F.col(t) + after).alias("_hi"))
    return point_in_interval(hits, spans, keys, "t", "_lo", "_hi", width)


def zone_hits(labels: DataFrame, inside: DataFrame, keys: Sequence[str], label_id: Sequence[str], t: str, before: float,
              after: float, width: float) -> DataFrame:
    """Add ``dropped``: was any sighting that lies in the zone seen around the label?  ``inside`` is filtered already."""
    found = around(labels, inside, keys, label_id, t, before, after, width).groupBy(*label_id).agg(F.lit(True).alias("_hit"))
    return labels.join(found, list(label_id), "left").withColumn("dropped", F.coalesce("_hit", F.lit(False))).drop("_hit")


def through_depth(labels: DataFrame, hits: DataFrame, keys: Sequence[str], label_id: Sequence[str], t: str, before: float,
                  after: float) -> DataFrame:
    """Deepest the ball's top got into the ellipse (0 never, 1 dead centre) and when; ``hits`` carry ``ratio``."""
    near = around(labels, hits.filter(F.col("ratio") < 1.0), keys, label_id, t, before, after, before + after)
    depth = F.lit(1.0) - F.sqrt("ratio")
    best = near.groupBy(*label_id).agg(F.min(F.struct((-depth).alias("d"), "t", "seq")).alias("_b"))
    return labels.join(best, list(label_id), "left").select(
        *label_id, F.coalesce(-F.col("_b.d"), F.lit(0.0)).alias("depth"), F.col("_b.t").alias("at"))


def landing_points(labels: DataFrame, hits: DataFrame, keys: Sequence[str], label_id: Sequence[str], t: str, before: float,
                   after: float, width: float) -> DataFrame:
    """The last sighting in each label's window, the one nearest the water."""
    near = around(labels, hits, keys, label_id, t, before, after, width)
    cols = [c for c in hits.columns if c not in label_id]
    last = near.groupBy(*label_id).agg(F.max_by(F.struct(*cols), F.struct("t", "seq")).alias("_p"))
    return last.select(*label_id, "_p.*")


def landing_summary(offsets: DataFrame, by: Sequence[str], axes: Mapping[str, str]) -> DataFrame:
    """Median and population deviation per group, then with the leading columns of ``by`` pooled one after the other under ``(all)``."""
    pooled = F.lit("(all)")
    levels = F.array(*[F.struct(*[(pooled if i < level else F.col(c)).alias(c) for i, c in enumerate(by)]) for level in range(len(by) + 1)])
    both = offsets.select(F.explode(levels).alias("_by"), *axes.values()).select("_by.*", *axes.values())
    sd = both.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.stddev_pop(c), 6).alias(f"{n}_sd") for n, c in axes.items()])
    for name, c in axes.items():
        med = quantiles(both, by, c, {"_m": 0.5}).select(*by, F.round("_m", 6).alias(f"{name}_med"))
        sd = sd.join(med, list(by))
    return sd
