"""How long the ball was in the air."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.operators.joins import point_in_interval
from flightline.runtime import cut


def air_windows(descents: DataFrame, releases: DataFrame, hits: DataFrame, keys: Sequence[str], release_keys: Sequence[str], lead: float, tail: float,
                grace: float, longest: float) -> DataFrame:
    """From the known release (else the flight's first sighting) to the flight's last sighting near the descent's end.

    A release that is not before the descent is refused; anything longer than ``longest`` keeps its end.
    """
    d = cut(descents.select(*keys, "run_id", "t0", "t1"))
    spans = d.withColumns({"_lo": F.col("t0") - lead, "_hi": F.col("t0") - 1e-6})
    known = point_in_interval(releases, spans, release_keys, "rt", "_lo", "_hi", lead).groupBy(*keys, "run_id").agg(F.max("rt").alias("release"))
    around = d.withColumns({"_lo": F.col("t0") - lead, "_hi": F.col("t1") + tail})
    near = point_in_interval(hits, around, keys, "t", "_lo", "_hi", lead)
    flight = near.groupBy(*keys, "run_id").agg(F.min("t").alias("first"), F.max(F.when(F.col("t") <= F.col("t1") + grace, F.col("t"))).alias("last"))
    j = d.join(flight, [*keys, "run_id"]).join(known, [*keys, "run_id"], "left")
    start, stop = F.coalesce("release", "first"), F.greatest("t1", "last")
    return j.select(*keys, "run_id", F.greatest(start, stop - longest).alias("air0"), stop.alias("air1"), F.col("release").isNotNull().alias("known"),
                    (stop - start > longest).alias("capped"))
