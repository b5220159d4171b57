"""Operators on the site (recording and hoop) dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class UnknownSite(LookupError):
    """A recording nobody has measured."""


def with_sites(df: DataFrame, sites: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the dimension; a key it lacks makes the job fail instead of dropping or defaulting rows."""
    known = sites.withColumn("_known", F.lit(True))
    joined = df.join(known, list(keys), "left")
    label = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    guard = F.when(F.col("_known"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("no measured site for "), label)).cast("boolean"))
    return joined.filter(guard).drop("_known")


def require_sites(df: DataFrame, sites: DataFrame, keys: Sequence[str]) -> None:
    """The same check up front, naming some of the missing keys."""
    missing = df.select(*keys).distinct().join(sites, list(keys), "left_anti").limit(10).collect()
    if missing:
        raise UnknownSite(f"no measured site for {[tuple(m) for m in missing]}")


def override_pair(df: DataFrame, overrides: DataFrame, keys: Sequence[str], stored: Sequence[str],
                  given: Sequence[str]) -> DataFrame:
    """Take the override's values when it has them all, else the stored ones."""
    joined = df.join(overrides.select(*keys, *given), list(keys), "left")
    full = F.lit(True)
    for g in given:
        full = full & F.col(g).isNotNull()
    return joined.withColumns({s: F.when(full, F.col(g)).otherwise(F.col(s)) for s, g in zip(stored, given)}).drop(*given)


def orientation(ask: DataFrame, widths: DataFrame, keys: Sequence[str], site: str, width: str) -> DataFrame:
    """+1 for the widest (nearest) site of a recording, -1 for the others, 0 for an unknown site."""
    best = widths.groupBy(*keys).agg(F.min_by(site, F.struct((-F.col(width)).alias("w"), site)).alias("_best"))
    known = widths.join(best, list(keys)).select(*keys, site, F.when(F.col(site) == F.col("_best"), 1).otherwise(-1).alias("_o"))
    return ask.join(known, [*keys, site], "left").select(*keys, site, F.coalesce("_o", F.lit(0)).alias("orientation"))


def direction_families(edges: DataFrame, keys: Sequence[str], angle: str, length: str, order: Sequence[str]) -> DataFrame:
    """Add ``along``: within 35 degrees (circular) of the longest edge's direction."""
    longest = edges.groupBy(*keys).agg(
        F.min_by(angle, F.struct((-F.col(length)).alias("l"), *order)).alias("_base"))
    gap = F.abs(F.col(angle) - F.col("_base"))
    return edges.join(longest, list(keys)).withColumn("along", F.least(gap, F.lit(180.0) - gap) < 35.0).drop("_base")
