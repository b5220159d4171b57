"""Scan files: one JSON object per scanned window, ``hits`` mapping a hoop to its list of sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HIT = "struct<frame:bigint,t:double,x:double,y:double,conf:double,w:double>"
SCAN = f"video string, window_s array<double>, conf double, hits map<string,array<{HIT}>>"
FLAT = "video string, site string, frame bigint, t double, x double, y double, conf double, w double"


def read_scans(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One row per sighting.  ``multi_line`` reads pretty-printed files, one scan each."""
    raw = spark.read.schema(SCAN).json(path, multiLine=multi_line)
    per_site = raw.select("video", F.explode("hits").alias("site", "_h"))
    return per_site.select("video", "site", F.inline("_h"))


def write_scans(hits: DataFrame, path: str, window_s: float, mode: str = "errorifexists") -> None:
    """Write sightings as scan lines, one per recording and time window so that no line grows without bound."""
    hit = F.struct("frame", F.round("t", 2).alias("t"), F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), F.round("conf", 3).alias("conf"),
                   F.round("w", 1).alias("w"), )
    rows = hits.withColumn("_win", F.floor(F.col("t") / window_s))
    per_site = rows.groupBy("video", "_win", "site").agg(F.sort_array(F.collect_list(hit)).alias("h"))
    scans = per_site.groupBy("video", "_win").agg(F.map_from_entries(F.collect_list(F.struct("site", "h"))).alias("hits"))
    scans.select(F.col("video").cast("string").alias("video"), F.array(F.col("_win") * window_s, (F.col("_win") + 1) * window_s).alias("window_s"),
                 F.lit(0.05).alias("conf"), "hits").write.mode(mode).json(path)
