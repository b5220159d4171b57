"""The driver tables seen as detections, labels and boxes, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightline.operators.blocks import Series

HOUR, DAY = 3600.0, 86400.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """events as sightings: video = user, site = event type."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("user_id").alias("video"), F.col("event_type").alias("site"), F.col("event_id").alias("seq"),
        seconds("ts").alias("t"), F.floor(seconds("ts") / HOUR).alias("frame"),
        ((F.col("event_id") * 37) % 500).cast("double").alias("x"), F.col("value").alias("y"),
        (F.col("user_id") % 7 + 10).cast("double").alias("w"), ((F.col("event_id") % 100) / F.lit(100.0)).alias("conf"))


DET = """det AS (SELECT user_id AS video, event_type AS site, event_id AS seq, epoch_us(ts)/1e6 AS t,
  CAST(floor(epoch_us(ts)/1e6/3600.0) AS BIGINT) AS frame, CAST((event_id*37)%500 AS DOUBLE) AS x, value AS y,
  CAST(user_id%7+10 AS DOUBLE) AS w, (event_id%100)/CAST(100.0 AS DOUBLE) AS conf FROM events)"""

# a site's rim, in closed form so that the SQL twin needs no extra table
RIM = {"x1": "30.0D * length(site)", "x2": "30.0D * length(site) + 60.0D", "y1": "20.0D", "y2": "50.0D"}
RIM_SQL = ("CAST(30.0*length(site) AS DOUBLE) AS x1, CAST(30.0*length(site)+60.0 AS DOUBLE) AS x2, "
           "CAST(20.0 AS DOUBLE) AS y1, CAST(50.0 AS DOUBLE) AS y2")


def with_rim(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.expr(v) for k, v in RIM.items()})


def by_video(width: float = 7 * DAY) -> Series:
    return Series(("video",), "t", "seq", width)


def by_site(width: float = 7 * DAY) -> Series:
    return Series(("video", "site"), "t", "seq", width)


def marks(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases as hand-made marks; every eleventh names no hoop."""
    e = table(spark, folder, "events").filter(F.col("event_type") == "purchase")
    return e.select(F.col("user_id").alias("video"), F.col("event_id").alias("mark"), seconds("ts").alias("mt"),
                    F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 2).alias("mhoop"),
                    F.when(F.col("value") > 40, "make").otherwise("miss").alias("outcome"))


MARKS = """marks AS (SELECT user_id AS video, event_id AS mark, epoch_us(ts)/1e6 AS mt,
  CASE WHEN event_id%11<>0 THEN event_id%2 END AS mhoop, CASE WHEN value>40 THEN 'make' ELSE 'miss' END AS outcome
  FROM events WHERE event_type='purchase')"""


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks as machine-made calls; every thirteenth names no hoop."""
    e = table(spark, folder, "events").filter(F.col("event_type") == "click")
    return e.select(F.col("user_id").alias("video"), F.col("event_id").alias("call"), seconds("ts").alias("ct"),
                    F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 2).alias("choop"),
                    F.col("value").alias("fall"))


CALLS = """calls AS (SELECT user_id AS video, event_id AS call, epoch_us(ts)/1e6 AS ct,
  CASE WHEN event_id%13<>0 THEN event_id%2 END AS choop, value AS fall FROM events WHERE event_type='click')"""


def points(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as points and boxes in a plane of about 50 by 100."""
    li = table(spark, folder, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("video"), F.col("l_returnflag").alias("site"), F.col("l_linestatus").alias("kind"),
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / F.lit(1000.0)).alias("y"),
        (F.col("l_discount") * F.lit(100.0) + F.lit(2.0)).alias("w"),
        (F.col("l_tax") * F.lit(100.0) + F.lit(3.0)).alias("h"), (F.lit(1.0) - F.col("l_discount")).alias("conf"))


PTS = """pts AS (SELECT l_orderkey AS frame, l_linenumber AS line, l_partkey AS part, l_suppkey AS video,
  l_returnflag AS site, l_linestatus AS kind, l_quantity AS x, l_extendedprice/CAST(1000.0 AS DOUBLE) AS y,
  l_discount*CAST(100.0 AS DOUBLE)+CAST(2.0 AS DOUBLE) AS w, l_tax*CAST(100.0 AS DOUBLE)+CAST(3.0 AS DOUBLE) AS h,
  CAST(1.0 AS DOUBLE)-l_discount AS conf FROM lineitem)"""


def d(x: float) -> Column:
    return F.lit(float(x))


def r(c: Column, places: int = 6) -> Column:
    """Round half away from zero on the binary value, the way most SQL engines do it for doubles."""
    m = F.lit(float(10**places))
    return F.signum(c) * (F.floor(F.abs(c) * m + 0.5) / m)
