"""CSV labels and written tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightline.functions.clock import parse_clock

JUDGED = "clip int, time string, hoop string, outcome string, durationS double, detections int, notes string"
CALLED = "time string, video string, hoop string, outcome string, source string, notes string"


def read_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Labels with ``#`` comment lines and an ``m:ss`` column; adds ``t`` in seconds."""
    return spark.read.schema(schema).csv(path, header=True, comment="#").withColumn("t", parse_clock(F.col("time")))


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace only the partitions (recordings) that ``df`` holds rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_missing(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append only the rows whose key the table does not hold yet."""
    spark = df.sparkSession
    have = spark.read.parquet(path).select(*keys)
    df.dropDuplicates(list(keys)).join(have, list(keys), "left_anti").write.mode("append").parquet(path)
