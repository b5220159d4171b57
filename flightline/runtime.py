"""Session helpers: time zone, and cutting lineage into the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC so that local timestamps map to one number of seconds."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a private folder only where none is named and all tasks run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="flightline-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (survives lost executors) and forget how it was made."""
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    return done.toDF(*done.columns)  # fresh column identities, so it may be joined with its own source


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables, inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"
