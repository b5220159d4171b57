"""Answer keys: JSON with shots, moments that are not shots, and the windows somebody watched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHOT = "struct<t:double,at:string,hoop:string,outcome:string,shooter_cap:string,shooter:string,dunk:boolean,blocked:boolean,note:string>"
NOT_SHOT = "struct<t:double,at:string,what:string,note:string>"
WINDOW = "struct<`from`:double,`to`:double,note:string>"
KEY = f"video string, covers array<double>, window array<double>, windows array<{WINDOW}>, shots array<{SHOT}>, not_shots array<{NOT_SHOT}>"


def read_keys(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marks, non_marks, coverage).  A key file may also be a bare list of shots."""
    text = spark.read.text(path, wholetext=multi_line).select("value", F.col("_metadata.file_path").alias("file"))
    bare = F.trim("value").startswith("[")
    shots = F.when(bare, F.from_json("value", f"array<{SHOT}>")).otherwise(F.from_json("value", KEY)["shots"])
    key = text.select("file", F.when(~bare, F.from_json("value", KEY)).alias("k"), shots.alias("shots"))
    key = key.withColumn("video", F.coalesce("k.video", "file"))
    marks = key.select("video", F.inline("shots")).withColumn("shooter_cap", F.coalesce("shooter_cap", "shooter")).drop("shooter")
    non_marks = key.select("video", F.inline("k.not_shots"))
    ends = F.concat(
        F.coalesce(F.transform("k.windows", lambda w: F.struct(w["from"].alias("lo"), w["to"].alias("hi"))), F.array().cast("array<struct<lo:double,hi:double>>")),
        *[F.when(F.size(c) >= 2, F.array(F.struct(F.get(c, F.lit(0)).alias("lo"), F.get(c, F.lit(1)).alias("hi")))).otherwise(
            F.array().cast("array<struct<lo:double,hi:double>>")) for c in ("k.covers", "k.window")])
    coverage = key.select("video", F.inline(ends))
    return marks, non_marks, coverage
