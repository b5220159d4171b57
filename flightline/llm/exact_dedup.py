"""Exact duplicates by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightline.llm.common import lower_ascii, stored

RUNS, FAN_IN = 256, 16


def merge_up(run: DataFrame, runs: int, fan_in: int) -> DataFrame:
    """Merge ``fan_in`` neighbouring runs at a time until one is left: (digest, n_bytes, keep_id, group_size).

    Runs are spread over all tasks by (run, digest), so a round moves short rows only and a digest that a third of the
    documents share is at most ``fan_in`` rows of a round.  A digest counts as the same only with the same length.
    """
    while runs > 1:
        runs = -(-runs // fan_in)
        run = (run.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).groupBy("run", "digest", "n_bytes")
               .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
               .sortWithinPartitions("run", "digest"))
    return run.drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; the largest id of equal texts stays.  Null text counts as empty, empty
    texts equal each other.  A null id is smaller than any other; if all ids of a group are null, one row stays and ``keep_id`` is null.
    Rows that repeat both id and text count singly in ``group_size`` and one of them stays.  Other columns are not read.
    """
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")).select(
        "doc_id", F.sha2(F.col("_t").cast("binary"), 256).alias("digest"), F.octet_length("_t").alias("n_bytes"),
        F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run"))
    rows = stored(rows, "digests")
    run = (rows.groupBy("run", "digest", "n_bytes").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
           .sortWithinPartitions("run", "digest"))
    final = merge_up(run, runs, fan_in)
    # back down: a digest has a row in each run at most, so neither join meets a hot key
    told = run.select("run", "digest", "n_bytes").join(final, ["digest", "n_bytes"])
    again = Window.partitionBy("digest", "doc_id").orderBy("n_bytes")
    return (rows.withColumn("_again", F.row_number().over(again)).join(told, ["run", "digest", "n_bytes"])
            .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_again") == 1)).alias("kept"),
                    F.col("digest").alias("text_sha256")))


EXACT_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
