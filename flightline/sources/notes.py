"""Hand-written notes and file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# the words the notes use (fixed values)
HOOPS = ("left", "right")
MAKES = ("make", "made", "dunk")
MISSES = ("miss", "missed", "airball")
COLORS = ("red", "blue", "white", "green", "yellow", "black", "pink", "purple")


def parse_notes(lines: DataFrame, keys: Sequence[str], line: str, line_no: str) -> DataFrame:
    """``m:ss words`` lines to answer-key rows.  Lines of one time are merged and the last word given wins.

    Each line is reduced to its last hoop, outcome and colour before rows meet, so the shuffle carries one short
    row per line instead of one per word.
    """
    clock = r"^(\d{1,2}):(\d{2})"
    text = F.col(line)
    words = F.split(F.lower(F.regexp_replace(text, clock, "")), "[^a-z]+")
    rows = lines.filter(text.rlike(clock)).select(
        *keys, F.col(line_no).alias("_no"),
        (F.regexp_extract(text, clock, 1).cast("long") * 60 + F.regexp_extract(text, clock, 2).cast("long")).alias("t"),
        F.try_element_at(F.filter(words, lambda w: w.isin(*HOOPS)), F.lit(-1)).alias("hoop"),
        F.try_element_at(F.filter(words, lambda w: w.isin(*MAKES, *MISSES)), F.lit(-1)).alias("_o"),
        F.try_element_at(F.filter(words, lambda w: w.isin(*COLORS)), F.lit(-1)).alias("cap"),
        F.array_contains(words, "dunk").alias("dunk"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_no"))).alias(c)
    out = rows.groupBy(*keys, "t").agg(last("hoop"), last("_o"), last("cap"), F.bool_or("dunk").alias("dunk"))
    outcome = F.when(F.col("_o").isin(*MAKES), "make").when(F.col("_o").isNotNull(), "miss")
    return out.select(*keys, "t", "hoop", outcome.alias("outcome"), "cap", "dunk",
                      (F.col("hoop").isNotNull() & F.col("_o").isNotNull()).alias("complete"))


FILE_NAME = r"^pose-diag-(.+?)-(\d+)(-3pt)?\.jpg$"


def pivot_file_kinds(files: DataFrame, name: str) -> DataFrame:
    """One row per (video, n) saying which kinds of picture exist; names that do not parse are left out."""
    n = F.col(name)
    rows = files.filter(n.rlike(FILE_NAME)).select(
        F.regexp_extract(n, FILE_NAME, 1).alias("video"), F.regexp_extract(n, FILE_NAME, 2).cast("long").alias("n"),
        (F.regexp_extract(n, FILE_NAME, 3) == "-3pt").alias("_three"))
    return rows.groupBy("video", "n").agg(F.bool_or(~F.col("_three")).alias("plain"), F.bool_or("_three").alias("three"))


def unparsed_files(files: DataFrame, name: str) -> DataFrame:
    return files.filter(~F.col(name).rlike(FILE_NAME))


def file_key(name: Column) -> Column:
    """Names compared without case, the storage suffix, the extension, or dash/underscore differences."""
    stem = F.regexp_replace(F.lower(name), r"(_[a-z0-9]{10})?\.jpg$", "")
    return F.regexp_replace(stem, "-", "_")
