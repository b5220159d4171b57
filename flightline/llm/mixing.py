"""Mixing sources to target weights with a low-discrepancy slot schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightline.llm.common import stored, word_count

BLOCK, EPOCHS = 64, 3
WEIGHTS = (5, 2, 1)
STEP, TURN = 1327217885, 1 << 31  # the golden ratio as an odd fraction of 2^31: multiples of it, modulo 2^31, are the schedule's points
CHUNK = 1 << 14
CELLS = 4096


def source_targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = EPOCHS) -> DataFrame:
    """(source, source_size, target, below): shares by weight, stopped at ``most`` times a source's size, the excess shared again.

    Filling ends at one level ``L``: a source gets ``min(most * size, L * weight)``.  In order of ``most * size / weight`` those stopped
    come first, so one pass over the short table of sources finds it.  ``below`` sums the targets of earlier sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    everyone = Window.partitionBy()
    filled = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"_all": F.sum("source_size").over(everyone), "_w": F.sum("w").over(everyone),
                       "_cap": F.coalesce(F.sum("cap").over(filled), F.lit(0)), "_gone": F.coalesce(F.sum("w").over(filled), F.lit(0))})
    # the level that sources from this one on would share if all before it are stopped
    s = s.withColumn("_level", (F.col("_all") - F.col("_cap")).cast("double") / (F.col("_w") - F.col("_gone")).cast("double"))
    s = s.withColumn("_stopped", F.col("_level") * F.col("w") > F.col("cap"))
    s = s.withColumn("_l", F.min(F.when(~F.col("_stopped"), F.struct("_gone", "_level"))).over(everyone)["_level"])
    s = s.withColumn("target", F.when(F.col("_stopped"), F.col("cap").cast("double")).otherwise(F.col("_l") * F.col("w")))
    s = s.withColumn("below", F.coalesce(F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return s.select("source", "source_size", "target", "below")


def point(i: Column) -> Column:
    """The ``i``-th point of the schedule, in [0, 1)."""
    return F.pmod(F.pmod(i, F.lit(TURN)) * F.lit(STEP), F.lit(TURN)).cast("double") / float(TURN)


def scheduled_slots(sources: DataFrame, total: int, block: int) -> DataFrame:
    """(source, rank): slot ``i`` goes to the source in whose share its point falls; slots of a source are ranked in schedule order.

    The unit interval is cut into cells, so slots meet sources by an equi join on the cell.  Ranks are a count within a chunk of
    consecutive slots plus the counts of earlier chunks: no task ranks a whole source.
    """
    spark = sources.sparkSession
    share = sources.filter("target > 0").select("source", (F.col("below") / float(max(total, 1))).alias("lo"))
    share = share.withColumn("hi", F.coalesce(F.lead("lo").over(Window.orderBy("lo")), F.lit(2.0)))
    cell = lambda c: F.least(F.floor(c * CELLS), F.lit(CELLS - 1))
    share = share.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    slots = spark.range(-(-total // block)).select(F.col("id").alias("slot"), point(F.col("id") + 1).alias("u"))
    slots = slots.withColumn("cell", cell(F.col("u"))).join(share, "cell").filter("u >= lo AND u < hi")
    slots = slots.select("source", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = slots.groupBy("source", "chunk").count().select("source", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("source", "chunk").orderBy("slot")
    ranked = slots.withColumn("r", F.row_number().over(inside) - 1).alias("a").join(
        counts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.chunk") == F.col("b.chunk")))
    return ranked.select("a.source", (F.col("earlier") + F.col("r")).alias("rank"))


def shuffled_starts(rows: DataFrame, seed: str, carried: Sequence[str] = ()) -> DataFrame:
    """Adds ``start``: where a document's words begin in its source's shuffled stream; summed over buckets of the shuffle, then within."""
    rows = rows.withColumn("_h", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)))).withColumn("_b", F.substring("_h", 1, 3))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("source", "_b").agg(F.sum("size").alias("_n")).select(
        F.col("source").alias("_s"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size", *carried).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(buckets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_bb")))
    return rows.select("doc_id", "source", "size", *carried, (F.col("_earlier") + F.col("_within")).alias("start"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS,
        most: int = EPOCHS, block: int = BLOCK, seed: str = "mix", carried: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    A source's documents, in an order shuffled by ``seed``, make a stream of words that is cut into blocks of ``block`` words and may be gone
    through ``most`` times.  Slot number r of a source takes its block number r, so a source's taken words differ from its target by the
    schedule's discrepancy, a few blocks.  Null text has size 0, texts without words take nothing, a null source is a source of its own
    (last by name).  Rows that repeat are separate documents.  No words at all: every target and ``taken`` is 0.  The table of sources, one
    row each, is taken to be short.  ``carried`` columns are kept in the result and order rows of one id and size; others are not read.
    """
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *carried), "sizes")
    sources = stored(source_targets(rows, weights, most), "sources")
    total = int(rows.agg(F.sum("size")).first()[0] or 0)
    slots = scheduled_slots(sources, total, block).select(F.coalesce("source", F.lit("")).alias("_slot_source"), F.col("source").isNull().alias("_slot_null"), F.col("rank").alias("_slot"))
    named = sources.select(F.col("source").alias("_src"), "source_size", "target")
    laid = shuffled_starts(rows, seed, carried).join(named, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    rounds = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.col("start") + e * F.col("source_size"))
    pieces = laid.filter("size > 0").withColumn("_from", F.explode(rounds)).withColumn("_to", F.col("_from") + F.col("size"))
    pieces = pieces.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
    words = F.least(F.col("_to"), (F.col("_block") + 1) * block) - F.greatest(F.col("_from"), F.col("_block") * block)
    pieces = pieces.select("doc_id", "source", "size", "source_size", "target", "start", "_block", words.alias("_words"))
    met = pieces.join(slots, (F.coalesce("source", F.lit("")) == F.col("_slot_source")) & (F.col("source").isNull() == F.col("_slot_null")) & (F.col("_block") == F.col("_slot")))
    took = met.groupBy("source", "start").agg(F.sum("_words").alias("taken")).select(F.col("source").alias("_s"), F.col("start").alias("_at"), "taken")
    # a place in a source's stream belongs to one document, as those without words take none
    out = laid.join(took, F.col("source").eqNullSafe(F.col("_s")) & (F.col("start") == F.col("_at")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", *carried)


MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
n AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM n),
f AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
        CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(cap) OVER o AS BIGINT), 0) AS rest,
        CAST(sum(w) OVER () AS BIGINT) - coalesce(CAST(sum(w) OVER o AS BIGINT), 0) AS still, row_number() OVER q AS k FROM w
      WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)),
g AS (SELECT *, rest::DOUBLE / still::DOUBLE AS level, (rest::DOUBLE / still::DOUBLE) * w > cap AS stopped FROM f),
t AS (SELECT source, source_size, total, CASE WHEN stopped THEN cap::DOUBLE ELSE (SELECT arg_min(level, k) FROM g WHERE NOT stopped) * w END AS target FROM g),
b AS (SELECT *, coalesce(sum(target) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / total AS lo FROM t WHERE target > 0),
s AS (SELECT *, coalesce(lead(lo) OVER (ORDER BY lo), 2.0) AS hi FROM b),
p AS (SELECT ((i % {TURN}) * {STEP}) % {TURN} / {float(TURN)} AS u FROM generate_series(1, (SELECT CAST(ceil(sum(size) / {BLOCK}.0) AS BIGINT) FROM d)) AS r(i)),
c AS (SELECT s.source, count(*) * {BLOCK} AS words FROM p JOIN s ON p.u >= s.lo AND p.u < s.hi GROUP BY s.source),
l AS (SELECT d.*, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || 'mix'), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM d)
SELECT l.doc_id, l.size, t.source_size, t.target, l.source,
       CAST(greatest(0, least(l.size, coalesce(c.words, 0) - l.start)) + greatest(0, least(l.size, coalesce(c.words, 0) - l.start - t.source_size))
          + greatest(0, least(l.size, coalesce(c.words, 0) - l.start - 2 * t.source_size)) AS BIGINT) AS taken
FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON l.source IS NOT DISTINCT FROM c.source
"""
