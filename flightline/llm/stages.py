"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir); all but the last give back the columns of ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightline.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from flightline.llm.common import stored
from flightline.llm.queries import tokenizer_file

SEED = "mix"
WORDS, PERCENT = 5, 80  # near copies of this stage; the query op9 has limits of its own


def framed(docs: DataFrame) -> DataFrame:
    """What the operators read of each row, under a key of its own: whether its id is null, the id, and a hash of the whole row.

    Ids may be null or repeat, with equal or with different texts; rows that share a key are equal and so stand for each other.  No column of the
    documents is renamed or replaced, whatever its name.
    """
    hashed = F.xxhash64(*docs.columns)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), hashed.alias("hash"))
    return docs.select(key.alias("key"), hashed.alias("hash"), *[docs[c] for c in ("doc_id", "text", "lang", "source") if c in docs.columns])


def by_key(docs: DataFrame, keys: DataFrame, how: str = "inner") -> DataFrame:
    """Whole rows (one struct, ``row``) with what ``keys`` (``id``, ``hash`` and more) has for them."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("_id"), F.xxhash64(*docs.columns).alias("_hash"))
    return rows.join(keys, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash")), how)


def one_of_equal(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row for each of ``keys``: the join has equal rows side by side already."""
    again = Window.partitionBy("_id", "_hash").orderBy(F.lit(1))
    return by_key(docs, keys).withColumn("_again", F.row_number().over(again)).filter("_again = 1")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told go on, repeated rows too; texts that are null, empty or without a letter are rejected.  No documents: none."""
    told = language_id.identify(framed(docs), language_id.fold("doc_id", 4) != 2, "key").filter(F.col("lang_pred") != language_id.UNKNOWN)
    kept = stored(told.select("doc_id.id", "doc_id.hash"), "told")
    return by_key(docs, kept, "left_semi").select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts (A-Z in lower case, null as empty) stays, that of the largest id; a null id is smaller than any, of repeated rows one stays."""
    found = exact_dedup.exact_groups(framed(docs).withColumn("key", F.struct("key.id", "key.hash")), "key")
    kept = stored(found.filter("kept").select("doc_id.id", "doc_id.hash").distinct(), "kept")
    return one_of_equal(docs, kept).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that reach each other by near-copy links one stays, that of the smallest id; one without an id only where none has an id.

    Texts null, empty or without words link with nothing and stay; of repeated rows with words one stays.
    """
    sets = jaccard_join.similar_sets(framed(docs), "key", size=WORDS, percent=PERCENT)
    found = jaccard_join.component_ids(sets)
    kept = found.filter("doc_id = component_id").groupBy("doc_id.id", "doc_id.hash").agg(F.when(F.max("n_shingles") > 0, F.lit(1)).otherwise(F.count("*")).alias("n"))
    return one_of_equal(docs, stored(kept, "kept")).withColumn("_nr", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its words: whole passes, and one more where at least half of the rest is taken; none: it goes.

    Texts null, empty or without words take nothing and go; repeated rows each have a share; a null source is one of its own.
    """
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    taken = mixing.mix(framed(docs), seed=SEED, carried=("hash",)).filter("size > 0")
    taken = taken.groupBy(F.col("doc_id").alias("id"), "hash").agg(F.sum(times).cast("int").alias("times")).filter("times > 0")
    return one_of_equal(docs, stored(taken, "repeats")).withColumn("_nr", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as digests, one row per row, repeated ones too; the decoded text's digest shows the round trip.  Null and empty texts have no tokens."""
    path = tokenizer_file()
    return bpe.digests(bpe.decode(bpe.encode(docs, path), path))
