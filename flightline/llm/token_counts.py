"""Token counts through a cache: what is known by content digest and tokenizer version is looked up, only distinct misses are encoded and appended."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightline.llm.common import small_batches, stored

LIMIT = 4096
CACHE = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(raw: bytes, kind: str) -> str:
    """Names a tokenizer by its library, that library's version and the digest of its file: a change of any starts a cache of its own."""
    if kind == "model":
        import sentencepiece
        library = f"sentencepiece-{sentencepiece.__version__}"
    else:
        import tokenizers
        library = f"tokenizers-{tokenizers.__version__}"
    return f"{library}-{hashlib.sha256(raw).hexdigest()}"


def counter(raw: bytes, kind: str):
    """The library's own count for a list of texts: no added tokens, no truncation, no padding; special strings as by its default."""
    if kind == "model":
        import sentencepiece
        pieces = sentencepiece.SentencePieceProcessor(model_proto=raw)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, out_type=int, add_bos=False, add_eos=False, num_threads=1)]
    from tokenizers import Tokenizer
    whole = Tokenizer.from_str(raw.decode("utf-8"))
    whole.no_truncation()
    whole.no_padding()
    return lambda texts: [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]


def encoded_counts(texts: DataFrame, raw: bytes, kind: str) -> DataFrame:
    """(digest, n_tokens) of (digest, text) rows; the tokenizer's file travels as bytes, its size is bounded by the file."""
    shared = texts.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value, kind)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(batch.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def open_cache(docs: DataFrame, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) known for this tokenizer; a digest that two runs appended counts once."""
    spark = docs.sparkSession
    return (spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def token_counts(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
                 normal: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``; counts not yet in the folder ``cache`` are appended to it.

    ``path`` is a tokenizers ``.json`` or a sentencepiece ``.model`` file.  ``normal`` is the text as far as it decides the count (for a tokenizer that
    lower-cases: the lower-cased text); by default the text itself, null as empty.  Equal normalised texts are encoded once, in whole; empty
    texts have what the library gives for them; repeated rows and null ids each keep their row.  Other columns are not read.
    The cache must be in storage that driver and executors share; it is partitioned by tokenizer version and only ever appended to.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = "model" if path.endswith(".model") else "json"
    with open(path, "rb") as f:
        raw = f.read()
    version = tokenizer_version(raw, kind)
    text = F.coalesce(F.col(text_col), F.lit(""))
    normal = text if normal is None else F.coalesce(normal, F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"),
                        normal.alias("text"))
    slim = stored(keyed.drop("text"), "content-digests")
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache)  # a new cache is an empty folder
    # one row stands for each digest; what is encoded is found by digest and id, so texts with many copies are no hot key
    state = slim.groupBy("digest").agg(F.min("doc_id").alias("one")).join(open_cache(docs, cache, version), "digest", "left")
    state = stored(state, "known-digests")
    misses = state.filter(F.col("n_tokens").isNull()).select(F.col("digest").alias("missing"), "one")
    fresh = keyed.join(misses, (F.col("digest") == F.col("missing")) & F.col("doc_id").eqNullSafe(F.col("one")), "left_semi")
    found = stored(encoded_counts(fresh, raw, kind).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "fresh-counts")
    found.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)
    # both sides come from tables, so Spark may split the rows of a digest that many share
    counts = state.filter(F.col("n_tokens").isNotNull()).select("digest", "n_tokens").unionAll(found)
    return slim.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
