"""The registered queries of these operators; ``QUERIES`` and ``SQL`` are what the entry point adds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightline.llm import alignment, ann, bpe, exact_dedup, jaccard_join, language_id, licenses, lm, mixing, phrases, substring_dedup, suffix_dedup, token_counts
from flightline.llm.common import read
from flightline.runtime import prepare, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(prepare(spark), folder)
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op2_mix_sources", mixing.MIX_SQL)
def _(spark, folder):
    return mixing.mix(read(spark, folder, "documents"))


@query("op4_exact_dedup", exact_dedup.EXACT_SQL)
def _(spark, folder):
    return exact_dedup.exact_groups(read(spark, folder, "documents"))


@query("op6_bpe_round_trip")
def _(spark, folder):
    path = tokenizer_file()
    return bpe.digests(bpe.decode(bpe.encode(read(spark, folder, "documents"), path), path))


@query("op8_language_id")
def _(spark, folder):
    docs = read(spark, folder, "documents")
    held_out = language_id.fold("doc_id", 4) == 2
    found = language_id.identify(docs, ~held_out)
    return found.select("doc_id", (language_id.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op10_lm_scores")
def _(spark, folder):
    docs = read(spark, folder, "documents")
    scored = lm.perplexity(docs, language_id.fold("doc_id", 5) != 1)
    return scored.withColumn("held_out", language_id.fold("doc_id", 5) == 1)


@query("op1_repeated_passages")
def _(spark, folder):
    return substring_dedup.digests(substring_dedup.repeated_passages(read(spark, folder, "documents")))


@query("op9_jaccard_components")
def _(spark, folder):
    return jaccard_join.component_ids(jaccard_join.similar_sets(read(spark, folder, "documents")))


@query("op3_license_scan")
def _(spark, folder):
    """Documents as files: source, then a directory of a hundred neighbouring ids, then the id."""
    docs = read(spark, folder, "documents")
    name = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.substring(name, 1, 10), name)
    return licenses.licences(docs.select(path.alias("path"), "text"))


@query("op5_nearest_vectors")
def _(spark, folder):
    return ann.neighbours(read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op7_suffix_dedup")
def _(spark, folder):
    return suffix_dedup.digests(suffix_dedup.repeated_bytes(read(spark, folder, "documents")))


@query("op11_collocations", phrases.PHRASE_SQL)
def _(spark, folder):
    return phrases.collocations(read(spark, folder, "documents"))


@query("op12_token_alignment")
def _(spark, folder):
    return alignment.aligned(read(spark, folder, "documents"), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))


@query("op13_token_counts")
def _(spark, folder):
    """With a cache of its own for each run, so every distinct text is encoded here; a lasting one is ``cache`` of the operator."""
    return token_counts.token_counts(read(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"), workspace(spark, "token-counts"))
