"""Corpus pipeline: language ID, exact dedup, near-copy dedup, mixing, tokenizing; each stage is written and read again as the next one's input."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flightline.llm import stages  # noqa: E402
from flightline.llm.common import read, stored  # noqa: E402
from flightline.runtime import prepare  # noqa: E402

STAGES = [
    ("language_id", stages.languages),
    ("exact_dedup", stages.exact_copies),
    ("jaccard_join", stages.near_copies),
    ("mix_sources", stages.mixture),
    ("bpe_round_trip", stages.encoded),
]

ORACLE_SQL = None  # language ID, similarity joins and BPE are beyond SQL; tests/llm compares the whole with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
