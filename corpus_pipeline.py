"""Corpus pipeline: quality rules, near-duplicate removal, mixing to target weights, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; ``run`` writes
each stage's rows to the shared folder and reads them back. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from murmura.llm import mixing, pieces, quality, simhash
from murmura.scratch import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or the fences of its language and source reject."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of texts whose 5-word shingles are similar at 0.8 or more."""
    return simhash.without_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix reads it, to the nearest whole reading; unread documents go."""
    return mixing.repeated_documents(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document."""
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), ("n_tokens", "ids"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("source_mix", source_mix), ("piece_ids", piece_ids)]

#: Quantile sketches, SimHash and SentencePiece have no SQL form; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
