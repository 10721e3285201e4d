"""A training-corpus pipeline: quality classifier, exact dedup, near-dedup, decontamination, encoding. Each stage works on all rows its predecessor kept.

A null or empty text passes through the filters and has no ids; the stages' operators say in their docstrings what they do with repeated ids, rows without an id, and ties.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import byte_bpe, decontaminate, exact_dedup, quality, simhash
from tidewatch.llm.common import discard, settle, settled_alone, table  # noqa: F401, settle for runs of single stages

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal without white space."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies: shingles of five words, similarity 0.8 or more. It is for reprints with small edits, up to one word in 50 or so; of texts whose words are changed throughout it takes few (sf0.1: 609 have an earlier partner of 0.4 or more, 76 of them one of 0.8)."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes of every document."""
    return byte_bpe.encode_and_read_back(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [("quality_classifier", classify), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("benchmark_decontamination", decontaminated), ("byte_bpe", encode)]

#: The fingerprints, the resampling noise and the encoder are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = settled_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        discard(docs)  # not the given table: only what was written here
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
