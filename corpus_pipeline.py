"""From raw documents to token ids: quality rules, near duplicates, secrets, the source mix, encoding.

Each stage is one operator of ``feedlake.llm``. Its result is written and read again before the next stage, so that a lost executor
costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm import bpe, ngram_join, quality_rules, secret_scans, source_mixing
from feedlake.llm.registry import word_vocabulary
from feedlake.storage import materialize


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word n-grams, similarity 0.8."""
    return ngram_join.keep_one(docs)


def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their secrets."""
    return secret_scans.mask_secrets(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return source_mixing.mixed(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return bpe.tokenized(docs, word_vocabulary())


STAGES = [
    ("quality rules", good_documents),
    ("near duplicates", distinct_documents),
    ("secrets", masked_documents),
    ("mix", mixed_documents),
    ("encoding", encoded_documents),
]

# The random-string model, the mix of whole texts and the encoder are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
