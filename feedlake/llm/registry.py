"""The registered queries of this subpackage: each operator over its whole table, with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_dir
from . import (
    bpe, conversation_repair, nearest, ngram_join, oracles, quality_classifier, quality_rules, ranked_search, secret_scans, source_mixing, substring_dedup, suffix_dedup, url_filters, warc,
)

QUERIES = {}
SQL = oracles.SQL


def _query(build):
    QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op1_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scans.scan_secrets(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scans.joined_spans(F.col("base")), 256).alias("base_sha256"),
        secret_scans.joined_spans(F.col("spans")).alias("spans"), "n_random")


@_query
def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    judged = url_filters.judge_urls(pages, url_filters.rule_table(spark))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


@_query
def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    found = ngram_join.link_documents(_table(spark, folder, "documents").select("doc_id", "text"), gram=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@_query
def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "labels")
    scored = quality_classifier.score_documents(docs, quality_classifier.train(docs, labels), keep=["doc_id"])
    held_out = quality_classifier.fold(F.col("row.doc_id")) == quality_classifier.HELD_OUT_FOLD
    predicted = (F.col("score") >= quality_classifier.THRESHOLD).cast("int")
    return scored.select("row.doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def word_vocabulary() -> str:
    """Place of the public vocabulary file that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe.encode_documents(_table(spark, folder, "documents").select("doc_id", "text"), word_vocabulary(), keep=["doc_id"])
    return encoded.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@_query
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    return cleaned.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


@_query
def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    # The text is not needed once it is counted, so the rows that travel are narrow.
    docs = _table(spark, folder, "documents")
    return source_mixing.mix(docs.select("doc_id", "source", "text"), keep=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


@_query
def op8_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, F.col("vec_id") % 20 == 0)


@_query
def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    return cleaned.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rated = quality_rules.rate_documents(_table(spark, folder, "documents").select("doc_id", "text", "lang", "source"), keep=["doc_id"])
    return rated.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query
def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = fresh_dir(spark, "archives")
    warc.write_archive(warc.page_records(_table(spark, folder, "pages").select("page_id", "url", "html")), archives)
    records = warc.read_archive(spark, archives, payload=False).filter("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


@_query
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark").select("item_id", "text"))


@_query
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversation_repair.damaged(_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))
    return conversation_repair.repair(rows)
