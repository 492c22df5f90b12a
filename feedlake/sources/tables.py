"""The tables, as batches and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import TABLES


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Scan with the declared schema: no inference pass."""
    return spark.read.schema(TABLES[name]).parquet(path)


def stream_table(spark: SparkSession, name: str, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Incremental read of an append-only table such as the processing log."""
    reader = spark.readStream.schema(TABLES[name])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
