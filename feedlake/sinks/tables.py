"""Table writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_version(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()) -> None:
    """Write a new table version; an existing path is never overwritten, since the new version may be read from it.

    ``partition_by`` suits columns with few values, such as the status. ``sort_by`` orders the rows within each file, so that a scan with
    a filter on these columns skips row groups; both do what an index would.
    """
    rows = df.sortWithinPartitions(*partition_by, *sort_by) if sort_by else df
    rows.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def save_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> None:
    """Save a catalog table hashed and sorted by its key. Tables with the same number of buckets join on the key without a shuffle.

    The rows are first brought together by bucket, so that each bucket becomes one file and not one per task.
    """
    rows = df.repartition(buckets, key)
    rows.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)


def append_log(events: DataFrame, path: str) -> None:
    """Append log rows; a missing ``timestamp`` is the time of writing, in UTC."""
    now = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())
    if "timestamp" in events.columns:
        now = F.coalesce("timestamp", now)
    events.withColumn("timestamp", now).write.mode("append").parquet(path)
