"""Work that needs one global order, without putting the whole order into one task.

The rows are range-partitioned by a unique order into slices of about equal size, also when one key holds most of the rows, and
written once. What crosses a slice border is then settled on one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

_ROW_BITS = 33  # low bits of monotonically_increasing_id() that count rows within a partition


def sliced(df: DataFrame, *order: str | Column) -> DataFrame:
    """Rows sorted into range slices: ``_slice`` grows with the order, ``_row`` counts from 0 within the slice.

    ``order`` must be unique over the rows. The result is written to the shared folder, so that the slice borders, which Spark picks
    by sampling, are the same for all later uses.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    fixed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()))
    return fixed.select(
        *df.columns,
        F.shiftright("_at", _ROW_BITS).cast("int").alias("_slice"),
        F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )


def with_position(df: DataFrame, *order: str | Column, into: str = "position", start: int = 1) -> DataFrame:
    """Number all rows without gaps in a unique global order."""
    rows = sliced(df, *order)
    sizes = rows.groupBy("_slice").agg(F.count("*").alias("_n"))
    # One row per slice: neither the window nor the broadcast grows with the data.
    before = sizes.select("_slice", (F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_slice").select(
        *df.columns, (F.col("_before") + F.col("_row") + start).cast("bigint").alias(into)
    )


def with_next(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Add ``next_<field>``: the fields of the following row with the same keys. ``keys + order`` must be unique.

    The rows are cut into slices, so that a group may be of any size; each slice also gets the first row of the slice after it, and the
    window runs per slice.
    """
    rows = sliced(df, *keys, *order)
    kept = rows.withColumn("_border", F.lit(False))
    # One row per slice, so the window below stays small whatever the data.
    heads = rows.filter("_row = 0").withColumn("_border", F.lit(True))
    back = Window.orderBy("_slice")
    heads = heads.withColumn("_slice", F.lag("_slice").over(back)).filter("_slice IS NOT NULL")
    within = Window.partitionBy("_slice").orderBy("_border", "_row")
    same = F.lit(True)
    for key in keys:
        same = same & F.lead(key).over(within).eqNullSafe(F.col(key))
    following = [F.when(same, F.lead(f).over(within)).alias(f"next_{f}") for f in fields]
    return (
        kept.unionByName(heads).select("*", *following).filter("NOT _border").drop("_slice", "_row", "_border")
    )


def newest(df: DataFrame, date: str, tie: str, limit: int | None = None) -> DataFrame:
    """Newest first, undated rows last; a limit of 0 or None means all rows."""
    ordered = df.orderBy(F.col(date).desc_nulls_last(), F.col(tie))
    return ordered.limit(limit) if limit else ordered
