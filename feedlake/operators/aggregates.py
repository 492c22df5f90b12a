"""Counts and reports. Every grouping is partially aggregated before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digest as fd
from ..functions.text import time_coded_line
from ..schemas import COMPLETED, FAILED, IN_PROGRESS, LOG_STATUSES, PENDING
from .ordering import with_next


def _tally(condition: Column) -> Column:
    """Sum of ones: NULL over no rows, unlike a count."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def processing_stats(status: DataFrame) -> DataFrame:
    s = F.col("status")
    return status.agg(
        F.count("*").alias("total_episodes"),
        _tally(s == COMPLETED).alias("completed"),
        _tally(s == FAILED).alias("failed"),
        _tally(s == PENDING).alias("pending"),
        _tally(s.isin(*IN_PROGRESS)).alias("in_progress"),
    )


def count_where(df: DataFrame, condition: str | Column, into: str = "n") -> DataFrame:
    return df.filter(condition).agg(F.count("*").alias(into))


def sync_totals(inserted: DataFrame) -> DataFrame:
    """New items per feed; the row with NULL feed is the total."""
    return inserted.rollup("feed_id").agg(F.count("*").alias("new_episodes"))


def import_counts(outcome: DataFrame) -> DataFrame:
    """``added`` and ``skipped`` from per-address rows with ``n_rows`` and ``is_added``."""
    added = F.coalesce(F.sum(F.when(F.col("is_added"), 1)), F.lit(0))
    rows = F.coalesce(F.sum("n_rows"), F.lit(0))
    return outcome.agg(added.cast("bigint").alias("added"), (rows - added).cast("bigint").alias("skipped"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def digest_heading(base: DataFrame) -> DataFrame:
    """One row: number of items, first and last completion, the shown range and count."""
    facts = base.agg(
        F.count("*").alias("n"), F.min("completed_at").alias("oldest"), F.max("completed_at").alias("newest")
    )
    return facts.select(
        "n", "oldest", "newest", fd.date_range("oldest", "newest").alias("date_range"), fd.counted("n").alias("counted")
    )


def time_coded_parts(segments: DataFrame, lines_per_part: int = 1000) -> DataFrame:
    """Time-coded transcripts from segment rows, as consecutive parts of bounded length.

    ``segments`` has ``episode_id``, ``id`` (its place from 0), ``start`` and ``text``. The parts of one item, in order and joined
    by line ends, are its whole transcript; no task ever holds more than one part, however long the item is.
    """
    line = F.struct("id", time_coded_line("start", "text").alias("line"))
    parts = segments.groupBy("episode_id", F.floor(F.col("id") / lines_per_part).alias("part_no")).agg(
        F.sort_array(F.collect_list(line)).alias("lines")
    )
    return parts.select("episode_id", "part_no", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def text_lengths(transcripts: DataFrame, by: str) -> DataFrame:
    raw, cleaned = F.length("raw_text").cast("bigint"), F.length("cleaned_text").cast("bigint")
    return transcripts.groupBy(by).agg(
        F.count("*").alias("n"),
        F.sum(raw).alias("raw_chars"),
        F.sum(cleaned).alias("cleaned_chars"),
        F.avg(raw).alias("avg_raw_chars"),
    )


def stage_runs(logs: DataFrame) -> DataFrame:
    """Each 'started' log row with the next row of the same item and stage, if that one ends the run."""
    order = ["timestamp", "id"]
    slim = logs.select("episode_id", "stage", "status", *order)
    followed = with_next(slim, ["episode_id", "stage"], order, ["status", "timestamp"])
    ended = F.col("next_status").isin("success", "error")
    seconds = F.timestamp_diff("SECOND", F.col("timestamp"), F.col("next_timestamp"))
    return followed.filter(F.col("status") == LOG_STATUSES[0]).select(
        "id", "episode_id", "stage", F.col("timestamp").alias("started_at"),
        F.when(ended, F.col("next_status")).alias("result"),
        F.when(ended, F.col("next_timestamp")).alias("finished_at"),
        F.when(ended, seconds).cast("bigint").alias("seconds"),
    )


def stage_report(runs: DataFrame) -> DataFrame:
    """Attempts, results and total time per stage."""
    return runs.groupBy("stage").agg(
        F.count("*").alias("attempts"),
        F.count(F.when(F.col("result") == "success", 1)).alias("succeeded"),
        F.count(F.when(F.col("result") == "error", 1)).alias("failed"),
        F.sum("seconds").cast("bigint").alias("seconds"),
    )
