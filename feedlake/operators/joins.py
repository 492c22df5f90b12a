"""Reads that combine the tables.

No join carries a broadcast hint: Spark broadcasts a side when its size is below ``spark.sql.autoBroadcastJoinThreshold`` and
otherwise shuffles, where adaptive execution splits hot keys.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import feeds as ff
from ..functions.basic import days_before, utc
from ..schemas import COMPLETED, IN_PROGRESS, RETRYABLE
from .ordering import newest

DEFAULT_RUN_LIMIT = 5
DEFAULT_LIST_LIMIT = 10


def enabled_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.filter("enabled").select("id", "name", "url", "last_checked")


def retryable(status: DataFrame) -> DataFrame:
    return status.filter(F.col("status").isin(*RETRYABLE))


def with_status(status: DataFrame, wanted: str = "all") -> DataFrame:
    return status if wanted == "all" else status.filter(F.col("status") == F.lit(wanted))


def pending_queue(
    episodes: DataFrame, status: DataFrame, limit: int | None = None, stale_before: str | datetime | None = None
) -> DataFrame:
    """Items to work on, newest first. With ``stale_before``, items left in progress since then are taken up again."""
    chosen = F.col("status").isin(*RETRYABLE)
    if stale_before is not None:
        chosen = chosen | (F.col("status").isin(*IN_PROGRESS) & (F.col("updated_at") < utc(stale_before)))
    waiting = status.filter(chosen).select(F.col("episode_id").alias("id"), "status")
    wanted = episodes.select("id", "feed_id", "title", "audio_url", "published_date")
    return newest(wanted.join(waiting, "id"), "published_date", "id", limit)


def run_queue(episodes: DataFrame, status: DataFrame, limit: int | None = None) -> DataFrame:
    """The queue of one run; without a limit, or with 0, the default run size applies."""
    return pending_queue(episodes, status, limit or DEFAULT_RUN_LIMIT)


def listing(episodes: DataFrame, status: DataFrame, wanted: str = "all", limit: int | None = DEFAULT_LIST_LIMIT) -> DataFrame:
    states = with_status(status, wanted).select(F.col("episode_id").alias("id"), "status")
    rows = episodes.select("id", "title", "published_date").join(states, "id")
    return newest(rows, "published_date", "id", limit)


def shown_episodes(listed: DataFrame) -> DataFrame:
    day = F.coalesce(F.date_format("published_date", "yyyy-MM-dd"), F.lit("None"))
    return listed.select("id", ff.shorten("title", 60).alias("title"), day.alias("published"), "status")


def shown_feeds(feeds: DataFrame) -> DataFrame:
    checked = F.coalesce(F.date_format("last_checked", "yyyy-MM-dd HH:mm:ss"), F.lit("Never"))
    return feeds.select("id", "name", ff.shorten("url", 50).alias("url"), checked.alias("last_checked"))


def episode_info(episodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Lookup of many items at once; ``ids`` holds distinct ``episode_id``."""
    return episodes.select(F.col("id").alias("episode_id"), "title", "audio_url").join(ids, "episode_id", "left_semi")


def status_of(status: DataFrame, ids: DataFrame) -> DataFrame:
    return status.drop("updated_at").join(ids, "episode_id", "left_semi")


def transcript_of(transcripts: DataFrame, ids: DataFrame) -> DataFrame:
    wanted = transcripts.select("episode_id", "raw_text", "cleaned_text", "transcription_model", "cleaning_model")
    return wanted.join(ids, "episode_id", "left_semi")


def known_guids(episodes: DataFrame) -> DataFrame:
    return episodes.select("feed_id", "guid")


def digest_base(episodes: DataFrame, feeds: DataFrame, status: DataFrame, as_of: str | datetime, days: int = 7) -> DataFrame:
    """Items completed within the last ``days``, with their feed."""
    done = status.filter((F.col("status") == COMPLETED) & (F.col("completed_at") >= days_before(as_of, days)))
    done = done.select(F.col("episode_id").alias("id"), "completed_at", "summary_path")
    names = feeds.select(F.col("id").alias("feed_id"), F.col("name").alias("feed_name"))
    joined = episodes.select("id", "feed_id", "title", "published_date").join(done, "id").join(names, "feed_id")
    return joined.select("id", "title", "published_date", "feed_name", "completed_at", "summary_path")


def recent_enough(published: str | Column, as_of: str | datetime, max_age_days: int | None) -> Column:
    """No limit, no date, or not older than the limit."""
    if not max_age_days:
        return F.lit(True)
    date = F.col(published) if isinstance(published, str) else published
    return date.isNull() | (date >= days_before(as_of, max_age_days))


def new_items(items: DataFrame, episodes: DataFrame) -> DataFrame:
    """Items whose guid is not stored yet."""
    return items.join(episodes.select("guid"), "guid", "left_anti").select(*items.columns)


def existing(guids: DataFrame, episodes: DataFrame) -> DataFrame:
    """Each distinct asked guid with a flag. Both sides are reduced to one row per guid before the join."""
    asked = guids.select("guid").filter("guid IS NOT NULL").distinct()
    stored = episodes.select("guid").distinct().withColumn("stored", F.lit(True))
    return asked.join(stored, "guid", "left").select("guid", F.coalesce("stored", F.lit(False)).alias("episode_exists"))


def now_enabled(imported: DataFrame, feeds: DataFrame) -> DataFrame:
    """Imported feeds that the feeds table holds as enabled."""
    return imported.join(feeds.filter("enabled").select("url"), "url", "left_semi").select(*imported.columns)
