"""Table updates as functions from the old table and a batch to the new table.

Nothing is changed in place: the caller writes the result as a new version (``sinks.tables``). A batch may hold many rows of one
key; it is always reduced to one row per key by partial aggregation before it meets the table, so a hot key costs no more
than any other.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import non_empty, utc
from ..schemas import COMPLETED, NOT_NULL, PENDING, TABLES
from ..sinks.keyed import KeyedTable
from .ordering import with_position

STATUS_PATHS = ("audio_path", "raw_transcript_path", "cleaned_transcript_path", "summary_path")
TRANSCRIPT_FIELDS = ("raw_text", "cleaned_text", "transcription_model", "cleaning_model")


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union by name; columns one side lacks are NULL there."""
    return old.unionByName(new, allowMissingColumns=True)


def last_id(df: DataFrame, column: str = "id") -> int:
    """Largest id given out so far: the one value read back to the driver."""
    return df.agg(F.max(column)).first()[0] or 0


def with_new_ids(df: DataFrame, after: int, *order: str, into: str = "id") -> DataFrame:
    """Consecutive ids above ``after`` in a unique order."""
    return with_position(df, *order, into=into, start=after + 1)


def hash_id(*natural_key: str) -> Column:
    """Id from the natural key, for loads that need no consecutive ids: it takes neither a sort nor a write."""
    return F.xxhash64(*natural_key)


def shared_ids(*tables: DataFrame) -> DataFrame:
    """``(id, n)`` of ids that more than one row has, over all tables: hash ids are 64 bits wide, so large loads should check them."""
    ids = tables[0].select("id")
    for table in tables[1:]:
        ids = ids.unionAll(table.select("id"))
    return ids.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def stored_matches(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The stored rows that a batch can meet. The join kind is left to Spark, which knows the size of a batch that has been written."""
    return stored.join(batch.select(key).distinct(), key, "left_semi").select(*stored.columns)


def _own_key(key: str, order: tuple[str, ...]) -> Column:
    """The key as text; a row without one gets its own from the order, so that such rows spread over all tasks."""
    own = F.concat_ws(":", F.lit("n"), *[F.col(c).cast("string") for c in order])
    return F.when(F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(own)


def _first_rows(df: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row")
    return df.groupBy(_own_key(key, order).alias("_key")).agg(first).select("_key", "row.*")


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """First row of each key; rows without a key are all kept. ``order`` must be unique."""
    return _first_rows(df, key, order).drop("_key")


def latest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Last row of each key by ``order``, which must be unique within a key."""
    others = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("row")
    return df.groupBy(key).agg(last).select(key, "row.*").select(*df.columns)


def first_and_last(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per key: first place, and the value at the first and at the last place."""
    return df.groupBy(key).agg(
        F.min(order).alias(f"first_{order}"),
        F.min_by(value, order).alias(f"first_{value}"),
        F.max_by(value, order).alias(f"last_{value}"),
        F.count("*").alias("n_rows"),
    )


def feed_outcomes(feeds: DataFrame, batch: DataFrame) -> DataFrame:
    """What a batch ``(pos, name, url, enabled)`` does, one row per address.

    The last row of an address names the feed, the first one sets its place among the new ids. Rows without an address are counted
    under NULL. The numbering puts the new addresses first and writes all rows once, for the new table and the counts to read.
    """
    named = batch.select("pos", F.coalesce("name", F.lit("")).alias("name"), non_empty("url").alias("url"), "enabled")
    per_url = named.groupBy("url").agg(
        F.min("pos").alias("first_pos"),
        F.max_by("name", "pos").alias("name"),
        F.max_by("enabled", "pos").alias("enabled"),
        F.count("*").alias("n_rows"),
    )
    known = feeds.select("url", F.col("id").alias("known_id"))
    marked = per_url.join(known, "url", "left").withColumn("is_added", F.col("url").isNotNull() & F.col("known_id").isNull())
    numbered = with_position(marked, F.col("is_added").desc(), "first_pos", into="new_id", start=last_id(feeds) + 1)
    return numbered.select(
        "url", F.when(F.col("is_added"), F.col("new_id")).otherwise(F.col("known_id")).alias("id"), "name", "enabled", "first_pos",
        "n_rows", "is_added",
    )


def upsert_feeds(feeds: DataFrame, outcomes: DataFrame, as_of: str | datetime) -> DataFrame:
    """Overwrite name and enabled of known feeds, keep the rest, and add the new ones."""
    usable = outcomes.filter("url IS NOT NULL")
    changes = usable.select("url", F.col("name").alias("new_name"), F.col("enabled").alias("new_enabled"), "id", "is_added")
    kept = feeds.join(changes.drop("id"), "url", "left").select(
        "id", F.coalesce("new_name", "name").alias("name"), "url",
        F.when(F.col("new_name").isNotNull(), F.col("new_enabled")).otherwise(F.col("enabled")).alias("enabled"),
        "last_checked", "created_at",
    )
    added = usable.filter("is_added").select(
        "id", "name", "url", "enabled", F.lit(None).cast("timestamp_ntz").alias("last_checked"), utc(as_of).alias("created_at")
    )
    return kept.unionByName(added)


def insert_items(
    episodes: DataFrame,
    items: DataFrame,
    feeds: DataFrame | None,
    as_of: str | datetime,
    order: tuple[str, ...] = ("feed_id", "pos"),
    ids: str = "sequence",
    after: int | None = None,
) -> DataFrame:
    """Rows to add to ``episodes``: the first item of each guid that is not stored yet.

    ``items`` has the episode columns without id, plus the columns of ``order``, which must be unique. Rows that miss a required value
    or whose feed is unknown are dropped; without ``feeds``, all feeds count as known. A NULL guid never collides. ``ids`` is
    ``sequence`` (above ``after``, else above the largest of ``episodes``) or ``hash``. Repeats are dropped before the join, and both use one shuffle by guid.
    """
    complete = items
    for column in NOT_NULL["episodes"]:
        complete = complete.filter(F.col(column).isNotNull())
    if feeds is not None:
        complete = complete.join(feeds.select(F.col("id").alias("feed_id")), "feed_id", "left_semi")
    stored = episodes.filter("guid IS NOT NULL").select(F.concat(F.lit("k"), "guid").alias("_key"))
    fresh = _first_rows(complete, "guid", order).join(stored, "_key", "left_anti").drop("_key")
    numbered = (
        with_new_ids(fresh, last_id(episodes) if after is None else after, *order)
        if ids == "sequence"
        else fresh.withColumn("id", hash_id("guid", *order))
    )
    stamped = numbered.withColumn("created_at", utc(as_of))
    names = [f.strip().split(" ")[0] for f in TABLES["episodes"].split(",")]
    return stamped.select(*names)


def first_status(inserted: DataFrame, as_of: str | datetime) -> DataFrame:
    """A pending status row for each inserted item."""
    now = utc(as_of)
    return inserted.select(
        F.col("id").alias("episode_id"), F.lit(PENDING).alias("status"), now.alias("started_at"), now.alias("updated_at")
    )


def stamp_checked(feeds: DataFrame, synced: DataFrame, as_of: str | datetime) -> DataFrame:
    """Set ``last_checked`` of the synced feeds, with or without new items."""
    done = synced.select("id").distinct().withColumn("_synced", F.lit(True))
    checked = F.when(F.col("_synced"), utc(as_of)).otherwise(F.col("last_checked"))
    return feeds.join(done, "id", "left").withColumn("last_checked", checked).select(*feeds.columns)


def _last(value: Column, present: Column) -> Column:
    """Last value, by time and place in the batch, among the rows where ``present`` holds."""
    return F.max_by(value, F.when(present, F.struct("at", "seq")))


def status_changes(updates: DataFrame) -> DataFrame:
    """A batch ``(episode_id, status, error_message, *paths, at, seq)`` as one row per item; a field that does not change is NULL.

    In the order of ``at, seq``: status and updated_at always change; completed_at only with status 'completed'; an error text only when it is
    not empty, so an old one stays after a later success; a path only when it is not NULL.
    """
    done = F.col("status") == COMPLETED
    error = non_empty("error_message")
    return updates.groupBy("episode_id").agg(
        F.max_by("status", F.struct("at", "seq")).alias("status"),
        F.max_by("at", F.struct("at", "seq")).alias("updated_at"),
        _last(F.col("at"), done).alias("completed_at"),
        _last(error, error.isNotNull()).alias("error_message"),
        *[_last(F.col(p), F.col(p).isNotNull()).alias(p) for p in STATUS_PATHS],
    )


def update_status(status: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply a batch of ``status_changes``. Unknown items are ignored."""
    changes = status_changes(updates)
    changes = changes.select("episode_id", *[F.col(c).alias(f"n_{c}") for c in changes.columns if c != "episode_id"])
    merged = {c: F.coalesce(f"n_{c}", c).alias(c) for c in
              ("status", *STATUS_PATHS, "error_message", "completed_at", "updated_at")}
    return status.join(changes, "episode_id", "left").select(*[merged.get(c, F.col(c)) for c in status.columns])


def transcript_changes(saves: DataFrame) -> DataFrame:
    """A batch ``(episode_id, *fields, at, seq)`` as one row per item: the last value of each field that is not NULL, the first and the last time."""
    return saves.groupBy("episode_id").agg(
        *[_last(F.col(f), F.col(f).isNotNull()).alias(f) for f in TRANSCRIPT_FIELDS],
        F.min(F.struct("at", "seq")).alias("first"),
        F.max("at").alias("updated_at"),
    )


def save_transcripts(transcripts: DataFrame, saves: DataFrame) -> DataFrame:
    """Apply a batch ``(episode_id, *fields, at, seq)``: insert, or overwrite the fields that are not NULL ('' does overwrite)."""
    found = transcript_changes(saves)
    changes = found.select("episode_id", *[F.col(f).alias(f"n_{f}") for f in TRANSCRIPT_FIELDS], F.col("first").alias("n_first"), F.col("updated_at").alias("n_last_at"))
    unseen = changes.join(transcripts.select("episode_id"), "episode_id", "left_anti").select(
        "episode_id", F.col("n_first.at").alias("at"), F.col("n_first.seq").alias("seq")
    )
    new_ids = with_new_ids(unseen, last_id(transcripts), "at", "seq", "episode_id", into="n_id").select("episode_id", "n_id")
    merged = {
        "id": F.coalesce("id", "n_id"),
        "created_at": F.coalesce("created_at", "n_first.at"),
        "updated_at": F.coalesce("n_last_at", "updated_at"),
        **{f: F.coalesce(f"n_{f}", f) for f in TRANSCRIPT_FIELDS},
    }
    # The ids join the batch, not the result: the full outer join keeps no partitioning, and the whole table would be shuffled again.
    both = transcripts.join(changes.join(new_ids, "episode_id", "left"), "episode_id", "full_outer")
    return both.select(*[merged.get(c, F.col(c)).alias(c) for c in transcripts.columns])


def save_summaries(
    summaries: DataFrame, saved: DataFrame, as_of: str | datetime, order: tuple[str, ...] = ("episode_id",)
) -> DataFrame:
    """Rows to add for a batch ``(episode_id, …text columns, model_used)``: every save is a row of its own, so history is kept.

    ``order`` must be unique in the batch. Read the table through ``latest_summaries``.
    """
    # Only the order is sorted, written and numbered, not the texts. Rows that have all of it join by plain equality, so that a batch that is dealt out stays so.
    whole = F.lit(True)
    for c in order:
        whole = whole & F.col(c).isNotNull()
    numbered = with_new_ids(saved.select(*order), last_id(summaries), *order, into="_id").select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], "_id")
    same, same_or_null = F.lit(True), F.lit(True)
    for i, c in enumerate(order):
        same, same_or_null = same & (F.col(c) == F.col(f"_{i}")), same_or_null & F.col(c).eqNullSafe(F.col(f"_{i}"))
    rows = saved.filter(whole).join(numbered, same).unionByName(saved.filter(~whole).join(numbered, same_or_null))
    stamped = {"id": F.col("_id").alias("id"), "created_at": utc(as_of).alias("created_at")}
    return rows.select(*[stamped.get(c, F.col(c)) for c in summaries.columns])


def latest_summaries(summaries: DataFrame) -> DataFrame:
    return latest_per_key(summaries, "episode_id", "created_at", "id")


def latest_transcripts(transcripts: DataFrame) -> DataFrame:
    return latest_per_key(transcripts, "episode_id", "updated_at", "id")


def take_status(table: KeyedTable, updates: DataFrame, order: int) -> None:
    """``update_status`` for a table that is merged on read: only the batch is written."""
    table.apply(status_changes(updates), order)


def take_transcripts(table: KeyedTable, saves: DataFrame, order: int) -> None:
    """``save_transcripts`` for a table that is merged on read: no stored text is read or moved."""

    def added(unseen: DataFrame) -> DataFrame:
        # The keys alone are sorted and numbered, not the texts.
        keys = unseen.select("episode_id", F.col("first.at").alias("at"), F.col("first.seq").alias("seq"))
        ids = with_new_ids(keys, last_id(table.read().select("id")), "at", "seq", "episode_id").select("episode_id", "id")
        return unseen.join(ids, "episode_id").withColumn("created_at", F.col("first.at"))

    table.apply(transcript_changes(saves), order, added)


def take_feeds(table: KeyedTable, batch: DataFrame, order: int, as_of: str | datetime) -> None:
    """``upsert_feeds`` for a table that is merged on read: a batch ``(pos, name, url, enabled)`` overwrites name and enabled or adds feeds."""
    named = batch.select("pos", F.coalesce("name", F.lit("")).alias("name"), non_empty("url").alias("url"), "enabled").filter("url IS NOT NULL")
    changes = named.groupBy("url").agg(
        F.min("pos").alias("first_pos"), F.max_by("name", "pos").alias("name"), F.max_by("enabled", "pos").alias("enabled"))

    def added(unseen: DataFrame) -> DataFrame:
        return with_new_ids(unseen, last_id(table.read().select("id")), "first_pos").withColumn("created_at", utc(as_of))

    table.apply(changes, order, added)
