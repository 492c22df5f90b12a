"""Structured Streaming forms of the sync, the status view and the weekly counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.basic import utc_instant, utc_wall_clock
from ..operators import state
from ..plans.jobs import incoming_items
from ..schemas import COMPLETED, FAILED, IN_PROGRESS, PENDING, TABLES
from ..sinks.keyed import ROWS_PER_BUCKET, KeyedTable
from ..storage import materialize


def _batch_path(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def run_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Handle all input that is there now, batch by batch, then stop. A restart goes on where the checkpoint ends."""
    writer = stream.writeStream.foreachBatch(handle).outputMode(mode)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Keep the output of each batch in its own folder; a batch that is repeated after a failure replaces it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(path, batch_id))

    return run_batches(stream, write, checkpoint, mode)


def episode_table(spark: SparkSession, path: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> KeyedTable:
    """The episodes that the sync stream keeps, by guid."""
    return KeyedTable(spark, path, f"{TABLES['episodes']}, batch_id BIGINT", "guid", rows_per_bucket)


def stored_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Episodes written by the sync stream, with the batch that brought them."""
    return episode_table(spark, path).read()


def sync_stream(
    fetched: DataFrame, feeds: DataFrame, path: str, checkpoint: str, as_of: str | datetime, max_age_days: int | None = None,
    ids: str = "hash", rows_per_bucket: int = ROWS_PER_BUCKET,
) -> StreamingQuery:
    """Take up new items from a stream of payloads ``(payload_no, url, xml)``.

    Every batch is compared with all that is stored, so a guid is never forgotten; of the stored files those are read whose Bloom filter does
    not exclude all of the batch's guids. ``as_of`` fixes the age rule of the run. Ids are hashes by default: consecutive ones need
    the largest stored id in every batch.
    """
    order = ("feed_id", "payload_no", "pos")

    def take_up(batch: DataFrame, batch_id: int) -> None:
        table = episode_table(batch.sparkSession, path, rows_per_bucket)
        if table.has(batch_id + 1):
            return
        # A file is one task, however long its documents take. The digest of its own also parts the rows of files that were dealt out by the number.
        dealt = batch.repartition(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("payload_no"))
        items = materialize(incoming_items(dealt, feeds, as_of, max_age_days))
        after = state.last_id(table.read().select("id")) if ids == "sequence" else None
        inserted = state.insert_items(table.known(items), items, None, as_of, order, ids, after)
        table.add(inserted.withColumn("batch_id", F.lit(batch_id).cast("long")), batch_id + 1)
        table.compact()

    return run_batches(fetched, take_up, checkpoint)


def without_repeats(
    items: DataFrame, time: str = "published_date", key: str = "guid", delay: str = "30 days", salts: int = 16
) -> DataFrame:
    """Drop repeats of a key within the delay, and rows later than it, with bounded state. Rows without a time do not belong here.

    A key with very many copies is first thinned out in ``salts`` groups at a time, so that one task meets at most that many copies of it;
    0 leaves this step out. The limit follows the newest time seen, not the clock; for an exact age rule use ``sync_stream``.
    """
    timed = items.withColumn("_time", utc_instant(time)).withWatermark("_time", delay)
    if salts:
        salted = timed.withColumn("_salt", F.floor(F.rand(seed=7) * salts))
        timed = salted.dropDuplicatesWithinWatermark([key, "_salt"]).drop("_salt")
    return timed.dropDuplicatesWithinWatermark([key]).drop("_time")


def live_status(logs: DataFrame) -> DataFrame:
    """Newest stage and status of each item; run it in update mode."""
    newest = F.max_by(F.struct("stage", "status"), F.struct("timestamp", "id"))
    return logs.groupBy("episode_id").agg(newest.alias("now"), F.max("timestamp").alias("at")).select(
        "episode_id", "now.stage", "now.status", "at"
    )


#: What a log row says about an item: the state that a stage's start leads to, and that a success of the last stage or any error leads to.
_STARTS = {"download": "downloading", "transcribe": "transcribing", "clean": "cleaning", "summarize": "summarizing"}


def state_of_log(stage: str | Column, status: str | Column) -> Column:
    """The state that a log row reports; NULL if it reports none."""
    stage, status = (F.col(c) if isinstance(c, str) else c for c in (stage, status))
    started = F.create_map(*[F.lit(x) for pair in _STARTS.items() for x in pair])
    return (
        F.when(status == "error", FAILED).when((stage == "summarize") & (status == "success"), COMPLETED)
        .when(status == "started", F.try_element_at(started, stage))
    )


def legal_step(before: str, after: str) -> bool:
    """Whether an item may go from one state to the other: one step on, to a failure from any state that is not final, or, after a failure, from the start."""
    order = (PENDING, *IN_PROGRESS, COMPLETED)
    if before == COMPLETED:
        return False
    if after == FAILED:
        return before != FAILED
    return order.index(after) == (1 if before == FAILED else order.index(before) + 1)


#: Groups that the items of a stream are dealt into. Calling a group costs as much as hundreds of rows, so a group holds the state of many items.
GROUPS = 256
#: Item and stage as the groups keep them; without an item, the number is 0 and the flag is set, so that the numbers stay whole in pandas.
_ITEM = {"item": "int64", "no_item": "bool"}


def _dealt(rows: DataFrame, delay: str, groups: int, *keys: str) -> DataFrame:
    """Rows with their group and their time in microseconds. A row without a time is never passed by the watermark, so it can lead to nothing."""
    timed = rows.filter("_time IS NOT NULL").withWatermark("_time", delay)
    return timed.select(
        F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_group"), F.coalesce("episode_id", F.lit(0)).alias("item"), F.col("episode_id").isNull().alias("no_item"),
        *[c for c in rows.columns if c not in ("episode_id", "_time")], "_time", F.unix_micros("_time").alias("micros"))


def _frame(kinds: dict[str, str], stored: bytes | None, batches: Iterator[pd.DataFrame] = iter(())) -> pd.DataFrame:
    """The stored rows of a group and those that arrive."""
    names = list(kinds)
    kept = [pa.ipc.open_stream(stored).read_pandas()] if stored else []
    arrived = [batch[names] for batch in batches if len(batch)]
    parts = [p for p in (*kept, *arrived) if len(p)]
    return pd.concat(parts, ignore_index=True).astype(kinds) if parts else pd.DataFrame({n: pd.Series(dtype=k) for n, k in kinds.items()})


def _stored(frame: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _wake(group: GroupState, watermark_ms: int, *due: pd.Series) -> None:
    """Have the group called again as soon as the watermark passes one of the times."""
    times = [int(d.min()) for d in due if len(d)]
    if times:
        # The group is called when the watermark is above the time that is set.
        group.setTimeoutTimestamp(max(-(-min(times) // 1000) - 1, watermark_ms, 1))


def item_steps(logs: DataFrame, delay: str = "10 minutes", stale_after: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """The state machine of every item over the log stream: ``(episode_id, id, state, kind, at)``; run it in append mode.

    Rows wait in the state until the watermark has passed them and are then taken in the order of ``timestamp, id``, so the order in
    which they arrive within ``delay`` does not matter. A row that reports the next state is a ``step``; any other is ``illegal`` and
    changes nothing. If an item is in progress and no row of it follows within ``stale_after``, it is reported as ``stale`` at that time, with the id of the
    row that it stopped at. An item's state is small: its present state and the rows of one delay. ``groups``, which a checkpoint fixes, share all items.
    """
    columns = "episode_id BIGINT, id BIGINT, state STRING, kind STRING, at TIMESTAMP_NTZ"
    stale_us = int(pd.Timedelta(stale_after) / pd.Timedelta(microseconds=1))
    reported = logs.select("episode_id", "id", state_of_log("stage", "status").alias("state"), utc_instant("timestamp").alias("_time")).filter("state IS NOT NULL")
    waits = _ITEM | {"id": "int64", "state": "object", "micros": "int64"}
    stands = _ITEM | {"now": "object", "last_id": "int64", "last": "int64"}

    def advance(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        items, waiting = group.get if group.exists else (None, None)
        passed, out = group.getCurrentWatermarkMs(), []
        rows = _frame(waits, waiting, batches)
        due = rows["micros"] <= passed * 1000
        state = {(r[0], r[1]): r[2:] for r in _frame(stands, items).itertuples(index=False, name=None)}

        def stale_until(item: tuple, limit: int) -> None:
            now, last_id, last = state[item]
            if now in IN_PROGRESS and 0 <= last <= limit - stale_us:
                out.append((*item, last_id, now, "stale", last + stale_us))
                state[item] = (now, last_id, -1)

        for number, none, id_, to, micros in rows[due].sort_values(["micros", "id"])[["item", "no_item", "id", "state", "micros"]].itertuples(index=False, name=None):
            item = (number, none)
            state.setdefault(item, (PENDING, -1, -1))
            stale_until(item, micros - 1)
            now = state[item][0]
            step = legal_step(now, to)
            out.append((*item, id_, to, "step" if step else "illegal", micros))
            state[item] = (to if step else now, id_, micros)
        for item in state:
            stale_until(item, passed * 1000)
        stands_now = pd.DataFrame([(*item, *held) for item, held in state.items()], columns=list(stands)).astype(stands)
        rows = rows[~due]
        group.update((_stored(stands_now), _stored(rows)))
        watched = stands_now["now"].isin(IN_PROGRESS) & (stands_now["last"] >= 0)
        _wake(group, passed, rows["micros"], stands_now["last"][watched] + stale_us)
        if out:
            found = pd.DataFrame(out, columns=["item", "no_item", "id", "state", "kind", "at"])
            yield pd.DataFrame({
                "episode_id": found["item"].astype("Int64").mask(found["no_item"]), "id": found["id"], "state": found["state"], "kind": found["kind"],
                "at": pd.to_datetime(found["at"], unit="us")})

    return _dealt(reported, delay, groups, "episode_id").groupBy("_group").applyInPandasWithState(
        advance, columns, "items BINARY, waiting BINARY", "append", GroupStateTimeout.EventTimeTimeout)


def stage_runs(logs: DataFrame, delay: str = "10 minutes", longest: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """``aggregates.stage_runs`` over the log stream; run it in append mode.

    A run is given out as soon as the watermark has passed the next row of its item and stage, whatever the order of arrival within ``delay``:
    with its result if that row ends it, open if it does not. A run that nothing follows within ``longest`` is given out open then. The state
    holds open runs and the rows of one delay, in ``groups`` that share all items; a checkpoint fixes their number.
    """
    columns = "id BIGINT, episode_id BIGINT, stage STRING, started_at TIMESTAMP_NTZ, result STRING, finished_at TIMESTAMP_NTZ, seconds BIGINT"
    longest_us = int(pd.Timedelta(longest) / pd.Timedelta(microseconds=1))
    kinds = _ITEM | {"stage": "object", "id": "int64", "status": "object", "micros": "int64"}
    run = [*_ITEM, "stage"]

    def follow(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        passed = group.getCurrentWatermarkMs() * 1000
        rows = _frame(kinds, group.get[0] if group.exists else None, batches).sort_values([*run, "micros", "id"], ignore_index=True)
        by_run = rows.groupby(run, sort=False, dropna=False)
        next_us, next_status = by_run["micros"].shift(-1).astype("Int64"), by_run["status"].shift(-1)
        gone = rows["micros"] <= passed
        followed = (next_us <= passed).fillna(False).astype(bool)
        began = gone & (rows["status"] == "started")
        limit = rows["micros"] + longest_us
        done = began & (followed | (limit <= passed))
        ended = done & followed & next_status.isin(("success", "error")) & (next_us <= limit).fillna(False).astype(bool)
        kept = ~gone | (began & ~done)
        group.update((_stored(rows[kept]),))
        _wake(group, passed // 1000, rows["micros"][~gone], limit[began & ~done])
        if done.any():
            given, at = rows[done], next_us.where(ended)[done]
            yield pd.DataFrame({
                "id": given["id"], "episode_id": given["item"].astype("Int64").mask(given["no_item"]), "stage": given["stage"],
                "started_at": pd.to_datetime(given["micros"], unit="us"), "result": next_status.where(ended, None)[done],
                "finished_at": pd.to_datetime(at, unit="us"), "seconds": (at - given["micros"]) // 1_000_000})

    rows = logs.select("episode_id", "stage", "id", "status", utc_instant("timestamp").alias("_time"))
    return _dealt(rows, delay, groups, "episode_id", "stage").groupBy("_group").applyInPandasWithState(
        follow, columns, "rows BINARY", "append", GroupStateTimeout.EventTimeTimeout)


def newest_batch(updates: DataFrame, key: str) -> DataFrame:
    """Current value per key from the batches that ``write_batches`` kept in update mode."""
    return state.latest_per_key(updates, key, "batch_id")


def weekly_completions(finished: DataFrame, delay: str = "1 day") -> DataFrame:
    """Completions per feed and week; a week is given out once it can no longer change.

    ``finished`` has ``feed_id``, ``status`` and ``completed_at``. Partial counts are made before the shuffle, so one busy feed does not
    load one task.
    """
    done = finished.filter(F.col("status") == COMPLETED).withColumn("_time", utc_instant("completed_at"))
    weeks = done.withWatermark("_time", delay).groupBy(F.window("_time", "7 days").alias("week"), "feed_id")
    return weeks.agg(F.count("*").alias("n")).select(
        utc_wall_clock(F.col("week.start")).alias("week_start"), "feed_id", "n"
    )
