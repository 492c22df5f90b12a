"""Streams against their batch forms, also over several batches and restarts."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from feedlake.schemas import TABLES
from feedlake.storage import shared_dir
from feedlake.streaming import streams
from workload import pipelines
from workload.views import Tables

from .test_feeds import RSS, item

AS_OF = datetime(2024, 3, 10)


def payload(spark, folder, rows):
    spark.createDataFrame(rows, "payload_no bigint, url string, xml string").coalesce(1).write.mode("append").parquet(folder)


def test_sync_goes_on_after_a_restart(spark, tmp_path):
    feeds = spark.createDataFrame([(1, "A", "ua", True, None, None), (2, "B", "ub", True, None, None)], TABLES["feeds"])
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run():
        arriving = spark.readStream.schema("payload_no bigint, url string, xml string").parquet(folder)
        streams.sync_stream(arriving, feeds, out, checkpoint, AS_OF, 30).awaitTermination()
        return {(r.feed_id, r.guid) for r in streams.stored_episodes(spark, out).collect()}

    payload(spark, folder, [(0, "ua", RSS.format(items=item("a") + item("b"))), (1, "ub", RSS.format(items=item("b") + item("c")))])
    assert run() == {(1, "a"), (1, "b"), (2, "c")}
    assert run() == {(1, "a"), (1, "b"), (2, "c")}
    payload(spark, folder, [(2, "ub", RSS.format(items=item("a") + item("d") + item("old", date="Mon, 1 Jan 2024 10:00:00 GMT"))),
                            (3, "ub", RSS.format(items=item("d"))), (4, "ux", RSS.format(items=item("e")))])
    assert run() == {(1, "a"), (1, "b"), (2, "c"), (2, "d")}
    stored = streams.stored_episodes(spark, out)
    assert stored.count() == 4 and stored.select("id").distinct().count() == 4


def test_sync_with_consecutive_ids(spark, tmp_path):
    feeds = spark.createDataFrame([(1, "A", "ua", True, None, None)], TABLES["feeds"])
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(2):
        payload(spark, folder, [(n, "ua", RSS.format(items=item(f"a{n}") + item(f"b{n}") + item("same")))])
        arriving = spark.readStream.schema("payload_no bigint, url string, xml string").parquet(folder)
        streams.sync_stream(arriving, feeds, out, str(tmp_path / "c"), AS_OF, 30, ids="sequence").awaitTermination()
    rows = streams.stored_episodes(spark, out).orderBy("id").collect()
    assert [(r.id, r.guid) for r in rows] == [(1, "a0"), (2, "b0"), (3, "same"), (4, "a1"), (5, "b1")]


def log_files(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, TABLES["processing_logs"]).coalesce(1).write.mode("append").parquet(folder)


def test_live_status_over_batches(spark, tmp_path):
    day = [datetime(2024, 1, d) for d in range(1, 6)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    log_files(spark, folder, [
        [(1, 1, "download", "started", None, day[0]), (2, 2, "download", "started", None, day[0])],
        [(3, 1, "download", "success", None, day[2]), (4, 1, "clean", "started", None, day[3])],
        [(5, 1, "download", "error", None, day[1])],
    ])
    logs = spark.readStream.schema(TABLES["processing_logs"]).option("maxFilesPerTrigger", 1).parquet(folder)
    streams.write_batches(streams.live_status(logs), out, str(tmp_path / "c"), mode="update").awaitTermination()
    updates = spark.read.parquet(out)
    assert updates.select("batch_id").distinct().count() >= 2
    now = {r.episode_id: (r.stage, r.status, r.at) for r in streams.newest_batch(updates, "episode_id").collect()}
    assert now == {1: ("clean", "started", day[3]), 2: ("download", "started", day[0])}


@pytest.mark.parametrize("salts", [0, 4])
def test_repeats_and_late_rows(spark, tmp_path, salts):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "guid string, published_date timestamp_ntz"
    for rows in ([("a", datetime(2024, 3, 1))] * 50 + [("a", datetime(2024, 3, 2)), ("b", datetime(2024, 3, 20))],
                 [("a", datetime(2024, 3, 3)), ("c", datetime(2024, 3, 21))],
                 [("late", datetime(2024, 1, 1)), ("b", datetime(2024, 3, 22))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    streams.write_batches(streams.without_repeats(stream, salts=salts), out, str(tmp_path / "c")).awaitTermination()
    assert sorted(r.guid for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_weeks_close_with_the_watermark(spark, tmp_path, zone):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "feed_id bigint, status string, completed_at timestamp_ntz"
    first = datetime(2024, 2, 29)  # a Thursday, as weeks begin
    rows = [(1, "completed", first), (1, "completed", datetime(2024, 3, 6, 23)), (2, "completed", first), (1, "failed", first),
            (1, "completed", datetime(2024, 3, 9))]
    spark.createDataFrame(rows, schema).write.parquet(folder)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        streams.write_batches(streams.weekly_completions(spark.readStream.schema(schema).parquet(folder)), out, str(tmp_path / "c")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {(r.week_start, r.feed_id, r.n) for r in spark.read.parquet(out).collect()} == {(first, 1, 2), (first, 2, 1)}


def test_nothing_stored_yet(spark, tmp_path):
    rows = streams.stored_episodes(spark, str(tmp_path / "none"))
    assert rows.count() == 0 and "batch_id" in rows.columns
    assert rows.filter(F.col("guid") == "x").count() == 0


def test_item_steps_over_late_rows(spark, tmp_path):
    """Steps in the order of time, whatever the order of arrival; illegal rows change nothing; an item that stands still is reported once."""
    at = lambda h, m=0: datetime(2024, 1, 1 + h // 24, h % 24, m)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    log_files(spark, folder, [
        [(2, 1, "transcribe", "started", None, at(1, 30)), (20, 2, "download", "started", None, at(0)), (90, 9, "process", "warning", None, at(1))],
        [(1, 1, "download", "started", None, at(1)), (3, 1, "download", "started", None, at(1, 45)), (4, 1, "clean", "error", None, at(2))],
        [(5, 1, "download", "started", None, at(30)), (91, 9, "process", "error", None, at(31))],
        [(92, 9, "download", "started", None, at(60))],
    ])
    logs = spark.readStream.schema(TABLES["processing_logs"]).option("maxFilesPerTrigger", 1).parquet(folder)
    streams.write_batches(streams.item_steps(logs, "2 hours", "10 hours"), out, str(tmp_path / "c")).awaitTermination()
    rows = {(r.episode_id, r.id, r.state, r.kind, r.at) for r in spark.read.parquet(out).collect()}
    assert rows == {
        (1, 1, "downloading", "step", at(1)), (1, 2, "transcribing", "step", at(1, 30)), (1, 3, "downloading", "illegal", at(1, 45)), (1, 4, "failed", "step", at(2)),
        (1, 5, "downloading", "step", at(30)), (1, 5, "downloading", "stale", at(40)), (2, 20, "downloading", "step", at(0)), (2, 20, "downloading", "stale", at(10)),
        (9, 91, "failed", "step", at(31)),
    }


def _state_rows(spark, tmp_path, make):
    """The most state rows that 400 items of three hours leave, and the rows given out."""
    day = datetime(2024, 1, 1)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    log_files(spark, folder, [[(1000 * h + i, i, "download", "started" if h % 2 == 0 else "success", None, day.replace(hour=h)) for i in range(400)] for h in range(3)])
    logs = spark.readStream.schema(TABLES["processing_logs"]).option("maxFilesPerTrigger", 1).parquet(folder)
    query = streams.write_batches(make(logs), out, str(tmp_path / "c"))
    query.awaitTermination()
    return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]), spark.read.parquet(out)


def test_stage_runs_share_groups(spark, tmp_path):
    """A group is called once a batch, at a price of its own: their number does not grow with the items."""
    most, runs = _state_rows(spark, tmp_path, lambda logs: streams.stage_runs(logs, "1 hour", "1 day"))
    assert most <= streams.GROUPS < 400
    assert sorted((r.id, r.episode_id, r.result, r.seconds) for r in runs.collect()) == [(i, i, "success", 3600) for i in range(400)]


def test_item_steps_share_groups(spark, tmp_path):
    most, steps = _state_rows(spark, tmp_path, lambda logs: streams.item_steps(logs, "1 hour", "1 day"))
    assert most <= streams.GROUPS < 400
    assert sorted((r.episode_id, r.id, r.state, r.kind) for r in steps.collect()) == [(i, i, "downloading", "step") for i in range(400)]


@pytest.mark.parametrize("n, files", [(960, 8), (40, 1)])
def test_late_logs_are_written_by_many_tasks(spark, tmp_path, n, files):
    """A part of the log stream is a file per task, since a single one would be one task of the write and of the read, and it is taken up whole."""
    rows = [(i, datetime(2024, 1, 1) + timedelta(days=i / n), i % 7, "view", 1.0, '{"k": 1}') for i in range(n)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    events.write.parquet(str(tmp_path / "events.parquet"))
    root = Path(shared_dir(spark).removeprefix("file:"))
    before = set(root.glob("logs-*"))
    streams.write_batches(pipelines.late_logs(Tables(spark, str(tmp_path))), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    (folder,) = set(root.glob("logs-*")) - before
    assert len(list(folder.glob("*.parquet"))) == 4 * files
    late = spark.read.parquet(str(tmp_path / "out")).withColumn("at", F.unix_seconds(F.col("timestamp").cast("timestamp")) + F.col("id") % 2 * 3600)
    parts = late.groupBy("batch_id").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n")).orderBy("batch_id").collect()
    assert len(parts) == 4 and sum(p.n for p in parts) == n
    assert all(a.high <= b.low for a, b in zip(parts, parts[1:]))


def test_sync_batches_are_dealt_out(spark, tmp_path, monkeypatch):
    """The documents of one file are parsed by many tasks."""
    feeds = spark.createDataFrame([(1, "A", "ua", True, None, None)], TABLES["feeds"])
    folder, out, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    numbers = [r.id for r in spark.range(1000).filter("pmod(hash(id), 8) = 3").collect()]  # as in a file of rows that were dealt out by their number
    payload(spark, folder, [(n, "ua", RSS.format(items=item(f"a{i % 50}"))) for i, n in enumerate(numbers)])
    plain = streams.incoming_items

    def counted(fetched, *rest):
        seen.append(fetched.select(F.spark_partition_id()).distinct().count())
        return plain(fetched, *rest)

    monkeypatch.setattr(streams, "incoming_items", counted)
    arriving = spark.readStream.schema("payload_no bigint, url string, xml string").parquet(folder)
    streams.sync_stream(arriving, feeds, out, str(tmp_path / "c"), AS_OF, 30).awaitTermination()
    assert seen == [8]
    assert sorted(r.guid for r in streams.stored_episodes(spark, out).collect()) == sorted(f"a{n}" for n in range(50))
