"""Table updates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from feedlake.operators import aggregates, checks, joins, state
from feedlake.schemas import TABLES

T0 = datetime(2024, 3, 5)


def table(spark, name, rows=()):
    return spark.createDataFrame(list(rows), TABLES[name])


def status_row(episode_id, status, error=None, **more):
    names = [c.strip().split(" ")[0] for c in TABLES["processing_status"].split(",")]
    values = {"episode_id": episode_id, "status": status, "error_message": error, **more}
    return tuple(values.get(n) for n in names)


def test_stats(spark):
    rows = [status_row(i, s) for i, s in enumerate(["completed", "completed", "failed", "pending", "cleaning"])]
    assert aggregates.processing_stats(table(spark, "processing_status", rows)).first() == (5, 2, 1, 1, 1)
    assert aggregates.processing_stats(table(spark, "processing_status")).first() == (0, None, None, None, None)


UPDATE = ("episode_id bigint, status string, error_message string, audio_path string, raw_transcript_path string, "
          "cleaned_transcript_path string, summary_path string, at timestamp_ntz, seq int")


def test_status_updates_keep_what_is_not_given(spark):
    old = table(spark, "processing_status", [status_row(1, "pending", "old error", audio_path="a"), status_row(2, "pending"), status_row(3, "pending")])
    later = datetime(2024, 3, 6)
    updates = spark.createDataFrame([
        (1, "downloading", None, None, None, None, None, T0, 0),
        (1, "completed", "", None, None, None, "s", T0, 1),
        (2, "completed", None, None, None, None, None, T0, 2),
        (2, "failed", "broken", "p", None, None, None, later, 3),
        (2, "failed", None, None, None, None, None, later, 4),
        (9, "failed", "unknown item", None, None, None, None, T0, 5),
    ], UPDATE)
    rows = {r.episode_id: r for r in state.update_status(old, updates).collect()}
    assert set(rows) == {1, 2, 3}
    assert (rows[1].status, rows[1].error_message, rows[1].audio_path, rows[1].summary_path, rows[1].completed_at) == ("completed", "old error", "a", "s", T0)
    assert (rows[2].status, rows[2].error_message, rows[2].audio_path, rows[2].completed_at, rows[2].updated_at) == ("failed", "broken", "p", T0, later)
    assert (rows[3].status, rows[3].updated_at) == ("pending", None)


def test_transcript_saves(spark):
    old = table(spark, "transcripts", [(5, 1, "raw", "clean", "m", None, T0, T0)])
    later = datetime(2024, 3, 6)
    saves = spark.createDataFrame([
        (1, None, "", None, "c", later, 0), (2, "r2", None, "m2", None, T0, 1), (2, None, "c2", None, None, later, 2), (3, None, None, None, None, T0, 0),
    ], "episode_id bigint, raw_text string, cleaned_text string, transcription_model string, cleaning_model string, at timestamp_ntz, seq int")
    rows = sorted(tuple(r) for r in state.save_transcripts(old, saves).collect())
    assert rows == [
        (5, 1, "raw", "", "m", "c", T0, later),
        (6, 3, None, None, None, None, T0, T0),
        (7, 2, "r2", "c2", "m2", None, T0, later),
    ]


def test_summaries_keep_history(spark):
    fields = "episode_id bigint, host_and_guest string, comprehensive_summary string, key_topics string, actionable_quotes string, " \
             "investment_theses string, noteworthy_observations string, company_mentions string, model_used string"

    def save(table_, text, day):
        saved = spark.createDataFrame([(1, "h", text, None, None, None, None, None, "m")], fields)
        return state.append(table_, state.save_summaries(table_, saved, f"2024-01-0{day}"))

    twice = save(save(table(spark, "summaries"), "first", 1), "second", 2)
    assert [(r.id, r.comprehensive_summary) for r in twice.orderBy("id").collect()] == [(1, "first"), (2, "second")]
    assert state.latest_summaries(twice).first().comprehensive_summary == "second"


def test_queue(spark):
    day = [datetime(2024, 1, d) for d in (1, 2, 3, 4)]
    episodes = table(spark, "episodes", [(i, 1, f"t{i}", "", "u", d, None, f"g{i}", None) for i, d in enumerate([*day, None, day[1]])])
    states = ["pending", "failed", "completed", "cleaning", "pending", "pending"]
    status = table(spark, "processing_status", [status_row(i, s, updated_at=day[0]) for i, s in enumerate(states)])
    assert [r.id for r in joins.pending_queue(episodes, status).collect()] == [1, 5, 0, 4]
    assert [r.id for r in joins.pending_queue(episodes, status, 2).collect()] == [1, 5]
    assert [r.id for r in joins.pending_queue(episodes, status, stale_before=day[1]).collect()] == [3, 1, 5, 0, 4]
    assert [r.id for r in joins.listing(episodes, status, "pending").collect()] == [5, 0, 4]
    assert len(joins.run_queue(episodes, status).collect()) == 4


def test_digest_boundary(spark):
    feeds = table(spark, "feeds", [(1, "F", "u", True, None, None)])
    episodes = table(spark, "episodes", [(i, 1, "t", "", "u", None, None, f"g{i}", None) for i in range(3)])
    status = table(spark, "processing_status", [
        status_row(0, "completed", completed_at=datetime(2024, 3, 1)), status_row(1, "completed", completed_at=datetime(2024, 2, 29, 23, 59, 59)),
        status_row(2, "failed", completed_at=datetime(2024, 3, 2))])
    assert [r.id for r in joins.digest_base(episodes, feeds, status, datetime(2024, 3, 8)).collect()] == [0]


def test_checks_find_what_is_wrong(spark):
    feeds = table(spark, "feeds", [(1, "A", "u", True, None, None), (1, None, "u", True, None, None)])
    episodes = table(spark, "episodes", [(1, 1, "t", "", "a", None, None, "g", None), (2, 7, "t", "", "a", None, None, None, None),
                                         (3, 7, "t", "", "a", None, None, None, None)])
    status = table(spark, "processing_status", [status_row(1, "done"), status_row(8, "pending"), status_row(8, "pending")])
    found = {(r.table_name, r.rule): r.violations for r in
             checks.violations({"feeds": feeds, "episodes": episodes, "processing_status": status}).collect() if r.violations}
    assert found == {
        ("feeds", "id is unique"): 1, ("feeds", "name is set"): 1, ("feeds", "url is unique"): 1, ("episodes", "feed_id is in feeds"): 2,
        ("processing_status", "status in domain"): 1, ("processing_status", "episode_id is unique"): 1,
        ("processing_status", "episode_id is in episodes"): 2,
    }


def test_stamp(spark):
    feeds = table(spark, "feeds", [(1, "A", "u", True, None, None), (2, "B", "v", True, T0, None)])
    synced = spark.createDataFrame([(1,), (1,)], "id bigint")
    now = datetime(2024, 4, 1)
    assert {r.id: r.last_checked for r in state.stamp_checked(feeds, synced, now).collect()} == {1: now, 2: T0}


def test_small_batches_filter_the_stored_rows(spark):
    stored = spark.range(100).select(F.col("id").cast("string").alias("guid"), "id")
    batch = spark.createDataFrame([("5",), ("5",), ("x",)], "guid string")
    assert state.stored_matches(stored, batch, "guid").collect() == [("5", 5)]


def test_shared_ids(spark):
    a, b = spark.range(5), spark.createDataFrame([(4,), (7,), (7,)], "id long")
    assert {(r.id, r.n) for r in state.shared_ids(a, b).collect()} == {(4, 2), (7, 2)}
    assert state.shared_ids(a).count() == 0


def test_saved_summaries_are_numbered_without_their_texts(spark, monkeypatch):
    """Only the order goes through the sort; a row without it is numbered first."""
    names = [f.strip().split(" ")[0] for f in TABLES["summaries"].split(",")]
    stored = spark.createDataFrame([(4, 1)], "id bigint, episode_id bigint").select(*[F.col(n) if n in ("id", "episode_id") else F.lit(None).cast("string").alias(n) for n in names])
    texts = [n for n in names if n not in ("id", "episode_id", "created_at")]
    batch = spark.createDataFrame([(7, 2, 1), (5, None, 2), (7, 1, 3), (5, 3, None)], "episode_id bigint, part bigint, seq bigint").select(
        "*", *[F.lit(n).alias(n) for n in texts])
    plain, sorted_ = state.with_new_ids, []

    def recorded(df, *rest, **named):
        sorted_.append(df.columns)
        return plain(df, *rest, **named)

    monkeypatch.setattr(state, "with_new_ids", recorded)
    rows = state.save_summaries(stored, batch, "2024-01-01", ("episode_id", "part")).collect()
    assert sorted_ == [["episode_id", "part"]]
    assert sorted((r.id, r.episode_id) for r in rows) == [(5, 5), (6, 5), (7, 7), (8, 7)]
    assert all(r[n] == n for r in rows for n in texts)
