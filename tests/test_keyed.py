"""Tables that are merged on read, against the same batches applied to plain rows."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from feedlake import storage
from feedlake.operators import state
from feedlake.schemas import TABLES
from feedlake.sinks import keyed
from feedlake.sinks.keyed import KeyedTable

SCHEMA = "k string, a int, b string"


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_batches_against_plain_rows(spark, tmp_path):
    """Eight batches of changes and additions with compaction in between; a repeated batch does nothing."""
    rng = random.Random(4)
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", rows_per_bucket=20)
    plain = {f"k{i}": [i, f"b{i}"] for i in range(200)}
    table.create(spark.createDataFrame([(k, *v) for k, v in plain.items()], SCHEMA))
    assert table.versions()[0].buckets == 16
    for order in range(1, 9):
        changes = {f"k{rng.randrange(320)}": (rng.choice([None, rng.randrange(1000)]), rng.choice([None, "", f"n{order}"])) for _ in range(25)}
        insert = order % 2 == 0
        for k, (a, b) in changes.items():
            if k in plain:
                plain[k] = [plain[k][0] if a is None else a, plain[k][1] if b is None else b]
            elif insert:
                plain[k] = [a, b]
        batch = spark.createDataFrame([(k, *v) for k, v in changes.items()] + [(None, 1, "no key")], SCHEMA)
        for _ in range(2 if order == 3 else 1):
            table.apply(batch, order, (lambda unseen: unseen) if insert else None)
        if order > 4:
            table.compact()
    assert rows_of(table.read()) == sorted([(k, *v) for k, v in plain.items()], key=str)
    assert len(table.versions()) < 8
    keys = spark.createDataFrame([("k3",), ("k250",), ("none",), (None,)], "k string")
    assert rows_of(table.read(keys)) == sorted([(k, *plain[k]) for k in ("k3", "k250") if k in plain], key=str)
    table.vacuum()
    assert rows_of(table.read()) == sorted([(k, *v) for k, v in plain.items()], key=str)
    table.apply(batch, 8, None)
    assert rows_of(table.read()) == sorted([(k, *v) for k, v in plain.items()], key=str)


def test_only_touched_buckets_are_read(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", rows_per_bucket=50)
    table.create(spark.range(3200).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("a"), F.lit("b").alias("b")))
    assert table.versions()[0].buckets == 64
    two = spark.createDataFrame([("k5", 2, None), ("k77", 3, None)], SCHEMA)
    files = {f.rsplit("/", 2)[1] for f in table.read(two).inputFiles() if "/rows/" in f}
    assert 1 <= len(files) <= 2
    # Keys that are not stored: their buckets are there, but the filters exclude nearly all of them.
    absent = spark.range(64).select(F.concat(F.lit("x"), "id").alias("k"))
    assert len(table.candidate_files(absent)) <= 12
    assert table.known(absent).count() == 0 and table.known(two.unionByName(absent, allowMissingColumns=True)).count() == 2
    table.apply(two, 1)
    assert table.read().filter("a > 1").count() == 2 and table.read().count() == 3200
    assert [v.buckets for v in table.versions()] == [64, 1]
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan  # the base is not shuffled for a small batch


def test_growth_and_rows_without_keys(spark, tmp_path):
    """Bucket counts double as versions are joined; rows without a key are kept apart."""
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", rows_per_bucket=10)
    seen = []
    for order in range(1, 9):
        rows = [(f"{order}-{i}", i, "x") for i in range(40)] + [(None, order, "none")] * 2
        table.add(spark.createDataFrame(rows, SCHEMA), order)
        table.compact()
        seen.append(max(v.buckets for v in table.versions()))
    assert seen[0] == 8 and seen[-1] >= 32
    assert table.read().count() == 8 * 42 and table.read().filter("k IS NULL").count() == 16
    assert sum(v.rows for v in table.versions()) == 8 * 42
    with pytest.raises(ValueError):
        table.create(table.read())


def test_nothing_in_it(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k")
    some = spark.createDataFrame([("a", 1, "b")], SCHEMA)
    assert table.read().count() == 0 and table.read(some).count() == 0 and table.known(some).count() == 0 and not table.compact()
    table.apply(some, 1)
    table.add(some.limit(0), 2)
    assert table.read().count() == 0 and [v.rows for v in table.versions()] == [0, 0]
    table.apply(some, 3, lambda unseen: unseen)
    assert rows_of(table.read()) == [("a", 1, "b")]
    assert keyed._power(0) == 1 and keyed._power(17) == 32


def test_one_version_is_read_without_moving_it(spark, tmp_path):
    """A version has one row per key; two are merged."""
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k")
    for order in (1, 2):
        table.apply(spark.createDataFrame([("a", order, "x"), (f"b{order}", 1, "y")], SCHEMA), order, lambda unseen: unseen)
        plan = table.read()._jdf.queryExecution().executedPlan().toString()
        assert ("Aggregate" in plan) == (order == 2)
    assert rows_of(table.read()) == [("a", 2, "x"), ("b1", 1, "y"), ("b2", 1, "y")]


def test_numbering_new_transcripts_writes_keys_only(spark, tmp_path):
    """What is numbered is sorted and written; the texts are written as the batch and as the version."""
    table = KeyedTable(spark, str(tmp_path / "t"), TABLES["transcripts"], "episode_id")
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    saves = spark.range(50).select(F.col("id").alias("episode_id"), *[F.concat(F.lit("text "), F.col("id").cast("string")).alias(f) for f in state.TRANSCRIPT_FIELDS],
                                   at.alias("at"), F.lit(0).alias("seq"))
    folder = storage.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    state.take_transcripts(table, saves, 1)
    tables = [spark.read.parquet(f"{folder}/{n}").columns for n in set(os.listdir(folder)) - before if n.startswith("table-")]
    assert sum("raw_text" in columns for columns in tables) == 1
    found = table.read().orderBy("episode_id").collect()
    assert [(r.id, r.episode_id, r.raw_text) for r in found] == [(i + 1, i, f"text {i}") for i in range(50)]


def test_many_like_keys_do_not_pass_through_the_driver(spark, tmp_path):
    """Keys that are much alike make small files; a join of very many must not be a broadcast for that."""
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k")
    keys = spark.range(keyed.BROADCAST_ROWS + 1).select(F.concat(F.lit("https://feeds.example.com/"), F.col("id").cast("string")).alias("k"), F.lit(1).alias("a"), F.lit("b").alias("b"))
    table.create(keys)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(table.known(keys))
    table.apply(keys.withColumn("a", F.lit(2)), 1)
    assert "BroadcastHashJoin" not in plan(table.read()) and table.read().filter("a = 2").count() == keyed.BROADCAST_ROWS + 1
