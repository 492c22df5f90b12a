"""Global order, hot keys and repeats, against plain Python."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedlake.operators import ordering, state


def skewed(spark, n=20_000):
    """A third of the rows in one group, all at the same time."""
    rng = random.Random(3)
    rows = [(1 if i % 3 == 0 else rng.randrange(2, 400), 0 if i % 3 == 0 else rng.randrange(1000), i) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k int, t int, id int")


def test_position(spark):
    df = skewed(spark)
    rows = ordering.with_position(df, F.col("t").desc(), "id", start=0).collect()
    wanted = sorted(df.collect(), key=lambda r: (-r.t, r.id))
    assert [(r.id, r.position) for r in sorted(rows, key=lambda r: r.position)] == [(r.id, i) for i, r in enumerate(wanted)]


def test_position_of_nothing_and_of_few(spark):
    assert ordering.with_position(spark.range(0), "id").count() == 0
    assert {(r.id, r.position) for r in ordering.with_position(spark.range(3), F.col("id").desc()).collect()} == {(0, 3), (1, 2), (2, 1)}


def test_slices_split_a_hot_key(spark):
    sizes = ordering.sliced(skewed(spark), "k", "t", "id").groupBy("_slice").count().collect()
    assert len(sizes) == 8
    assert max(r["count"] for r in sizes) < 20_000 / 8 * 1.5


def test_next_across_slices(spark):
    df = skewed(spark, 5000)
    window = Window.partitionBy("k").orderBy("t", "id")
    wanted = df.select("*", F.lead("t").over(window).alias("next_t"), F.lead("id").over(window).alias("next_id"))
    found = ordering.with_next(df, ["k"], ["t", "id"], ["t", "id"])
    assert found.columns == wanted.columns
    assert found.exceptAll(wanted).count() == 0 and found.count() == 5000


def test_next_with_missing_keys(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 2, 2), (1, 1, 3)], "k int, t int, id int")
    assert {(r.id, r.next_id) for r in ordering.with_next(df, ["k"], ["t", "id"], ["id"]).collect()} == {(1, 2), (2, None), (3, None)}


def test_first_and_latest(spark):
    df = skewed(spark, 6000)
    rows = df.collect()
    first, last = {}, {}
    for r in sorted(rows, key=lambda r: (r.t, r.id)):
        first.setdefault(r.k, r.id)
        last[r.k] = r.id
    assert {r.k: r.id for r in state.first_per_key(df, "k", "t", "id").collect()} == first
    assert {r.k: r.id for r in state.latest_per_key(df, "k", "t", "id").collect()} == last


def test_rows_without_a_key_stay(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4), ("n:1", 5)], "k string, id int")
    assert {r.id for r in state.first_per_key(df, "k", "id").collect()} == {1, 2, 3, 5}


def test_hash_ids_are_stable(spark):
    df = spark.range(1000).withColumn("x", state.hash_id("id"))
    assert df.select("x").distinct().count() == 1000
    assert df.exceptAll(df.repartition(5)).count() == 0


def test_newest(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 9)], "id int, d int")
    assert [r.id for r in ordering.newest(df, "d", "id").collect()] == [4, 2, 3, 1]
    assert [r.id for r in ordering.newest(df, "d", "id", 2).collect()] == [4, 2]
    assert ordering.newest(df, "d", "id", 0).count() == 4
