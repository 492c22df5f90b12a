"""What the plans look like: pruned and pushed-down scans, few shuffles, no cross joins, split hot keys."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from feedlake.functions import summaries as fs
from feedlake.functions import text as ft
from feedlake.operators import aggregates, digests, joins, state
from feedlake.sinks.tables import save_bucketed, write_version
from feedlake.sources import payloads
from feedlake.sources.tables import read_table
from workload import QUERIES
from workload.views import AS_OF, Tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Feeds, episodes and status as tables on disk."""
    folder = tmp_path_factory.mktemp("tables")
    t = Tables(spark, FOLDER)
    for name, df in (("feeds", t.feeds), ("episodes", t.episodes), ("processing_status", t.status), ("processing_logs", t.logs)):
        write_version(df, str(folder / name))
    return {n: read_table(spark, n, str(folder / n)) for n in ("feeds", "episodes", "processing_status", "processing_logs")}


def test_digest_base_pushes_and_prunes(stored):
    text = plan(joins.digest_base(stored["episodes"], stored["feeds"], stored["processing_status"], AS_OF))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(status,completed\)[^\]]*GreaterThanOrEqual\(completed_at", text)
    assert "ReadSchema: struct<id:bigint,name:string>" in text
    assert "ReadSchema: struct<id:bigint,feed_id:bigint,title:string,published_date:timestamp_ntz>" in text
    assert "ReadSchema: struct<episode_id:bigint,status:string,summary_path:string,completed_at:timestamp_ntz>" in text


def test_queue_pushes_its_states_and_takes_the_top(stored):
    text = plan(joins.pending_queue(stored["episodes"], stored["processing_status"], 10))
    assert "TakeOrderedAndProject" in text and "In(status, [failed,pending])" in text


def test_bucketed_tables_join_without_a_shuffle(spark, stored, tmp_path):
    for name, key in (("episodes", "id"), ("processing_status", "episode_id")):
        save_bucketed(stored[name], f"bucketed_{name}", str(tmp_path / name), key, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.pending_queue(spark.table("bucketed_episodes"), spark.table("bucketed_processing_status"), 5)
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        assert joined.collect() == joins.pending_queue(stored["episodes"], stored["processing_status"], 5).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("episodes", "processing_status"):
            spark.sql(f"DROP TABLE bucketed_{name}")


def test_partitioned_version_prunes(spark, stored, tmp_path):
    write_version(stored["processing_status"], str(tmp_path / "s"), partition_by=("status",), sort_by=("completed_at",))
    status = read_table(spark, "processing_status", str(tmp_path / "s"))
    text = plan(joins.digest_base(stored["episodes"], stored["feeds"], status, AS_OF, 200))
    assert re.search(r"PartitionFilters: \[[^\]]*status[^\]]*completed", text)
    found = joins.digest_base(stored["episodes"], stored["feeds"], status, AS_OF, 200)
    assert found.exceptAll(joins.digest_base(stored["episodes"], stored["feeds"], stored["processing_status"], AS_OF, 200)).count() == 0
    assert found.count() > 0


def test_flags_and_status_reach_the_scan(stored):
    assert "EqualTo(enabled,true)" in plan(joins.enabled_feeds(stored["feeds"]))
    assert "EqualTo(status,failed)" in plan(joins.with_status(stored["processing_status"], "failed"))


def test_stats_read_one_column(stored):
    assert "ReadSchema: struct<status:string>" in plan(aggregates.processing_stats(stored["processing_status"]))


def test_insert_shuffles_items_once(spark):
    """The repeats and the known guids share one shuffle by guid."""
    t = Tables(spark, FOLDER)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hashed = state.insert_items(t.known, t.items, None, AS_OF, ids="hash")
        text = plan(hashed)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left = text[:text.index("Exchange hashpartitioning(_key")] if "Exchange hashpartitioning(_key" in text else text
    assert len(re.findall(r"Exchange hashpartitioning\(_groupingexpression", text)) == 1
    assert "partial_min_by" in text and "SortMergeJoin" in left


@pytest.mark.parametrize("name", ["x12_chunks", "x11_markdown", "x18_decode", "x2_published_date"])
def test_row_work_stays_in_the_jvm_without_shuffle(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert not re.search(r"Python|Pandas|Arrow", text)
    # The only exchange allowed deals a small file out over the cores.
    assert text.count("Exchange") == text.count("REPARTITION_BY_NUM")


def test_feed_documents_leave_the_jvm_only_for_unusual_names(spark):
    """One call, given the documents that need it and NULL for the others, and no shuffle."""
    text = plan(QUERIES["s2_feed_items"](spark, FOLDER))
    call = text[text.index("ArrowEvalPython [") :]
    assert text.count("ArrowEvalPython [") == 1 and not re.search("mapIn|BatchEvalPython|InPandas|InArrow", text)
    assert "CASE WHEN RLIKE(xml" in call.replace("\n", " ") or re.search(r"CASE WHEN (RLIKE|xml)", call)
    assert text.count("Exchange") == text.count("REPARTITION_BY_NUM")


def test_names_are_joined_in_the_jvm(spark):
    text = plan(QUERIES["m4_rule_summary"](spark, FOLDER))
    assert not re.search(r"Python|Pandas|Arrow", text) and "Join" in text


def test_digest_reads_its_base_once(stored, spark):
    """Two joins make the base, one finds the latest versions, one fetches their texts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = joins.digest_base(stored["episodes"], stored["feeds"], stored["processing_status"], AS_OF, 200)
        text = plan(digests.with_summary(base, Tables(spark, FOLDER).summaries))
        assert len(re.findall(r"SortMergeJoin|ShuffledHashJoin", text)) == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_costly_values_are_made_once(spark):
    docs = spark.createDataFrame([("a", "b")], "xml string, text string")
    items = payloads.episode_items(payloads.raw_items(payloads.parsed(docs)))
    # The document, its items one by one if it is malformed, and the repaired document.
    assert plan(items).count("from_xml(") == 3
    assert plan(ft.explode_chunks(docs, "text")).count("split(") == 1
    assert plan(docs.select(fs.decode("text").alias("s")).select("s.host_and_guest", "s.key_topics")).count(".parseJson(") == 1


def test_no_query_has_a_cross_join(spark):
    bad = []
    for name, build in QUERIES.items():
        if name.startswith(("p2", "st", "k6")):  # built from the operators of the others
            continue
        text = plan(build(spark, FOLDER))
        if "CartesianProduct" in text or "BroadcastNestedLoopJoin" in text:
            bad.append(name)
    assert not bad


def test_a_hot_feed_is_split(spark):
    """Half of the items belong to one feed: adaptive execution splits that key when neither side can be broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        ids = spark.range(0, 60_000, numPartitions=8)
        episodes = ids.select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 500).cast("bigint").alias("feed_id"),
                              F.sha2(F.col("id").cast("string"), 256).alias("title"), F.lit(AS_OF).cast("timestamp_ntz").alias("published_date"))
        status = ids.select(F.col("id").alias("episode_id"), F.lit("completed").alias("status"), F.lit(AS_OF).cast("timestamp_ntz").alias("completed_at"),
                            F.lit("p").alias("summary_path"))
        feeds = spark.range(500).select("id", F.lit("f").alias("name"))
        base = joins.digest_base(episodes, feeds, status, AS_OF)
        assert len(base.collect()) == 60_000
        assert "skew=true" in plan(base)
    finally:
        for key in settings:
            spark.conf.unset(key)
