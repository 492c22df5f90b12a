"""Files and tables on disk."""

from __future__ import annotations

from datetime import UTC, datetime

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from feedlake.schemas import TABLES
from feedlake.sinks import documents, tables
from feedlake.sinks.packs import PackWriter, write_packs
from feedlake.sources import files, packs
from feedlake.sources.tables import read_table
from workload.pipelines import item_packs
from workload.views import Tables


def test_transcript_files(spark, tmp_path):
    (tmp_path / "7_raw.txt").write_text("Zeile 1\nZeile ü", encoding="utf-8")
    (tmp_path / "8_cleaned.txt").write_text("clean", encoding="utf-8")
    (tmp_path / "notes_raw.txt").write_text("x")
    (tmp_path / "9_raw.txt").write_text("")
    rows = files.read_transcript_files(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == [(7, "raw", "Zeile 1\nZeile ü")]
    assert files.read_transcript_files(spark, str(tmp_path), "cleaned").collect() == [(8, "cleaned", "clean")]


def test_media(spark, tmp_path):
    for name, size in (("1_a_x.mp3", 10), ("2_b_y.opus", 20), ("2_b_y.m4a", 30), ("3_c_z.wav", 5), ("4_d.mp3", 7), ("4_d.webm", 8)):
        (tmp_path / name).write_bytes(b"0" * size)
    expected = spark.createDataFrame([(1, "1_a_x.mp3"), (2, "2_b_y.mp3"), (3, "3_c_z.mp3"), (4, "4_d.webm"), (5, "5.mp3")], "episode_id bigint, file_name string")
    inventory = files.media_inventory(spark, str(tmp_path))
    found = {r.episode_id: (r.path and r.path.rsplit("/", 1)[1], r.size) for r in files.located_media(expected, inventory).collect()}
    assert found == {1: ("1_a_x.mp3", 10), 2: ("2_b_y.m4a", 30), 3: (None, None), 4: ("4_d.webm", 8), 5: (None, None)}
    assert "content" not in inventory._jdf.queryExecution().executedPlan().toString()


def test_texts_by_item(spark, tmp_path):
    rows = spark.createDataFrame([(1, "raw", "a\nb"), (1, "cleaned", "c"), (2, "raw", "d\n")], "episode_id bigint, kind string, text string")
    documents.write_texts(rows, ["kind", "episode_id"], "text", str(tmp_path / "out"))
    back = files.read_item_texts(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in back.collect()} == {(1, "raw", "a\nb"), (1, "cleaned", "c"), (2, "raw", "d\n")}


def test_versions_are_not_overwritten(spark, tmp_path):
    path = str(tmp_path / "v1")
    feeds = spark.createDataFrame([(1, "A", "u", True, None, None)], TABLES["feeds"])
    tables.write_version(feeds, path)
    assert read_table(spark, "feeds", path).collect() == feeds.collect()
    with pytest.raises(AnalysisException):
        tables.write_version(feeds, path)


def test_log_append(spark, tmp_path):
    path = str(tmp_path / "log")
    event = spark.createDataFrame([(1, 1, "clean", "started", None)], "id bigint, episode_id bigint, stage string, status string, message string")
    before = datetime.now(UTC).replace(tzinfo=None, microsecond=0)
    tables.append_log(event, path)
    given = spark.createDataFrame([(2, 1, "clean", "success", "m", datetime(2024, 1, 1)), (3, 1, "clean", "error", None, None)], TABLES["processing_logs"])
    tables.append_log(given, path)
    rows = read_table(spark, "processing_logs", path).orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3]
    assert rows[1].timestamp == datetime(2024, 1, 1)
    assert rows[0].timestamp >= before and rows[2].timestamp >= before


def test_document_order(spark, tmp_path):
    parts = spark.range(0, 5000, numPartitions=7).selectExpr("1 AS part", "4999 - id AS position", "concat('line ', 4999 - id) AS text")
    documents.write_document(parts, str(tmp_path / "d"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "d").glob("part-*")))
    assert written.splitlines() == [f"line {i}" for i in range(5000)]


def test_all_items_are_packed(spark):
    """The file queries write and scan every row of the table."""
    names = [r.file_name for r in packs.packed_inventory(spark, item_packs(Tables(spark, "/root/testdata/sf0.001"))).collect()]
    assert len(names) == len(set(names)) == 200


PACKED = "name string, content string"


def test_packs(spark, tmp_path):
    """Several packs and writes, empty and missing contents, names twice; the inventory reads no content."""
    path = str(tmp_path / "packs")
    rows = [(f"{i}_raw.txt", "ü" * i + "\n") for i in range(50)] + [("1_cleaned.txt", "c"), ("x_raw.txt", "x"), ("99_raw.txt", ""), ("98_raw.txt", None)]
    table = spark.createDataFrame(rows, PACKED).repartition(3)
    write_packs(table, path, pack_bytes=200)
    write_packs(spark.createDataFrame([("1_cleaned.txt", "again")], PACKED), path)
    write_packs(table.limit(0), path)
    found = sorted((r.episode_id, r.text) for r in packs.read_transcript_packs(spark, path).collect())
    assert found == sorted([(i, "ü" * i + "\n") for i in range(50)] + [(99, "")])
    assert sorted(r.text for r in packs.read_transcript_packs(spark, path, "cleaned").collect()) == ["again", "c"]
    inventory = packs.packed_inventory(spark, path)
    assert inventory.count() == 54 and inventory.agg({"length": "sum"}).first()[0] == sum(len((t or "").encode()) for _, t in rows) + 5
    assert len(packs.listed_packs(path)) > 5
    assert sorted(len(b) for b in {r.path: None for r in inventory.collect()}) and "content" not in inventory.columns


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "packs")
    bad = F.when(F.col("id") == 900, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string"))
    with pytest.raises(Exception, match="broken"):
        write_packs(spark.range(1000).repartition(4).select(F.col("id").alias("name"), bad.alias("content")), path)
    assert [p for p in (tmp_path / "packs").rglob("*") if p.is_file()] == []
    write_packs(spark.range(10).select(F.col("id").alias("name"), F.lit("x").alias("content")), path)
    assert packs.read_packs(spark, path).count() == 10


def test_leftovers_of_killed_tasks_are_not_read(spark, tmp_path):
    """Files that no commit lists do not count, and the commit of their own write deletes them."""
    path = tmp_path / "packs"
    writer = PackWriter(str(path), ".pack", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array([b"1", b"2"])], ["name", "content"])
    kept = writer.write(iter([batch]))
    writer.write(iter([batch]))
    assert len([p for p in path.rglob("*.pack")]) == 2
    writer.commit([kept, None])
    assert len([p for p in path.rglob("*.pack")]) == 1 and len([p for p in path.rglob("*.index")]) == 1
    assert {(r.name, bytes(r.content)) for r in packs.read_packs(spark, str(path)).collect()} == {("a", b"1"), ("b", b"2")}


def test_item_files(spark, tmp_path):
    rows = spark.createDataFrame([("1_raw.txt", "a\nb"), ("2_raw.txt", "ü\n"), ("3_raw.txt", ""), ("4_raw.txt", None)], "file_name string, text string")
    for name, part, n in (("out", rows, 3), ("none", rows.filter("false"), 0)):
        folder = str(tmp_path / name)
        assert documents.write_item_files(part, folder) == n
        found = files.read_transcript_files(spark, f"{folder}/*")
        assert {tuple(r) for r in found.collect()} == {(1, "raw", "a\nb\n"), (2, "raw", "ü\n\n"), (3, "raw", "\n")} if n else found.count() == 0


def test_file_inventory_has_a_row_per_file(spark):
    from workload import QUERIES

    folder = "/root/testdata/sf0.001"
    found = QUERIES["s5_file_inventory"](spark, folder)
    assert found.count() == found.select("episode_id").distinct().count() == spark.read.parquet(f"{folder}/documents.parquet").count()
