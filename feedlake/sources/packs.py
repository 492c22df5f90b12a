"""Readers of the packs that ``sinks.packs`` writes, through their indexes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..sinks.packs import COMMITS
from ..storage import store_of

FORMAT = "packed_items"
#: Bytes of content that are given out in one batch, unless one item alone is larger; and packs that share a task when they are small.
BATCH_BYTES, TASK_BYTES = 4 << 20, 64 << 20


def listed_packs(path: str) -> list[tuple[str, int, int]]:
    """Path, bytes and items of every pack of a committed write, in a fixed order. One row per pack, not per item."""
    store, root = store_of(path)
    found = []
    for info in store.get_file_info(FileSelector(root)):
        if info.base_name.startswith(COMMITS):
            with store.open_input_stream(info.path) as f:
                found += [(f"{root}/{file}", size, items) for file, size, items in json.loads(f.read())]
    return sorted(found)


@dataclass
class PackRange(InputPartition):
    packs: list[str]


class PackReader(DataSourceReader):
    def __init__(self, path: str, with_content: bool):
        self.path, self.with_content = path, with_content

    def partitions(self) -> list[PackRange]:
        groups, size = [[]], 0
        for file, length, _ in listed_packs(self.path):
            if groups[-1] and size + length > TASK_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(file)
            size += length
        return [PackRange(g) for g in groups]

    def read(self, partition: PackRange) -> Iterator[pa.RecordBatch]:
        store = store_of(self.path)[0]
        for file in partition.packs:
            with store.open_input_stream(f"{file}.index", compression=None) as f, pa.ipc.open_stream(f) as stream:
                index = stream.read_all()
            if not self.with_content:
                for batch in index.to_batches(max_chunksize=50_000):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([file] * batch.num_rows, pa.string())], ["name", "offset", "length", "pack"])
                continue
            with store.open_input_stream(file, compression=None) as f:
                rows, size = [], 0
                for name, offset, length in zip(*[c.to_pylist() for c in index.columns]):
                    rows.append((name, offset, length, file, f.read(length)))
                    size += length
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["name", "offset", "length", "pack", "content"])


class PackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    @property
    def with_content(self) -> bool:
        return self.options.get("content", "true") == "true"

    def schema(self) -> str:
        return "name string, offset long, length long, pack string" + (", content binary" if self.with_content else "")

    def reader(self, schema) -> PackReader:
        return PackReader(self.options["path"], self.with_content)


def read_packs(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """``name``, ``offset``, ``length``, ``pack`` and, unless only the indexes are wanted, ``content`` of every packed item."""
    spark.dataSource.register(PackSource)
    return spark.read.format(FORMAT).option("content", str(content).lower()).load(path)


def read_transcript_packs(spark: SparkSession, path: str, kind: str = "raw") -> DataFrame:
    """Packed files ``{id}_{kind}.txt`` as rows ``(episode_id, kind, text)``; other names are left out, empty files are not."""
    name = F.regexp_extract("name", rf"^([0-9]+)_{kind}\.txt$", 1).try_cast("bigint")
    return read_packs(spark, path).select(name.alias("episode_id"), F.lit(kind).alias("kind"), F.col("content").cast("string").alias("text")).filter("episode_id IS NOT NULL")


def packed_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, pack and size of every packed file, from the indexes alone."""
    return read_packs(spark, path, content=False).select(F.col("name").alias("file_name"), F.col("pack").alias("path"), "length", "offset")
