"""Many small files as few packs: contents one after another, with an index of names, places and lengths, written whole or not at all.

Every write has a folder of its own below the path. Its tasks write packs and their indexes there; the last step of a write is one file,
``_commit-<write>.json``, which lists the packs that count, put in its place by a rename. Readers see listed packs only. What a killed or
repeated task left in the folder is deleted then, and a write that fails deletes its folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..storage import store_of

FORMAT = "packs"
COMMITS = "_commit-"
INDEX = pa.schema([("name", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
#: Bytes after which a task begins its next pack.
PACK_BYTES = 64 << 20


@dataclass
class Packs(WriterCommitMessage):
    """The packs of one task: path below the write's folder, bytes, items."""

    files: list[tuple[str, int, int]]


class PackWriter(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str, limit: int):
        self.path, self.suffix, self.limit = path, suffix, limit
        self.write_id = uuid.uuid4().hex

    @property
    def folder(self) -> str:
        return f"{store_of(self.path)[1]}/{self.write_id}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Packs:
        store, folder = store_of(self.path)[0], self.folder
        store.create_dir(folder, recursive=True)
        begun, done, out, index, size = [], [], None, [], 0

        def close() -> None:
            nonlocal out
            out.close()
            with store.open_output_stream(f"{folder}/{begun[-1]}.index", compression=None) as sink, pa.ipc.new_stream(sink, INDEX) as stream:
                stream.write(pa.RecordBatch.from_arrays([pa.array([r[i] for r in index], f.type) for i, f in enumerate(INDEX)], schema=INDEX))
            done.append((begun[-1], size, len(index)))
            out = None

        try:
            for batch in iterator:
                for name, content in zip(batch.column(0), batch.column(1)):
                    if not content.is_valid:
                        continue
                    if out is None:
                        begun.append(f"{uuid.uuid4().hex}{self.suffix}")
                        out, index, size = store.open_output_stream(f"{folder}/{begun[-1]}", compression=None), [], 0
                    data = content.as_buffer()
                    out.write(data)
                    index.append((name.as_py(), size, len(data)))
                    size += len(data)
                    if size >= self.limit:
                        close()
            if out is not None:
                close()
        except BaseException:
            if out is not None:
                out.close()
            for file in begun:
                _delete(store, f"{folder}/{file}", f"{folder}/{file}.index")
            raise
        return Packs(done)

    def commit(self, messages: list[Packs | None]) -> None:
        store, root = store_of(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        kept = {name for f, _, _ in files for name in (f, f"{f}.index")}
        store.create_dir(self.folder, recursive=True)
        for info in store.get_file_info(FileSelector(self.folder)):
            if info.base_name not in kept:
                _delete(store, info.path)
        listed = json.dumps([[f"{self.write_id}/{f}", size, items] for f, size, items in files])
        with store.open_output_stream(f"{self.folder}/commit") as out:
            out.write(listed.encode())
        store.move(f"{self.folder}/commit", f"{root}/{COMMITS}{self.write_id}.json")

    def abort(self, messages: list[Packs | None]) -> None:
        store = store_of(self.path)[0]
        if store.get_file_info(self.folder).is_file is False and store.get_file_info(self.folder).type.name != "NotFound":
            store.delete_dir(self.folder)


def _delete(store, *paths: str) -> None:
    for path in paths:
        if store.get_file_info(path).type.name != "NotFound":
            store.delete_file(path)


class PackSink(DataSource):
    """``df.write.format("packs").mode("append")``: rows ``(name, content)`` into packs with the option ``suffix``, cut after ``bytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> PackWriter:
        if overwrite:
            raise ValueError("packs are added, never replaced: write to a new path")
        return PackWriter(self.options["path"], self.options.get("suffix", ".pack"), int(self.options.get("bytes", PACK_BYTES)))


def write_packs(rows: DataFrame, path: str, name: str = "name", content: str = "content", suffix: str = ".pack", pack_bytes: int = PACK_BYTES) -> None:
    """Add the rows' contents (text as UTF-8) to the packs at ``path``; rows without content are left out."""
    rows.sparkSession.dataSource.register(PackSink)
    items = rows.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))
    items.write.format(FORMAT).mode("append").options(suffix=suffix, bytes=pack_bytes).save(path)
