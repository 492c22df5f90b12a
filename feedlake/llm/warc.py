"""Web archives: writing WARC files, and a reader that salvages what it can from damaged ones.

``write_archive`` puts records as gzip members, one per record, into archives of bounded size (``sinks.packs``: a write counts whole or not
at all). ``read_archive`` reads archives, compressed or plain, one task per file, record after record with bounded memory. Every record is
checked: the member's checksum, the version line, the header, the length, the end of the block, and the SHA-1 digests of block and
payload. After a failed check the reader looks for the next place where a valid record begins (a gzip member or a version line),
goes on from there, and logs the bytes between as a gap with the reason: ``kind`` is ``record`` or ``gap``. So a damaged record costs itself only.

In plain archives the place after a damaged record is found by the next version line; a page that itself quotes a whole valid record may give
that record then. Records larger than memory cannot be read.

``page_records`` makes records of pages. Of pages with the same payload of at least ``LEAST`` bytes, the one with the largest id
is a response and the others are revisits without a payload, which carry the header of the response with its length and the digest; a
page without an id comes before all others, and rows that share the largest id are all responses. Smaller payloads are always responses.
Null payloads are empty, null addresses are left out of the header, repeated rows give equal records, empty tables give no archives.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..sinks.packs import write_packs
from ..sources.packs import listed_packs
from ..storage import materialize, store_of

#: Shortest payload for which a revisit is written.
LEAST = 1000
#: Bytes read at a time, and the longest header of a record.
STEP, LONGEST_HEADER = 1 << 20, 1 << 16
# Fixed values of the file format.
VERSION, MEMBER = b"WARC/1.", b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("type string, record_id string, refers_to_id string, uri string, date string, page_id long, refers_to long, payload binary, "
          "payload_digest string, payload_bytes long")
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


# --- writing ------------------------------------------------------------------------------------------------------------------


def page_records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """``page_id``, ``uri``, ``payload``, ``sha1``, ``bytes``, and for revisits ``refers_to`` and ``refers_uri`` and no payload.

    The pages that become revisits are found on narrow rows. Then every page meets that table by digest and id, so that many
    copies of one page do not meet in one task.
    """
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(uri).cast("string").alias("uri"), body.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    narrow = rows.select("page_id", "uri", "sha1", "bytes").filter(F.col("bytes") >= LEAST)
    order = F.struct(F.col("page_id").isNotNull(), "page_id", "uri")
    same = ["sha1", "bytes"]
    last = narrow.groupBy(*same).agg(F.max_by(F.struct("page_id", "uri"), order).alias("last"), F.count("*").alias("n")).filter("n > 1")
    later = narrow.join(last, same).filter(~F.col("page_id").eqNullSafe(F.col("last.page_id")))
    revisits = materialize(later.select(
        "page_id", "uri", *same, F.col("last.page_id").alias("refers_to"), F.col("last.uri").alias("refers_uri")))
    losers = revisits.select(F.col("page_id").alias("l_id"), F.col("sha1").alias("l_sha1"), F.col("bytes").alias("l_bytes")).distinct()
    met = F.col("page_id").eqNullSafe(F.col("l_id")) & (F.col("sha1") == F.col("l_sha1")) & (F.col("bytes") == F.col("l_bytes"))
    return rows.join(losers, met, "left_anti").unionByName(revisits, allowMissingColumns=True)


def _name(page: int | None, digest: str, kind: str) -> str:
    """A record id that is the same whenever the record is written."""
    raw = hashlib.md5(f"{page}|{digest}|{kind}".encode()).hexdigest()
    return f"<urn:uuid:{raw[:8]}-{raw[8:12]}-{raw[12:16]}-{raw[16:20]}-{raw[20:]}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page: int | None, uri: str | None, payload: bytes | None, sha1: str, size: int, refers_to: int | None, refers_uri: str | None, date: str) -> bytes:
    """One record, not compressed."""
    kind = "response" if payload is not None else "revisit"
    block = _HTTP.format(size).encode() + (payload or b"")
    clean = lambda text: re.sub(r"[\r\n]+", " ", text)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page, sha1, kind)}", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {clean(uri)}"] if uri is not None else []
    lines += [f"WARC-Page-Id: {page}"] if page is not None else []
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to, sha1, 'response')}", f"WARC-Refers-To-Date: {date}", f"WARC-Refers-To-Page-Id: {refers_to}"]
        lines += [f"WARC-Refers-To-Target-URI: {clean(refers_uri)}"] if refers_uri is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", f"WARC-Block-Digest: {_sha1(block)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 64 << 20) -> None:
    """Write the rows of ``page_records`` as ``.warc.gz`` archives below ``path``."""

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                members = []
                for r in part.to_pylist():
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    members.append(packer.compress(record_bytes(**r, date=date)) + packer.flush())
                yield pa.RecordBatch.from_arrays([pa.array([""] * len(members)), pa.array(members, pa.binary())], ["name", "content"])

    columns = records.select(F.col("page_id").alias("page"), "uri", "payload", "sha1", F.col("bytes").alias("size"), "refers_to", "refers_uri")
    write_packs(columns.mapInArrow(compressed, "name string, content binary"), path, suffix=".warc.gz", pack_bytes=archive_bytes)


# --- reading ------------------------------------------------------------------------------------------------------------------


class Damaged(Exception):
    """A check that failed."""


class Window:
    """A stream of bytes of which a part is held: ``take`` looks ahead from a place, ``drop`` lets go of what lies before one."""

    def __init__(self, read):
        self.read, self.held, self.start, self.ended = read, bytearray(), 0, False

    def reach(self, end: int) -> bool:
        """Hold the bytes before ``end``, if there are so many."""
        while not self.ended and self.start + len(self.held) < end:
            more = self.read(max(STEP, end - self.start - len(self.held)))
            self.ended = not more
            self.held += more
        return self.start + len(self.held) >= end

    def take(self, at: int, n: int) -> bytes:
        self.reach(at + n)
        return bytes(self.held[at - self.start : at - self.start + n])

    def drop(self, before: int) -> None:
        if before - self.start >= STEP:
            del self.held[: before - self.start]
            self.start = before

    def next_start(self, at: int) -> int | None:
        """The next place from ``at`` on where a record may begin."""
        while True:
            self.reach(at + STEP)
            found = [i for i in (self.held.find(m, at - self.start) for m in (MEMBER, VERSION)) if i >= 0]
            if found:
                return self.start + min(found)
            if self.ended:
                return None
            at = self.start + len(self.held) - len(VERSION)


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[0-9]", lines[0]):
        raise Damaged("version line")
    found = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line")
        found[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "content-length"):
        if name not in found:
            raise Damaged(f"no {name}")
    if not found["content-length"].isdecimal():
        raise Damaged("content-length")
    return found


def _same_digest(stated: str | None, data: bytes, what: str) -> None:
    """Check a SHA-1 in base 32 or hex; other algorithms are not checked."""
    if stated and stated.lower().startswith("sha1:"):
        digest, value = hashlib.sha1(data), stated[5:]
        if value.upper() != base64.b32encode(digest.digest()).decode() and value.lower() != digest.hexdigest():
            raise Damaged(f"{what} digest")


def _hex(stated: str | None) -> str | None:
    value = (stated or "")[5:]
    if re.fullmatch("[A-Z2-7]{32}", value):
        return base64.b32decode(value).hex()
    return value.lower() if re.fullmatch("[0-9a-fA-F]{40}", value) else None


def _record(headers: dict[str, str], block: bytes) -> dict:
    """Check a record's digests and take it apart."""
    _same_digest(headers.get("warc-block-digest"), block, "block")
    http, payload, size = {}, block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        head, found, payload = block.partition(b"\r\n\r\n")
        if not found:
            raise Damaged("http header")
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
        size = len(payload)
    number = lambda text: int(text) if text and re.fullmatch("-?[0-9]{1,18}", text) else None
    digest = _hex(headers.get("warc-payload-digest"))
    if headers["warc-type"] == "revisit":
        payload, size = None, number(http.get("content-length"))
    else:
        _same_digest(headers.get("warc-payload-digest"), payload, "payload")
        digest = hashlib.sha1(payload).hexdigest()
    return dict(
        type=headers["warc-type"], record_id=headers["warc-record-id"], refers_to_id=headers.get("warc-refers-to"), uri=headers.get("warc-target-uri"),
        date=headers.get("warc-date"), page_id=number(headers.get("warc-page-id")), refers_to=number(headers.get("warc-refers-to-page-id")), payload=payload,
        payload_digest=digest, payload_bytes=size)


def _plain(window: Window, at: int) -> tuple[dict, int]:
    """The record that begins at a place, and where it ends."""
    size = 1 << 10
    while (end := (head := window.take(at, size)).find(b"\r\n\r\n")) < 0:
        if len(head) < size or size >= LONGEST_HEADER:
            raise Damaged("header without end")
        size *= 2
    headers = _headers(head[:end])
    length = int(headers["content-length"])
    block = window.take(at + end + 4, length + 4)
    if len(block) < length + 4 or block[length:] != b"\r\n\r\n":
        raise Damaged("end of block")
    return _record(headers, block[:length]), at + end + 8 + length


def _member(window: Window, at: int) -> tuple[list[dict], int]:
    """The records of the gzip member that begins at a place, and where it ends. Its checksum has to be right."""
    unpacker, data, here = zlib.decompressobj(31), [], at
    while not unpacker.eof:
        raw = window.take(here, 1 << 16)
        if not raw:
            raise Damaged("member without end")
        try:
            data.append(unpacker.decompress(raw))
        except zlib.error as e:
            raise Damaged("member") from e
        here += len(raw) - len(unpacker.unused_data)
    inner = Window(io.BytesIO(b"".join(data)).read)
    found, place = [], 0
    while inner.take(place, 1):
        record, place = _plain(inner, place)
        found.append(record)
    if not found:
        raise Damaged("empty member")
    return found, here


def salvage(read) -> Iterator[tuple[str, int, int, dict | str]]:
    """Records and gaps of a stream in order: ``("record", offset, length, fields)`` or ``("gap", offset, length, reason)``."""
    window, at = Window(read), 0
    gap: tuple[int, str] | None = None
    while window.take(at, 1):
        try:
            head = window.take(at, len(VERSION))
            if head.startswith(MEMBER):
                records, end = _member(window, at)
            elif head == VERSION:
                record, end = _plain(window, at)
                records = [record]
            else:
                raise Damaged("no record begins here")
        except Damaged as e:
            gap = gap or (at, str(e))
            following = window.next_start(at + 1)
            if following is None:
                window.reach(1 << 62)
                at = window.start + len(window.held)
                break
            at = following
            # The bytes of a gap are never needed again.
            window.drop(at)
            continue
        if gap:
            yield "gap", gap[0], at - gap[0], gap[1]
            gap = None
        for record in records:
            yield "record", at, end - at, record
        at = end
        window.drop(at)
    if gap:
        yield "gap", gap[0], at - gap[0], gap[1]


@dataclass
class Archive(InputPartition):
    file: str


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload = path, with_payload

    def partitions(self) -> list[Archive]:
        store, root = store_of(self.path)
        files = [f for f, _, _ in listed_packs(self.path)]
        if not files:  # a folder of archives from elsewhere
            found = store.get_file_info(FileSelector(root, recursive=True))
            files = sorted(i.path for i in found if i.type == FileType.File and re.search(r"\.warc(\.gz)?$", i.path))
        return [Archive(f) for f in files] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        fields = [pa.field("kind", pa.string()), pa.field("file", pa.string()), pa.field("offset", pa.int64()), pa.field("length", pa.int64()), pa.field("reason", pa.string())]
        fields += [pa.field(n, kinds[x.split()[1]]) for n, x in zip(names, RECORD.split(", "))]
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, pa.schema(fields))

        with store_of(self.path)[0].open_input_stream(partition.file, compression=None) as f:
            for kind, offset, length, what in salvage(f.read):
                row = dict(kind=kind, file=partition.file, offset=offset, length=length, reason=what if kind == "gap" else None)
                if kind == "record":
                    row |= what
                    size += len(what["payload"] or b"")
                    if not self.with_payload:
                        row["payload"] = None
                rows.append(row)
                if size >= 4 << 20 or len(rows) >= 2000:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return f"kind string, file string, offset long, length long, reason string, {RECORD}"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("payload", "true") == "true")


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records and gaps of the archives below ``path``; without ``payload`` the payloads are checked but not given out."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
