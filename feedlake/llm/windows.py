"""Words, digests and minimisers of many texts at once, as arrays, for use inside tasks; and the packed strings that travel to buckets.

A minimiser of a window is the smallest digest of the grams in it. Neighbouring windows that share it form a run, which is packed as
one string (a super-k-mer) and sent to the bucket of its minimiser: equal windows have equal minimisers and meet there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
#: Bytes of text that are worked on at once (a longer document alone), and bytes of packed strings that a task gathers before it sends them.
CHUNK, FLUSH = 1 << 19, 16 << 20
#: Windows in one run at most; periodic texts would give runs without end.
LONGEST_RUN = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> U64(33))
    x = x * _MIX1
    x = x ^ (x >> U64(29))
    return x * _MIX2 ^ (x >> U64(32))


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo`` to ``hi`` with the bytes of their texts one after another, and where each text starts and the last ends."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK)
        inverse = pow(BASE, -1, 1 << 64)
        _POWERS[:] = [np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64))]) for b in (BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and its text."""
    inner = ~((data == 32) | ((data >= 9) & (data <= 13)))
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inner[:-1]]) if n else inner
    after = np.concatenate([inner[1:], [False]]) if n else inner
    starts = np.flatnonzero(inner & (~before | first[:n]))
    ends = np.flatnonzero(inner & (~after | first[1 : n + 1])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest per word, from running sums of powers."""
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)])])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def sequence_digests(digests: np.ndarray, length: int) -> np.ndarray:
    """Digest of each ``length`` neighbours."""
    n = len(digests) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _powers(len(digests) + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(digests * up[: len(digests)])])
    return mix((sums[length:] - sums[:n]) * down[:n])


def byte_grams(data: np.ndarray) -> np.ndarray:
    """Digest of each 24 neighbouring bytes."""
    n = len(data) - 23
    if n <= 0:
        return np.zeros(0, U64)
    eight = np.ndarray((n + 16,), "<u8", data.tobytes(), strides=(1,))
    return mix(eight[:n] * U64(BASE) + eight[8 : n + 8] * _MIX1 + eight[16 : n + 16] * _MIX2)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    if len(values) < width:
        return values[:0]
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs(minima: np.ndarray, valid: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run: neighbouring valid windows of one text that share a minimiser."""
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at
    m, t = minima[at], text[at]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (t[1:] != t[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    length = np.diff(np.concatenate([first, [len(at)]]))
    pieces = -(-length // LONGEST_RUN)
    if pieces.max() > 1:
        which = np.repeat(np.arange(len(first)), pieces)
        step = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, length = first[which] + step * LONGEST_RUN, np.minimum(length[which] - step * LONGEST_RUN, LONGEST_RUN)
    return at[first], length


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans, sorted."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.concatenate([[True], s[1:] > e[:-1]]) if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return s[first], e[np.concatenate([first[1:] - 1, [len(s) - 1]])] if len(s) else e


def spans_by_document(ids: np.ndarray, digests: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """For each document its merged spans as one flat list."""
    order = np.lexsort((starts, digests, ids))
    ids, digests, starts, ends = ids[order], digests[order], starts[order], ends[order]
    cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (digests[1:] != digests[:-1])])) if len(ids) else []
    for a, b in zip(cut, [*cut[1:], len(ids)]):
        s, e = merged(starts[a:b], ends[a:b])
        yield int(ids[a]), int(digests[a]), np.stack([s, e], 1).ravel().tolist()


#: Occurrences of packed strings, one array per field. Of a minimiser, four bytes travel: two that agree in them share a bucket, no more.
FIELDS = [("minimiser", "<u4"), ("id", "<i8"), ("digest", "<i4"), ("start", "<i4"), ("windows", "<u2"), ("mark", "|u1"), ("length", "<i4")]


def pack(fields: dict[str, np.ndarray], strings: list[bytes]) -> bytes:
    """Occurrences and their strings as one compressed value."""
    head = np.array([len(strings)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(fields[n].astype(t).tobytes() for n, t in FIELDS) + b"".join(strings))


def unpack(values: list[bytes]) -> tuple[dict[str, np.ndarray], list[bytes]]:
    """The occurrences of many packed values."""
    parts, strings = {n: [] for n, _ in FIELDS}, []
    for value in values:
        raw = zstandard.ZstdDecompressor().decompress(value)
        n, at = int(np.frombuffer(raw, "<i8", 1)[0]), 8
        for name, kind in FIELDS:
            found = np.frombuffer(raw, kind, n, at)
            at += found.nbytes
            parts[name].append(found)
        ends = at + np.cumsum(parts["length"][-1])
        strings += [raw[a:b] for a, b in zip(np.concatenate([[at], ends[:-1]]).tolist() if n else [], ends.tolist())]
    empty = lambda kind: np.zeros(0, kind)
    return {n: np.concatenate([empty(t), *parts[n]]) for n, t in FIELDS}, strings


def numbered_strings(strings: list[bytes]) -> np.ndarray:
    """Equal numbers for equal strings."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(s, len(seen)) for s in strings], np.int64)


class Gatherer:
    """Collects the runs of a task and sends them on, a row per bucket group, in pieces of bounded size.

    ``settle(number, fields)`` is told which strings are equal and returns which occurrences can be decided here (their whole
    length is marked) and which have to travel. So the many copies of a string in one task cost one string.
    """

    SCHEMA = "part int, packed binary, id long, digest long, spans array<long>"

    def __init__(self, parts: int, window: int, settle):
        self.parts, self.window, self.settle = parts, window, settle
        self.strings, self.fields, self.size = [], {n: [] for n, _ in FIELDS}, 0

    def add(self, strings: list[bytes], **fields: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.strings += strings
        fields["length"] = np.array([len(s) for s in strings], np.int32)
        fields["mark"] = np.zeros(len(strings), np.uint8)
        for name, _ in FIELDS:
            self.fields[name].append(fields[name])
        self.size += int(fields["length"].sum())
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.strings:
            return
        strings, fields = self.strings, {n: np.concatenate(v) for n, v in self.fields.items()}
        self.strings, self.fields, self.size = [], {n: [] for n, _ in FIELDS}, 0
        decided, travels, fields["mark"] = self.settle(numbered_strings(strings), fields)
        rows = []
        if decided.any():
            starts = fields["start"][decided].astype(np.int64)
            ends = starts + fields["windows"][decided] + self.window - 1
            for i, d, spans in spans_by_document(fields["id"][decided], fields["digest"][decided], starts, ends):
                rows.append((d % self.parts, None, i, d, spans))
        at = np.flatnonzero(travels)
        part = (mix(fields["minimiser"][at]) % U64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.diff(part[order])) + 1
        for group in np.split(order, cut) if len(order) else []:
            chosen = at[group]
            rows.append((int(part[group[0]]), pack({n: v[chosen] for n, v in fields.items()}, [strings[i] for i in chosen.tolist()]), None, None, None))
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = ["part", "packed", "id", "digest", "spans"]
        for i in range(0, len(rows), 256):
            columns = [pa.array(c, k) for c, k in zip(zip(*rows[i : i + 256]), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)


SPANS_SCHEMA = "id long, digest long, spans array<long>"


def span_table(table: pa.Table, found: list[tuple[int, int, list[int]]]) -> pa.Table:
    """What was decided earlier, passed on, and what was found in the buckets."""
    early = table.filter(pa.compute.is_valid(table.column("spans"))).select(["id", "digest", "spans"])
    ids, digests, spans = ([x[i] for x in found] for i in range(3))
    late = pa.table({"id": pa.array(ids, pa.int64()), "digest": pa.array(digests, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64()))})
    return pa.concat_tables([early.cast(late.schema), late])
