"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

Windows are the ``WINDOW``-byte strings of a text. Runs of windows with the same minimiser travel as one string to the minimiser's bucket, so
that no task needs all suffixes. Of equal strings only the earliest is kept as a reference; the windows of all others are repeats
at once. What is left, strings that differ but share a minimiser (or repeat within themselves), is cut into shards. Each shard gets its
own suffix order and Burrows-Wheeler transform, and the transforms are merged by refining their interleave: after ``h`` rounds of a
stable sort by the preceding symbol, the suffixes of all shards lie in the order of their first ``h`` symbols, without ever being sorted
together. The rounds also give the common prefixes of neighbours; intervals whose neighbours share ``WINDOW`` symbols are the repeated
strings, and all but their earliest places are removed.

Earlier is a smaller id, or a smaller start in the same document; null ids come last. Documents that share an id, and repeated rows, are not
earlier than each other. Null texts count as empty; texts shorter than a window lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .substring_dedup import cut_out, group_count, removed_spans, with_spans
from .windows import (
    U64, Gatherer, byte_grams, mix, numbered_strings, runs, sequence_digests, sliding_min, span_table, spans_by_document, text_chunks, unpack,
)

WINDOW, GRAM = 100, 24
#: Strings that may share a window must have all but so many of its bytes in common.
SLACK = 16
#: Bytes of strings in one shard at least; a group has about 200 shards at most.
SHARD = 1 << 18


def _later(number: np.ndarray, fields: dict[str, np.ndarray]) -> np.ndarray:
    """Which occurrences of equal strings have an earlier one."""
    order = np.lexsort((fields["start"], fields["digest"], fields["id"], number))
    n, i, d, s = number[order], fields["id"][order], fields["digest"][order], fields["start"][order]
    new = np.concatenate([[True], n[1:] != n[:-1]])
    smallest = i[np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))]
    same = np.concatenate([[False], (n[1:] == n[:-1]) & (i[1:] == i[:-1]) & (d[1:] == d[:-1])])
    start_of = np.maximum.accumulate(np.where(~same, np.arange(len(n)), 0))
    later = np.zeros(len(n), bool)
    later[order] = (i > smallest) | (s > s[start_of])
    return later


def _settle(number: np.ndarray, fields: dict[str, np.ndarray]):
    """Only the earliest occurrences of a string travel."""
    later = _later(number, fields)
    return later, ~later, np.zeros(len(number), np.uint8)


def _cut(window: int, parts: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gatherer = Gatherer(parts, window, _settle)
        for batch in batches:
            ids, digests = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for lo, _, data, offsets in text_chunks(batch.column(2)):
                n = len(data) - window + 1
                if n <= 0:
                    continue
                text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
                minima = sliding_min(byte_grams(data), window - GRAM + 1)
                at, count = runs(minima, text[:n] == text[window - 1 :], text[:n])
                if not len(at):
                    continue
                raw = data.tobytes()
                strings = [raw[a:b] for a, b in zip(at.tolist(), (at + count + window - 1).tolist())]
                row = text[at]
                yield from gatherer.add(strings, minimiser=minima[at], id=ids[lo + row], digest=digests[lo + row],
                                        start=at - offsets[row], windows=count)
        yield from gatherer.flush()

    return cut


#: UTF-8 has no byte of 0xF8 or more, so all bytes and the two closing symbols fit one byte: 0 closes a shard, 1 a string.
CLOSE_SHARD, CLOSE_STRING, FIRST_BYTE = 0, 1, 2


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of one shard, by doubling the sorted length until no two are equal. The last symbol is unique."""
    n, length = len(symbols), 7
    padded = np.concatenate([symbols, np.zeros(8, np.uint8)])
    first = np.zeros(n, np.uint64)
    for i in range(length):
        first = first * np.uint64(256) + padded[i : i + n]
    key = first.astype(np.int64)
    while True:
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * (n + 1)
        key[: max(n - length, 0)] += rank[length:] + 1
        length *= 2


def shard_transforms(strings: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Per shard: suffix order, transform, and the number of its first string and where its strings start, as one array."""
    limit = max(SHARD, sum(map(len, strings)) // 200)
    orders, transforms, layouts, lo = [], [], [], 0
    while lo < len(strings):
        hi, size = lo, 0
        while hi < len(strings) and (hi == lo or size + len(strings[hi]) <= limit):
            size += len(strings[hi]) + 1
            hi += 1
        flat = b"".join(s + b"\0" for s in strings[lo:hi])
        ends = np.cumsum([len(s) + 1 for s in strings[lo:hi]])
        symbols = np.frombuffer(flat, np.uint8) + np.uint8(FIRST_BYTE)
        symbols[ends - 1] = CLOSE_STRING
        symbols = np.concatenate([symbols, np.array([CLOSE_SHARD], np.uint8)])
        order = suffix_order(symbols)
        orders.append(order)
        transforms.append(symbols[order - 1])
        layouts.append(np.concatenate([[lo, 0], ends]))
        lo = hi
    return orders, transforms, layouts


def merge_transforms(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes sorted by ``depth`` symbols, and the common prefix of each with the one before (at most ``depth``).

    The interleave holds places in the joined transforms. A round puts the preceding symbol in front of every suffix: its stable sort by
    that symbol gives the new order, and each shard's own transform says which of its suffixes now stands there. So the
    transforms are only read; no suffix is compared with another.
    """
    joined = np.concatenate(transforms)
    steps, at = [], 0
    for t in transforms:
        step = np.empty(len(t), np.int32)
        step[np.argsort(t, kind="stable")] = np.arange(at, at + len(t), dtype=np.int32)
        steps.append(step)
        at += len(t)
    before = np.concatenate(steps)  # the place, in the same shard, of the suffix that is one symbol longer
    interleave, block = np.arange(len(joined), dtype=np.int32), np.zeros(len(joined), np.int32)
    common = np.full(len(joined), depth, np.int16)
    border = np.zeros(len(joined), bool)
    for h in range(1, depth + 1):
        symbols = joined[interleave]
        order = np.argsort(symbols, kind="stable")
        block = block[order]
        new = np.concatenate([[True], block[1:] != block[:-1]])
        count = np.bincount(symbols, minlength=256)
        new[np.cumsum(count)[:-1][np.cumsum(count)[:-1] < len(joined)]] = True  # where the next symbol begins
        interleave = before[interleave[order]]
        common[new & ~border] = h - 1
        border = new
        block = np.cumsum(new, dtype=np.int32)
        if block[-1] == len(joined):
            break
    return interleave, common


def repeated_places(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places (string, offset) of windows that occur at least twice, and a number per window."""
    orders, transforms, layouts = shard_transforms(strings)
    interleave, common = merge_transforms(transforms, window)
    string, offset, room = [], [], []
    for order, layout in zip(orders, layouts):
        starts = layout[1:]
        which = np.minimum(np.searchsorted(starts, order, side="right") - 1, len(starts) - 2)
        string.append(which + layout[0])
        offset.append(order - starts[which])
        room.append(starts[which + 1] - 1 - order)
    string, offset, room = (np.concatenate(x)[interleave] for x in (string, offset, room))
    interval = np.cumsum(common < window)
    valid = room >= window
    size = np.bincount(interval[valid], minlength=interval[-1] + 1)
    hit = np.flatnonzero(valid & (size[interval] > 1))
    return string[hit], offset[hit], interval[hit]


def _share_a_seed(strings: list[bytes], bucket: np.ndarray, length: int) -> np.ndarray:
    """Which strings have ``length`` bytes in common with another one of their bucket, by digest.

    Strings that share a window share these too. Most strings that meet in a bucket do not: they hold the same short line.
    """
    if not strings or length <= 0:
        return np.arange(len(strings))
    found = np.zeros(len(strings), bool)
    order = np.argsort(bucket, kind="stable").tolist()
    lo = 0
    while lo < len(order):  # whole buckets, so many that their digests take little memory
        hi, size = lo, 0
        while hi < len(order) and (size < 1 << 20 or bucket[order[hi]] == bucket[order[hi - 1]]):
            size += len(strings[order[hi]])
            hi += 1
        some = order[lo:hi]
        data = np.frombuffer(b"".join(strings[i] for i in some), np.uint8)
        owner = np.repeat(np.array(some), [len(strings[i]) for i in some])
        digests = sequence_digests(data.astype(U64) + U64(1), length)
        n = len(digests)
        whole = np.flatnonzero(owner[:n] == owner[length - 1 :])
        digests = digests[whole] ^ mix(bucket[owner[whole]].astype(U64))
        own = owner[whole]
        by = np.argsort(digests)
        d, o = digests[by], own[by]
        same = np.flatnonzero(d[1:] == d[:-1])
        found[o[same]] = True
        found[o[same + 1]] = True
        lo = hi
    return np.flatnonzero(found)


def _count(window: int):
    def count(table: pa.Table) -> pa.Table:
        fields, strings = unpack([v for v in table.column("packed").to_pylist() if v is not None])
        if not strings:
            return span_table(table, [])
        number = numbered_strings(strings)
        later = _later(number, fields)
        gone = np.flatnonzero(later)
        ids, digests = [fields["id"][gone]], [fields["digest"][gone]]
        starts = [fields["start"][gone].astype(np.int64)]
        ends = [starts[0] + fields["windows"][gone] + window - 1]
        # One reference per distinct string; a few documents with one id may each keep theirs.
        kept = np.flatnonzero(~later)
        first = kept[np.unique(number[kept], return_index=True)[1]]
        minimiser, inverse, sizes = np.unique(fields["minimiser"][first], return_inverse=True, return_counts=True)
        shared = np.flatnonzero(sizes[inverse] > 1)
        seeds = _share_a_seed([strings[first[i]] for i in shared.tolist()], inverse[shared], window - SLACK)
        chosen = first[shared[seeds]].tolist()
        chosen += [i for i in np.delete(first, shared[seeds]).tolist() if _periodic(strings[i], int(fields["windows"][i]), window)]
        if chosen:
            string, offset, interval = repeated_places([strings[i] for i in chosen], window)
        else:
            string = np.zeros(0, np.int64)
        if len(string):
            # Every kept occurrence of the string stands at these places.
            holders: dict[int, list[int]] = {}
            for i in kept.tolist():
                holders.setdefault(int(number[i]), []).append(i)
            lists = [holders[int(number[i])] for i in chosen]
            many = np.array([len(x) for x in lists])
            who = np.concatenate([np.array(lists[s]) for s in string.tolist()]) if many.max() > 1 else np.array([x[0] for x in lists])[string]
            offset, interval = np.repeat(offset, many[string]), np.repeat(interval, many[string])
            spot = {"id": fields["id"][who], "digest": fields["digest"][who], "start": fields["start"][who].astype(np.int64) + offset}
            after = _later(interval, spot)
            ids.append(spot["id"][after])
            digests.append(spot["digest"][after])
            starts.append(spot["start"][after])
            ends.append(spot["start"][after] + window)
        return span_table(table, list(spans_by_document(*map(np.concatenate, (ids, digests, starts, ends)))))

    return count


def _periodic(string: bytes, windows: int, window: int) -> bool:
    """Whether a run may hold one window twice: then the bytes that all its windows share stand in it once more."""
    return windows > window - GRAM + 1 or (windows > 1 and string.find(string[windows - 1 : window], windows) >= 0)


def _keep_bytes(text: str, starts: list[int], ends: list[int]) -> tuple[int, int, int, str, bytes]:
    raw = text.encode()
    if not starts:
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw
    kept = b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)]))
    return len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Each row (its columns ``keep``) as ``row`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and the ``kept`` bytes."""
    if window <= GRAM:
        raise ValueError(f"a window has more than {GRAM} bytes")
    parts = group_count(docs)
    spans = removed_spans(docs, _cut(window, parts), _count(window), text, key, parts)
    rows = with_spans(docs, spans, text, key, keep)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    made = cut_out(kinds, _keep_bytes, rows, "c0 long, c1 long, c2 long, c3 string, c4 binary")
    return made.withColumnsRenamed({"c0": "n_bytes", "c1": "n_removed", "c2": "n_spans", "c3": "kept_sha256", "c4": "kept"})
