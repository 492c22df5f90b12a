"""Removal of repeated word windows by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one text. Consecutive windows that share a minimiser (the smallest digest of their grams of
``GRAM`` words) travel as one packed string to the minimiser's bucket, so a word travels about three times instead of ``WINDOW``
times. In a bucket the windows are sorted by digest, and windows with equal digests are compared word for word; so counts are exact.
Words covered by a window that occurs at least twice anywhere, its first place included, are removed.

Equal strings of one task are sent once, marked as repeated, and their own places are decided where they lie: copies cost little. The
texts of documents that lose words are dealt out once more, to meet their removed spans.

Null texts have no words; texts shorter than a window lose nothing; the rows of a repeated document repeat each other and lose all windows;
an empty table gives an empty result. A task holds one text at a time and the strings of one bucket group; the number of groups
follows ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .common import text_of, whole_rows, with_row
from .filters import digest_filter, passes
from .windows import (
    CHUNK, SPANS_SCHEMA, Gatherer, merged, numbered_strings, runs, sequence_digests, sliding_min, span_table, spans_by_document, text_chunks, unpack,
    word_digests, words,
)

WINDOW, GRAM = 35, 4
#: Bucket groups per shuffle partition.
GROUPS = 4


def normal_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words, each followed by one space, and where each starts."""
    length = ends - starts
    places = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(places[-1], 32, np.uint8)
    at = np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)
    out[at] = data[~((data == 32) | ((data >= 9) & (data <= 13)))]
    return out.tobytes(), places


def _settle(number: np.ndarray, fields: dict[str, np.ndarray]):
    """A string that occurs twice in a task is repeated: all its places are decided, and one of them travels, marked."""
    first = np.unique(number, return_index=True)[1]
    many = np.bincount(number)[number] > 1
    travels = np.zeros(len(number), bool)
    travels[first] = True
    return many, travels, many.astype(np.uint8)


def _cut(window: int, gram: int, parts: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gatherer = Gatherer(parts, window, _settle)
        for batch in batches:
            ids, digests = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for lo, _, data, offsets in text_chunks(batch.column(2)):
                starts, ends, text = words(data, offsets)
                n = len(starts) - window + 1
                if n <= 0:
                    continue
                grams = sequence_digests(word_digests(data, starts, ends), gram)
                minima = sliding_min(grams, window - gram + 1)
                at, count = runs(minima, text[:n] == text[window - 1 :], text[:n])
                if not len(at):
                    continue
                normal, places = normal_bytes(data, starts, ends)
                until = places[at + count + window - 1] - 1
                strings = [normal[a:b] for a, b in zip(places[at].tolist(), until.tolist())]
                first_word = np.searchsorted(text, np.arange(text[-1] + 1))
                row = text[at]
                yield from gatherer.add(strings, minimiser=minima[at], id=ids[lo + row], digest=digests[lo + row],
                                        start=at - first_word[row], windows=count)
        yield from gatherer.flush()

    return cut


def _windows(strings: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Digest, string, start and end of every window of the strings, worked out for a few strings at a time."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    lo = 0
    while lo < len(strings):
        hi, size = lo, 0
        while hi < len(strings) and (hi == lo or size + len(strings[hi]) <= CHUNK):
            size += len(strings[hi]) + 1
            hi += 1
        data = np.frombuffer(b"\n".join(strings[lo:hi]), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings[lo:hi]])])
        offsets[-1] -= 1
        starts, ends, text = words(data, offsets)
        n = len(starts) - window + 1
        at = np.flatnonzero(text[:n] == text[window - 1 :])
        digests = sequence_digests(word_digests(data, starts, ends), window)
        own = text[at]
        for values, new in zip(found, (digests[at], own + lo, starts[at] - offsets[own], ends[at + window - 1] - offsets[own])):
            values.append(new.astype(np.uint64 if values is found[0] else np.int32))
        lo = hi
    return tuple(np.concatenate(x) for x in found)


def repeated_windows(strings: list[bytes], marked: np.ndarray, window: int) -> list[np.ndarray]:
    """For each distinct string, which of its windows occur twice among all strings; those of marked strings do in any case."""
    digests, owner, starts, ends = _windows(strings, window)
    order = np.argsort(digests, kind="stable")
    d = digests[order]
    group = np.cumsum(np.concatenate([[True], d[1:] != d[:-1]])) - 1
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    hit = marked[owner]
    # Equal digests: compared word for word, equal ones are repeats.
    cuts = np.flatnonzero(np.diff(group[several])) + 1
    for members in np.split(order[several], cuts) if len(several) else []:
        seen: dict[bytes, list[int]] = {}
        for w in members.tolist():
            seen.setdefault(strings[owner[w]][starts[w] : ends[w]], []).append(w)
        for same in seen.values():
            if len(same) > 1:
                hit[same] = True
    first = np.searchsorted(owner, np.arange(len(strings) + 1))
    return [hit[a:b] for a, b in zip(first[:-1], first[1:])]


def _count(window: int):
    def count(table: pa.Table) -> pa.Table:
        fields, strings = unpack([v for v in table.column("packed").to_pylist() if v is not None])
        if not strings:
            return span_table(table, [])
        number = numbered_strings(strings)
        marked = np.zeros(number.max() + 1, np.int64)
        np.add.at(marked, number, 1 + fields["mark"].astype(np.int64))
        distinct = list(dict.fromkeys(strings))
        hits = repeated_windows(distinct, marked > 1, window)
        ids, digests, starts, ends = [], [], [], []
        done = fields["mark"].astype(bool)
        for i in np.flatnonzero(~done).tolist():
            hit = np.flatnonzero(hits[number[i]])
            if len(hit):
                s, e = merged(hit + int(fields["start"][i]), hit + int(fields["start"][i]) + window)
                ids += [fields["id"][i]] * len(s)
                digests += [fields["digest"][i]] * len(s)
                starts.append(s)
                ends.append(e)
        if not ids:
            return span_table(table, [])
        return span_table(table, list(spans_by_document(np.array(ids, np.int64), np.array(digests, np.int64), np.concatenate(starts), np.concatenate(ends))))

    return count


def identity(key: str, text: Column) -> tuple[Column, Column]:
    """Integer id (the largest integer for null) and a short digest of the text, which tells documents that share an id apart."""
    return F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("_id"), F.hash(text).cast("long").alias("_digest")


def removed_spans(docs: DataFrame, cut, count, text: str, key: str, parts: int) -> DataFrame:
    """Spans to remove per document identity, as one sorted flat list each."""
    packed = docs.select(*identity(key, text_of(text)), text_of(text).alias("_text")).mapInArrow(cut, Gatherer.SCHEMA)
    found = packed.groupBy("part").applyInArrow(count, SPANS_SCHEMA)
    return found.groupBy("id", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def group_count(docs: DataFrame) -> int:
    return GROUPS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut_out(parts_of, apply, rows: DataFrame, schema: str) -> DataFrame:
    """Each row with what ``apply`` makes of its text and merged spans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                made = []
                for text, spans in zip(part.column(1), part.column(2)):
                    flat = np.array(spans.as_py() or [], np.int64).reshape(-1, 2)
                    s, e = merged(flat[:, 0], flat[:, 1])
                    made.append(apply(text.as_py(), s.tolist(), e.tolist()))
                columns = [pa.array(c, k) for c, k in zip(zip(*made), parts_of)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["row", *[f"c{i}" for i in range(len(columns))]])

    return rows.mapInArrow(work, with_row(rows, schema))


def with_spans(docs: DataFrame, spans: DataFrame, text: str, key: str, keep: list[str] | None) -> DataFrame:
    """``row``, text and spans (null if none) of every document.

    The spans are written first. Documents that surely have none stay where they are; only the others are dealt out to meet theirs.
    """
    spans = materialize(spans.select(F.col("id").alias("_of"), F.col("digest").alias("_of_digest"), "spans"))
    bits = docs.sparkSession.sparkContext.broadcast(digest_filter(spans.select(F.xxhash64("_of", "_of_digest").alias("h")), "h"))

    @F.arrow_udf("boolean")
    def may_have(h: pa.Array) -> pa.Array:
        return pa.array(passes(bits.value, h.to_numpy()))

    rows = whole_rows(docs, text_of(text).alias("_text"), *identity(key, text_of(text)), keep=keep).withColumn("_asks", may_have(F.xxhash64("_id", "_digest")))
    sure = rows.filter(~F.col("_asks")).select("row", "_text", F.lit(None).cast("array<long>").alias("spans"))
    met = rows.filter("_asks").join(spans, (F.col("_id") == F.col("_of")) & (F.col("_digest") == F.col("_of_digest")), "left")
    return sure.unionByName(met.select("row", "_text", "spans"))


def _keep_words(text: str, starts: list[int], ends: list[int]) -> tuple[int, int, str, str]:
    found = text.translate(_TO_SPACE).split(" ")
    found = [w for w in found if w]
    kept = found
    if starts:
        kept, at = [], 0
        for s, e in zip(starts, ends):
            kept += found[at:s]
            at = e
        kept += found[at:]
    joined = " ".join(kept)
    return len(found), len(found) - len(kept), hashlib.sha256(joined.encode()).hexdigest(), joined


_TO_SPACE = {c: " " for c in range(9, 14)}


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Each row (its columns ``keep``) as ``row`` with ``n_words``, ``n_removed``, ``kept_sha256`` and the ``kept`` text."""
    parts = group_count(docs)
    spans = removed_spans(docs, _cut(window, min(GRAM, window), parts), _count(window), text, key, parts)
    rows = with_spans(docs, spans, text, key, keep)
    made = cut_out([pa.int64(), pa.int64(), pa.string(), pa.string()], _keep_words, rows, "c0 long, c1 long, c2 string, c3 string")
    return made.withColumnsRenamed({"c0": "n_words", "c1": "n_removed", "c2": "kept_sha256", "c3": "kept"})
