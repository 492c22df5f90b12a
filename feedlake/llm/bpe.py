"""BPE encoding and decoding with a public vocabulary file.

A piece of text starts as a doubly linked list of symbols. A priority queue holds the merges of neighbours by rank, then place; an entry
whose symbols have changed since it was queued is stale and skipped. Decoding joins the vocabulary strings.

The file's normaliser (NFC, white space to one space, lower case), its splitting pattern, its byte letters and its special
tokens are applied as the file says; other kinds of file are refused. Every text is cut at white space, which no token crosses, and equal
pieces within a task are encoded once, in a cache of bounded size. Each row is worked on alone, whatever its length; nothing is shuffled.

Null texts count as empty. Empty texts have no tokens and decode to the empty text. Repeated rows are encoded alike; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, whole_rows, with_row

#: Distinct pieces that a task remembers, and the longest piece that it remembers.
CACHE_PIECES, CACHE_LENGTH = 400_000, 100
_LAST_IDEOGRAPHS = "\U0002fa20"
_BITS = 20
_MASK = (1 << _BITS) - 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(free)
            free += 1
    return [letters[b] for b in range(256)]


class Encoder:
    """Encodes texts with one vocabulary. ``spec`` is the parsed vocabulary file."""

    def __init__(self, spec: dict):
        model, normalizer, split = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        kinds = [n["type"] for n in normalizer["normalizers"]]
        if model["type"] != "BPE" or model["unk_token"] or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError("this kind of vocabulary file is not supported")
        ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: Two neighbours as one number -> rank of their merge and its symbol, as one number.
        self.merges = {ids[a] << _BITS | ids[b]: rank << _BITS | ids[a + b] for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}
        letters = byte_letters()
        self.inner, self.final = [ids[x] for x in letters], [ids[x + model["end_of_word_suffix"]] for x in letters]
        self.split = regex.compile(split["pretokenizers"][0]["pattern"]["Regex"])
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.pieces: dict[str, tuple[bytes, str]] = {}

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text."""
        ids, strings, chunks = [], [], self.chunks
        parts = self.at_special.split(text) if self.at_special else [text]
        for part in parts:
            if part in self.special:
                ids.append(struct.pack("<I", self.special[part]))
                strings.append(part)
                continue
            for chunk in re.split("[ \t\n\x0b\x0c\r]+", part) if re.search("[\x1c-\x1f]", part) else part.split():
                known = chunks.get(chunk)
                if known is None:
                    known = _remember(chunks, chunk, self._chunk(chunk))
                if known[0]:
                    ids.append(known[0])
                    strings.append(known[1])
        return b"".join(ids), " ".join(strings)

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings; files without a decoder set a space between them."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        # Letter by letter: the form of a final sigma does not depend on its place.
        text = text.replace("Σ", "σ").lower()
        found = []
        for piece in self._split(text):
            known = self.pieces.get(piece)
            if known is None:
                ids = self._piece(piece.encode())
                known = _remember(self.pieces, piece, (struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)))
            found.append(known)
        return found[0] if len(found) == 1 else (b"".join(x[0] for x in found), " ".join(x[1] for x in found))

    def _split(self, text: str) -> list[str]:
        if text.isascii() or max(text) < _LAST_IDEOGRAPHS:
            return self.split.findall(text)
        # The pattern library takes unassigned characters out there for letters; a private-use one stands in for them.
        shadow = "".join("\ue000" if c >= _LAST_IDEOGRAPHS and unicodedata.category(c) == "Cn" else c for c in text)
        return [text[m.start() : m.end()] for m in self.split.finditer(shadow)]

    def _piece(self, raw: bytes) -> list[int]:
        inner, merge = self.inner, self.merges.get
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.final[raw[-1]]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry is a rank and the place of its left symbol, as one number.
        queue = [m >> _BITS << 32 | i for i in range(n - 1) if (m := merge(symbols[i] << _BITS | symbols[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            left = entry & 0xFFFFFFFF
            right = after[left]
            if symbols[left] < 0 or right >= n:
                continue
            found = merge(symbols[left] << _BITS | symbols[right])
            if found is None or found >> _BITS != entry >> 32:
                continue  # stale: one of the two has been merged since
            new, following, preceding = found & _MASK, after[right], before[left]
            symbols[left], symbols[right], after[left] = new, -1, following
            if following < n:
                before[following] = left
                if (m := merge(new << _BITS | symbols[following])) is not None:
                    heapq.heappush(queue, m >> _BITS << 32 | left)
            if preceding >= 0 and (m := merge(symbols[preceding] << _BITS | new)) is not None:
                heapq.heappush(queue, m >> _BITS << 32 | preceding)
        return [s for s in symbols if s >= 0]


def _remember(cache: dict, key: str, value):
    if len(key) <= CACHE_LENGTH:
        if len(cache) >= CACHE_PIECES:
            cache.clear()
        cache[key] = value
    return value


def read_vocabulary(path: str) -> str:
    """The vocabulary file's content: a fixed public file of a few megabytes, read where the job is built."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, full: bool = False) -> DataFrame:
    """Each row (its columns ``keep``) as ``row`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    With ``full`` also the ``ids`` themselves and the ``decoded`` text. ``vocabulary`` is the path of the file; its content reaches the
    workers as one broadcast value.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    rows = whole_rows(docs, text_of(text).alias("_text"), keep=keep)
    more = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if full else []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(json.loads(spec.value))
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                counts, ids_digests, text_digests, ids_lists, decoded_texts = [], [], [], [], []
                for value in part.column(1):
                    ids, decoded = encoder.encode(value.as_py())
                    counts.append(len(ids) // 4)
                    ids_digests.append(hashlib.sha256(ids).hexdigest())
                    text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if full:
                        ids_lists.append(struct.unpack(f"<{len(ids) // 4}I", ids))
                        decoded_texts.append(decoded)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())]
                if full:
                    columns += [pa.array(ids_lists, pa.list_(pa.int32())), pa.array(decoded_texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "n_tokens", "ids_sha256", "decoded_sha256", *[n for n, _ in more]])

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")
    return rows.mapInArrow(encode, with_row(rows, schema))


def tokenized(docs: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """Ids of every document, for training."""
    return encode_documents(docs, vocabulary, keep=[key], full=True).select(F.col("row")[key].alias(key), "n_tokens", "ids", "ids_sha256", "decoded_sha256")
