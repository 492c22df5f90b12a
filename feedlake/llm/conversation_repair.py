"""Repair of the structure of conversations: the cheapest edits after which the roles are an optional system row and user/assistant pairs.

Every row is kept, given another role or deleted, and rows without text may be inserted. A conversation is a walk through four states (no row
yet, after system, after user, after assistant), one step per row, so the possible repairs form a DAG. A walk's weight is one integer: the
high digits are its cost; below them each row has three octal digits, the letters of the inserts before it and its own, with zeros
behind; the last three are the inserts at the end. No slot is the beginning of another, so comparing these numbers compares costs first and
then audits letter by letter, and the plain minimum over the DAG gives the cheapest repair with the smallest audit.

Rows are first counted per (conversation, turn, role, text digest), which makes one of any number of copies, and then sorted by ranges, so
that a long conversation is cut into pieces that lie in several tasks. A piece of at most ``BLOCK`` rows gives the smallest weight from each
state to each other. The pieces of a conversation are joined in order by adding shifted weights. Only the digest of the repaired text needs the
rows of a conversation one after another in one task; they stream through it in sorted order and are never gathered.

Nulls in role and text count as one space. Rows without a conversation id form one conversation. Rows with equal turn, null turns first, are ordered
by role, then by the digest of their text. Roles count by their first letter; one that is not ``s``, ``u`` or ``a`` can only be changed or deleted.
A conversation all of whose rows have ``copies`` 0 has no rows: zeros, an empty audit, the digest of the empty text. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .common import SPACE_CLASS, SPACES

#: Rows of a piece: the weights within it have nine bits per row.
BLOCK = 256
# Costs of the edits, and of a row that is not deleted though it is truncated.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LETTERS = {"D": "1", "I": "2", "K": "3", "R": "4"}
# Row codes: the class of the role's first letter plus four times the first fault.
INITIALS = {"s": 1, "u": 2, "a": 3}
FAULTS = {"sound": 0, "truncated": 1, "blank": 2, "duplicate": 3}
# States are numbered like the classes. Where a user or assistant row leads to, and which kept rows may follow.
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
_KEPT = {(0, 1), (0, 2), (1, 2), (3, 2), (2, 3)}
_LEGAL = {(1, 2), (2, 3), (3, 2)}
_ROLES = {2: "user", 3: "assistant"}
_SLOT = 9


def _slot(letters: str) -> int:
    return int("".join(LETTERS[x] for x in letters).ljust(3, "0"), 8)


def _edges(code: int) -> list[tuple[int, int, int, int]]:
    """Steps that a row allows: from state, to state, cost, slot; of steps with the same ends the smallest."""
    kind, fault = code % 4, code // 4
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for start in range(4):
        state, letters, cost = start, "", 0
        for _ in range(3):
            found = [(state, DELETE, "D")]
            if fault < FAULTS["blank"]:
                more = TRUNCATED * (fault == FAULTS["truncated"])
                found.append((_NEXT[state], REROLE + more, "R"))
                if (state, kind) in _KEPT:
                    found.append((kind, KEEP + more, "K"))
            for end, price, letter in found:
                step = cost + price, _slot(letters + letter)
                best[start, end] = min(best.get((start, end), step), step)
            state, letters, cost = _NEXT[state], letters + "I", cost + INSERT
            if len(letters) > 2:
                break
    return [(a, b, *step) for (a, b), step in best.items()]


_EDGES = [_edges(code) for code in range(16)]
# What each state needs at the end: nothing, or the inserts that complete the last pair.
_ENDS = [(0, _slot("")), (2 * INSERT, _slot("II")), (INSERT, _slot("I")), (0, _slot(""))]


@functools.lru_cache(maxsize=1 << 14)
def crossing(codes: bytes) -> tuple[int | None, ...]:
    """Smallest weight of the rows' steps from each state to each state, sixteen values."""
    width, found = _SLOT * len(codes), []
    for start in range(4):
        best: list[int | None] = [None] * 4
        best[start] = 0
        for i, code in enumerate(codes):
            shift, after = width - _SLOT * (i + 1), [None] * 4
            for a, b, cost, slot in _EDGES[code]:
                if best[a] is not None:
                    weight = best[a] + (cost << width) + (slot << shift)
                    if after[b] is None or weight < after[b]:
                        after[b] = weight
            best = after
        found += best
    return tuple(found)


class Walk:
    """The smallest weights from the beginning of a conversation to each state, piece after piece."""

    def __init__(self):
        self.rows, self.best = 0, [0, None, None, None]

    def extend(self, rows: int, weights: list[int | None]) -> None:
        before, width = _SLOT * self.rows, _SLOT * rows
        mask, after = (1 << width) - 1, [None] * 4
        for a in range(4):
            for b in range(4):
                step = weights[4 * a + b]
                if self.best[a] is not None and step is not None:
                    weight = (self.best[a] << width) + (step >> width << before + width) + (step & mask)
                    if after[b] is None or weight < after[b]:
                        after[b] = weight
        self.rows, self.best = self.rows + rows, after

    def result(self) -> tuple[int, str]:
        """Cost and audit."""
        width = _SLOT * (self.rows + 1)
        total = min((w << _SLOT) + (cost << width) + slot for w, (cost, slot) in zip(self.best, _ENDS) if w is not None)
        digits = format(total & ((1 << width) - 1), "o").zfill(width // 3)
        return total >> width, digits.translate({ord("0"): None, **{ord(d): x for x, d in LETTERS.items()}})


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, as the checksum of ``conv_id:turn`` says; ``copies`` is 0 for a dropped row and 2 for a repeated one."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(F.encode(named, "UTF-8")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _keyed(rows: DataFrame) -> DataFrame:
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("long").alias("copies")).withColumn(
        "digest", F.sha2("text", 256))


def _coded(keyed: DataFrame) -> DataFrame:
    """One row per conversation, turn, role and text, with the code of its first copy (``code``) and of the others (``again``)."""
    text, initial = F.col("text"), F.substring("role", 1, 1)
    kind = F.lit(0)
    for letter, number in INITIALS.items():
        kind = F.when(initial == letter, number).otherwise(kind)
    last = F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)
    fault = F.when(~F.rlike(text, F.lit("[^" + SPACE_CLASS[1:])), FAULTS["blank"]).when(~last.isin(".", "!", "?"), FAULTS["truncated"]).otherwise(FAULTS["sound"])
    narrow = keyed.select("conv_id", "turn", "role", "digest", kind.alias("kind"), fault.alias("fault"), "copies")
    rows = materialize(narrow.groupBy("conv_id", "turn", "role", "digest", "kind", "fault").agg(F.sum("copies").alias("copies")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.filter("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "role", "digest")]
    both = rows.alias("r").join(first.alias("f"), same[0] & same[1] & same[2], "left").select("r.*", "f.first")
    duplicate, blank = F.col("kind") + 4 * FAULTS["duplicate"], F.col("fault") == FAULTS["blank"]
    own = F.col("kind") + 4 * F.col("fault")
    return both.select(
        "conv_id", "turn", "role", "digest", "copies", F.when(~blank & (place > F.col("first")), duplicate).otherwise(own).alias("code"),
        F.when(blank, own).otherwise(duplicate).alias("again"))


_PIECE = ("struct<rows: long, blank: long, duplicate: long, truncated: long, illegal: long, head: int, tail: int, low: long, high: long, "
          "turns: long, weights: array<binary>>")


def _as_bytes(weight: int | None) -> bytes | None:
    return None if weight is None else weight.to_bytes(weight.bit_length() // 8 + 1, "little")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of sorted rows of one conversation, cut after ``BLOCK`` rows."""
    part, seq, out = TaskContext.get().partitionId(), 0, []
    conversation, codes, turns, started = None, bytearray(), [], False

    def piece() -> tuple:
        nonlocal codes, turns
        faults = [code // 4 for code in codes]
        kinds = [code % 4 for code in codes]
        row = dict(
            rows=len(codes), **{name: faults.count(FAULTS[name]) for name in ("blank", "duplicate", "truncated")},
            illegal=sum(pair not in _LEGAL for pair in zip(kinds, kinds[1:])), head=kinds[0] if kinds else None, tail=kinds[-1] if kinds else None,
            low=turns[0] if turns else None, high=turns[-1] if turns else None, turns=len(set(turns)),
            weights=[_as_bytes(w) for w in crossing(bytes(codes))])
        codes, turns = bytearray(), []
        return conversation, part, seq, row

    def table() -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "seq", "piece"])

    kinds = None
    for batch in batches:
        if kinds is None:
            longs = [pa.field(n, pa.int64()) for n in ("rows", "blank", "duplicate", "truncated", "illegal")]
            ends = [pa.field("head", pa.int32()), pa.field("tail", pa.int32()), *[pa.field(n, pa.int64()) for n in ("low", "high", "turns")]]
            kinds = [batch.schema.field("conv_id").type, pa.int32(), pa.int64(), pa.struct([*longs, *ends, pa.field("weights", pa.list_(pa.binary()))])]
        for key, turn, copies, code, again in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "turn", "copies", "code", "again")]):
            if started and key != conversation:
                out.append(piece())
                seq = 0
            conversation, started = key, True
            while copies:
                if len(codes) >= BLOCK:
                    out.append(piece())
                    seq += 1
                codes.append(code)
                if turn is not None:
                    turns.append(turn)
                code, copies = again, copies - 1
            if len(out) >= 1000:
                yield table()
                out = []
    if started:
        out.append(piece())
    if out:
        yield table()


class _Summary:
    """Counts of a conversation, piece after piece, and its walk."""

    def __init__(self):
        self.counts = dict(blank=0, duplicate=0, truncated=0, illegal=0)
        self.walk, self.tail, self.low, self.high, self.turns = Walk(), None, None, None, 0

    def add(self, p: dict) -> None:
        for name in self.counts:
            self.counts[name] += p[name]
        if p["rows"]:
            self.counts["illegal"] += self.tail is not None and (self.tail, p["head"]) not in _LEGAL
            self.tail = p["tail"]
            self.walk.extend(p["rows"], [None if w is None else int.from_bytes(w, "little") for w in p["weights"]])
        if p["low"] is not None:
            self.turns += p["turns"] - (self.high == p["low"])
            self.low, self.high = p["low"] if self.low is None else self.low, p["high"]

    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)


class _Turns:
    """Applies an audit to the rows of a conversation as they come: gives ``(letter, role, text)`` of what stays."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, _NEXT[self.state]
            yield "I", _ROLES[self.state], ""

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str, str]]:
        for _ in range(copies):
            yield from self.inserted()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "K":
                self.state = INITIALS[role[0]]
                yield letter, role, text
            elif letter == "R":
                self.state = _NEXT[self.state]
                yield letter, _ROLES[self.state], text


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Events of the sorted stream: ``("begin", id, summary)``, ``("turn", letter, role, text)``, ``("end",)``."""
    key, summary, turns = None, None, None
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            for r in part.to_pylist():
                if summary is None or r["conv_id"] != key:
                    if summary is not None:
                        yield from _closing(key, summary, turns)
                    key, summary, turns = r["conv_id"], _Summary(), None
                if r["kind"] == 0:
                    summary.add(r["piece"])
                    continue
                if turns is None:
                    turns = _Turns(summary.walk.result()[1])
                    yield "begin", key, summary
                for letter, role, text in turns.row(r["role"], r["text"], r["copies"]):
                    yield "turn", letter, role, text
    if summary is not None:
        yield from _closing(key, summary, turns)


def _closing(key, summary: _Summary, turns: _Turns | None) -> Iterator[tuple]:
    if turns is None:
        yield "begin", key, summary
        turns = _Turns(summary.walk.result()[1])
    for letter, role, text in turns.inserted():
        yield "turn", letter, role, text
    yield ("end",)


def _stream(rows: DataFrame) -> DataFrame:
    """Pieces and texts of every conversation in one task, pieces first, both in order."""
    keyed = _keyed(rows)
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    coded = _coded(keyed).repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    id_type = rows.schema["conv_id"].dataType.simpleString()
    pieces = coded.select("conv_id", "turn", "copies", "code", "again").mapInArrow(_pieces, f"conv_id {id_type}, part int, seq long, piece {_PIECE}")
    texts = keyed.filter("copies > 0").withColumn("kind", F.lit(1))
    both = pieces.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "seq", *order).select(
        "conv_id", "kind", "piece", "role", "text", "copies")


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of ``(conv_id, turn, role, text)``: faults, cost, audit, and the SHA-256 of the repaired ``role:text`` lines.

    ``rows`` may have a column ``copies``: how often each row is there, 0 for a row that is missing though its conversation is known.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, kind = [], None

        def table() -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * len(counts), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["conv_id", *counts, "audit", "repaired_sha256"])

        def seen(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in given:
                kind = batch.schema.field("conv_id").type
                yield batch

        digest, first, now = None, True, None
        for event in _conversations(seen(batches)):
            if event[0] == "begin":
                summary = event[2]
                cost, audit = summary.walk.result()
                now = event[1], summary.gaps(), *[summary.counts[n] for n in counts[1:5]], cost, audit
                digest, first = hashlib.sha256(), True
            elif event[0] == "turn":
                digest.update(f"{'' if first else chr(10)}{event[2]}:{event[3]}".encode())
                first = False
            else:
                out.append((*now, digest.hexdigest()))
                if len(out) >= 1000:
                    yield table()
                    out = []
        if out:
            yield table()

    return _stream(rows).mapInArrow(judged, f"conv_id {id_type}, {', '.join(f'{n} long' for n in counts)}, audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired rows themselves: ``conv_id``, ``place`` from 0, the edit's ``letter`` (K, R or I), ``role``, ``text``."""
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, kind, key, place = [], None, None, 0

        def table() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["conv_id", "place", "letter", "role", "text"])

        def seen(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in given:
                kind = batch.schema.field("conv_id").type
                yield batch

        for event in _conversations(seen(batches)):
            if event[0] == "begin":
                key, place = event[1], 0
            elif event[0] == "turn":
                out.append((key, place, *event[1:]))
                place += 1
                if len(out) >= 500:
                    yield table()
                    out = []
        if out:
            yield table()

    return _stream(rows).mapInArrow(turns, f"conv_id {id_type}, place long, letter string, role string, text string")

