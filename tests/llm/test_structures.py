"""Conversation repair, web archives and ranked search against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlake.llm import conversation_repair, ranked_search, registry, warc

from . import brute
from .test_operators import FOLDER, awkward, empty, sorted_rows  # noqa: F401

TURNS = "conv_id long, turn long, role string, text string"
REPAIRED = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def awkward_turns():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "sue", "ua"]
    texts = ["Fine.", "Yes!", "no end", "", " \t", None, "Why?  ", "a\nb.", "é.", "x" * 3000 + ".", "...", "?\x0b", "one. "]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 14)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None, -turn]), rng.choice(roles if conv % 2 else roles[:3]), rng.choice(texts)))
    rows += [(None, i, "user", f"{i}.") for i in range(6)] + [(None, None, None, None)] * 3
    rows += [(77, 1, "user", "same.")] * 300 + [(78, i, "user", "same.") for i in range(200)]
    rows += [(79, i, rng.choice(roles[:3]), f"{i}" + rng.choice([".", ""])) for i in range(300)]
    rows += [(100 + i, i, "user", "alone.") for i in range(40)]
    rng.shuffle(rows)
    return rows


def test_repair_of_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = registry.op13_conversation_repair(spark, FOLDER).select(REPAIRED).collect()
    assert sorted_rows(map(tuple, found)) == sorted_rows(brute.repaired(rows))
    assert sum(r.cost > 0 for r in found) > 10


@pytest.mark.parametrize("block", [256, 7])
def test_repair_of_awkward_conversations(spark, block, monkeypatch):
    import sys

    sys.setrecursionlimit(20000)
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rows = awkward_turns()
    table = spark.createDataFrame(rows, TURNS).select("*", *[F.lit("clash").alias(c) for c in ("kind", "digest", "place", "code", "first", "part")])
    damaged = conversation_repair.damaged(table)
    wanted = brute.repaired(rows)
    found = conversation_repair.repair(damaged).select(REPAIRED).collect()
    assert sorted_rows(map(tuple, found)) == sorted_rows(wanted)
    texts = {}
    for r in conversation_repair.repaired_turns(damaged).orderBy("conv_id", "place").collect():
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {w[0]: w[-1] for w in wanted if w[-1] != brute.sha("")} == {k: brute.sha("\n".join(v)) for k, v in texts.items()}


def test_repair_of_nothing(spark):
    table = spark.createDataFrame([], TURNS)
    assert conversation_repair.repair(conversation_repair.damaged(table)).count() == 0
    assert conversation_repair.repaired_turns(table).count() == 0


ITEMS = [(0, "alpha17 GAMMA3 delta"), (1, None), (2, ""), (3, "... !"), (4, "nowhere-to-be-found zzzz"), (5, "日本5 ε2 é"), (5, "alpha1 again"), (6, "line"), (6, "line"), (None, "beta3 beta3 Beta4"),
         (7, " ".join(f"alpha{i} gamma{i} zeta{i}" for i in range(60)))]


@pytest.mark.parametrize("sizes", [None, (4, 3, 2, 8)])
def test_ranked_search_of_awkward_documents(spark, awkward, sizes, monkeypatch):
    if sizes:
        for name, value in zip(("LEAF", "FAN", "LEVELS", "ITEM_TERMS"), sizes):
            monkeypatch.setattr(ranked_search, name, value)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").select("*", F.lit(1).alias("item"), F.lit("x").alias("terms"))
    for k in (50, 3):
        found = ranked_search.search(awkward, items, k).collect()
        assert sorted_rows(map(tuple, found)) == sorted_rows(brute.ranked([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()], ITEMS, k))


def test_ranked_search_skips_batches(spark):
    """Over the medium table most pairs are never scored, and the result is the plain one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = registry.ranked_search.search(docs, items, 10).collect()
    wanted = brute.ranked([tuple(r) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert sorted_rows(map(tuple, found)) == sorted_rows(wanted)
    (ids, lists), = ranked_search._blocks(ranked_search.item_terms(items))
    words = np.unique(np.concatenate(lists))
    vectors = ranked_search.document_vectors(docs, words)
    facts = tuple(vectors.agg(F.count("*"), F.sum("n")).first())
    df = {r.term: r.df for r in ranked_search._frequencies(vectors).collect()}
    tree = ranked_search.ItemTree(ids, [np.searchsorted(words, x) for x in lists], np.array([ranked_search.weight(facts[0], df.get(i, 0)) for i in range(len(words))]))
    seen = []
    original = ranked_search.Search

    class Counted(original):
        def best(self):
            seen.append((self.scored, self.pairs))
            return super().best()

    ranked_search.Search = Counted
    try:
        class Held:
            value = tree
        list(ranked_search._searcher(Held, facts, 10)(vectors.toArrow().to_batches()))
    finally:
        ranked_search.Search = original
    assert seen[0][0] < 0.5 * seen[0][1]


def test_ranked_search_of_nothing(spark, empty, awkward):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(empty, items).count() == 0
    assert ranked_search.search(awkward, items.limit(0)).count() == 0


PAGES = "page_id long, url string, html string"
BODY = "<html>" + "p" * 1500 + "</html>"


def awkward_pages():
    rows = [(i, f"http://a/{i}", BODY) for i in range(30)] + [(40 + i, None, None) for i in range(2)] + [(50, "", "short"), (51, "u\r\nx: y", "short"), (52, "ü", "é" * 500), (53, "ü", "é" * 500)]
    rows += [(54, "x", "é" * 499), (55, "x", "é" * 499), (60, "n", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 100), (61, "long", "z" * 3_000_000), (62, "end", "\r\n\r\n" * 400), (63, "end", "\r\n\r\n" * 400)]
    return rows + [rows[0], rows[29], (None, "null id", BODY), (None, None, "q" * 1200), (None, None, "q" * 1200), (None, None, None)]


ARCHIVED = ["page_id", "payload_bytes", "payload_digest", "type", "refers_to"]


def test_archives_of_awkward_pages(spark, tmp_path):
    rows = awkward_pages()
    pages = spark.createDataFrame(rows, PAGES).select("*", *[F.lit("clash").alias(c) for c in ("uri", "payload", "sha1", "bytes", "kind", "last")])
    path = str(tmp_path / "archives")
    warc.write_archive(warc.page_records(pages), path, archive_bytes=20_000)
    found = warc.read_archive(spark, path)
    assert found.filter("kind = 'gap'").count() == 0
    assert sorted_rows(map(tuple, found.select(ARCHIVED).collect())) == sorted_rows(brute.archived([(r[0], r[2]) for r in rows]))
    kept = {(r.page_id, r.payload.decode()) for r in found.filter("type = 'response'").collect()}
    assert kept <= {(k, h or "") for k, _, h in rows} and len(kept) == 13
    names = [r.record_id for r in found.filter("type = 'response'").collect()]
    assert {r.refers_to_id for r in found.filter("type = 'revisit'").collect()} <= set(names)
    files = [f for f in (tmp_path / "archives").rglob("*.warc.gz")]
    assert len(files) > 3
    import gzip
    assert all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n") for f in files)
    none = str(tmp_path / "none")
    warc.write_archive(warc.page_records(pages.limit(0)), none)
    assert warc.read_archive(spark, none).count() == 0


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("step", [1 << 20, 37])
def test_salvage(packed, step, monkeypatch):
    """Damage of every kind costs the damaged records only, and the bytes between are logged."""
    import gzip
    import io

    monkeypatch.setattr(warc, "STEP", step)
    rng = random.Random(2)
    plain = [_record_of(i, rng) for i in range(40)]
    parts = [gzip.compress(p) if packed else p for p in plain]
    whole = list(warc.salvage(io.BytesIO(b"".join(parts)).read))
    assert [w[3]["page_id"] for w in whole] == list(range(40)) and all(w[0] == "record" for w in whole)
    starts = [sum(map(len, parts[:i])) for i in range(41)]
    damaged, hurt = list(parts), {3, 4, 9, 15, 21, 39}
    damaged[3] = parts[3][: len(parts[3]) // 2]
    damaged[4] = parts[4][10:]
    damaged[9] = parts[9][:60] + bytes([parts[9][60] ^ 1]) + parts[9][61:]
    damaged[15] = b"\0" * len(parts[15])
    damaged[21] = parts[21][:-5] + b"#####"
    damaged[39] = parts[39][:-30]
    damaged[30] = b"garbage between\r\n" + parts[30]
    raw = b"".join(damaged)
    found = list(warc.salvage(io.BytesIO(raw).read))
    assert {f[3]["page_id"] for f in found if f[0] == "record"} >= set(range(40)) - hurt
    kept = [f[3]["page_id"] for f in found if f[0] == "record"]
    assert len(kept) == len(set(kept)) and set(kept) & {4, 15, 39} == set()
    assert sum(f[2] for f in found) == len(raw) and [f[1] for f in found] == [sum(g[2] for g in found[:i]) for i in range(len(found))]
    assert sum(f[0] == "gap" for f in found) >= 5 and all(f[3] for f in found if f[0] == "gap")
    assert starts[-1] == len(b"".join(parts))


def _record_of(i, rng):
    payload = bytes(rng.randrange(32, 126) for _ in range(rng.randrange(20, 3000)))
    import hashlib
    return warc.record_bytes(i, f"http://a/{i}", payload, hashlib.sha1(payload).hexdigest(), len(payload), None, None, "2024-01-01T00:00:00Z")


def test_damaged_archive_file(spark, tmp_path):
    """One flipped byte in one archive: its record is a gap, all others are read."""
    pages = spark.createDataFrame([(i, "u", f"{i} " + "x" * 1200) for i in range(50)], PAGES).coalesce(1)
    path = str(tmp_path / "a")
    warc.write_archive(warc.page_records(pages), path)
    file, = [f for f in (tmp_path / "a").rglob("*.warc.gz")]
    raw = bytearray(file.read_bytes())
    place = warc.read_archive(spark, path).filter("page_id = 20").first()
    raw[place.offset + place.length // 2] ^= 255
    file.write_bytes(raw)
    found = warc.read_archive(spark, path, payload=False).collect()
    assert {r.page_id for r in found if r.kind == "record"} == set(range(50)) - {20}
    assert [(r.offset, r.length) for r in found if r.kind == "gap"] == [(place.offset, place.length)]
