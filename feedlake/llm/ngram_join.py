"""Jaccard join of word n-gram sets by vertical partitioning, and the groups that its links form.

N-grams have a global order, that of their 64-bit digests. The order is cut into fragments, so each set falls into vertical segments.
Two sets of ``n`` n-grams that reach the threshold ``t`` differ in at most ``d = n * (1 - t) / t`` n-grams, so among the first ``d + 1``
non-empty segments of the one whose segments end first, one is equal in both. Equal segments therefore find every linked pair. The number of
fragments depends on the size class of the sets (powers of two); a set also shows the segments of the next class if it can
link into it. N-grams that are frequent in many tasks are left out of the segments, which changes no difference between sets upwards;
a set with too few segments left shows those of the whole set as well. So common lines make no candidates, and none is lost.

Candidates first meet as sketches, one byte for each fragment: the segments of a pair that differ are counted fragment by fragment and summed, and as
each holds at least one n-gram that is not shared, a pair with too many of them is dropped before any text is dealt out. What is left is
verified by vertical partial counts: in each of ``SLICES`` slices of the order the overlap is counted on its own, and the counts are summed per pair. Copies (equal sets) are one class. In a group of equal segments each class is first compared with one
hub, so that a group of near copies costs about one pair per member. Then only classes that are still in different components are
compared: small groups give their pairs; the members of large ones go, by the smallest class of the group and block by block, to tasks that compare all their
sketches and keep those with a likely partner; the texts of these go to tasks that sum the overlaps of all their pairs slice by slice as a matrix and give only the links. No pair that could link two components is left untested.

Rows with an empty set (null or empty text) link with nothing and are a component of their own. A component's id is its smallest document
id; null ids are passed over, and null only if there is no other. Repeated rows are copies. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .common import content_key, text_of
from .filters import digest_filter, passes
from .windows import U64, lower_bytes, mix, sequence_digests, text_chunks, word_digests, words

#: Words per n-gram and least similarity in percent, for near duplicates; the registered query states its own.
GRAM, PERCENT = 5, 80
SLICES = 4
#: An n-gram is called frequent if it is in so many texts of one chunk of a task and in so many texts in all; at most ``FREQUENT`` are kept.
LOCAL_TEXTS, ALL_TEXTS, FREQUENT = 3, 32, 50_000
STAR_ROUNDS = 2
#: Groups of more classes are compared by blocks of at most so many classes and n-grams, so many n-grams at a time.
LARGE, BLOCK_CLASSES, BLOCK_GRAMS, MATRIX_GRAMS = 16, 1024, 500_000, 4096
GROUPS = 4
PAIRS_PER_GROUP = 512


def gram_sets(data: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the distinct n-grams of each text, ascending within a text, and where each text's set starts and the last ends."""
    data = lower_bytes(data)
    starts, ends, text = words(data, offsets)
    digests = word_digests(data, starts, ends)
    n = max(len(starts) - gram + 1, 0)
    found, owner = sequence_digests(digests, gram), text[:n]
    whole = owner == text[gram - 1 :] if n else np.zeros(0, bool)
    found, owner = found[whole], owner[whole]
    counts = np.bincount(text, minlength=len(offsets) - 1)
    # A text of fewer words is one n-gram of its own length.
    short = np.flatnonzero((counts > 0) & (counts < gram))
    if len(short):
        first = np.searchsorted(text, short)
        single = np.array([sequence_digests(digests[a : a + c], c)[0] ^ U64(c) for a, c in zip(first.tolist(), counts[short].tolist())], U64)
        found, owner = np.concatenate([found, single]), np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])]) if len(found) else np.zeros(0, bool)
    found, owner = found[new], owner[new]
    return found, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(offsets) - 1))])


def class_digest(digests: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(digests.tobytes()))))


def fragments(size_class: int, percent: int) -> int:
    """Number of fragments for sets of ``2 ** size_class`` n-grams and up to twice as many."""
    return max(64, (3 * (1 << size_class) * (100 - percent)) // percent + 1)


def _segments(digests: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Fragment and digest of each non-empty segment of a set, in order."""
    fragment = ((digests >> U64(32)) * U64(count)) >> U64(32)
    first = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
    return fragment[first], np.add.reduceat(mix(digests), first)


def signatures(digests: np.ndarray, frequent: np.ndarray, percent: int) -> list[np.ndarray]:
    """Digests that two linked, different sets share at least one of."""
    n = len(digests)
    differ = n * (100 - percent) // percent
    size_class = n.bit_length() - 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, digests), len(frequent) - 1)
        rare = digests[frequent[at] != digests]
    else:
        rare = digests
    found = []
    for c in (size_class, size_class + 1):
        if c > size_class and 100 * n < percent * (1 << c):
            continue
        count = fragments(c, percent)
        for label, tokens in ((0, rare), (1, digests)):
            if not len(tokens):
                continue
            fragment, segment = _segments(tokens, count)
            found.append(mix(segment ^ mix(fragment + U64((2 * c + label) << 32)))[: differ + 1])
            if len(fragment) > differ:
                break  # enough segments: those of the whole set are not needed
        else:
            # Sets without enough segments even so meet in one group per class.
            found.append(mix(np.array([c], U64) + U64(0xA5A5 << 40)))
    return found


def set_table(docs: DataFrame, gram: int, text: str, key: str) -> tuple[DataFrame, np.ndarray]:
    """One row per document: ``id``, ``at`` (its content key), size ``n`` and ``cls`` (null if empty), written once; and the frequent n-grams."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            sizes, classes = [], []
            for _, _, data, offsets in text_chunks(batch.column(2)):
                found, cut = gram_sets(data, offsets, gram)
                sizes += np.diff(cut).tolist()
                classes += [class_digest(found[a:b]) if b > a else None for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                grams, counts = np.unique(found, return_counts=True)
                often = counts >= LOCAL_TEXTS
                for g, c in zip(grams[often].tolist(), counts[often].tolist()):
                    seen[g] = seen.get(g, 0) + c
                if len(seen) > 8 * FREQUENT:
                    seen = dict(sorted(seen.items(), key=lambda x: -x[1])[:FREQUENT])
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), none], _SET_NAMES)
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]
        if top:
            grams = pa.array(np.array([g for g, _ in top], np.uint64).view(np.int64), pa.int64())
            none = pa.nulls(len(top))
            yield pa.RecordBatch.from_arrays(
                [none.cast(pa.int64()), none.cast(pa.string()), pa.array([c for _, c in top], pa.int64()), none.cast(pa.int64()), grams], _SET_NAMES)

    rows = docs.select(F.col(key).cast("long").alias("id"), content_key(key, text_of(text)).alias("at"), text_of(text).alias("_text"))
    made = materialize(rows.mapInArrow(measure, "id long, at string, n long, cls long, gram long"))
    often = made.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= ALL_TEXTS)
    often = often.orderBy(F.col("n").desc(), "gram").limit(FREQUENT).select("gram").toArrow().column("gram")
    frequent = np.sort(often.to_numpy().astype(np.int64).view(np.uint64)) if len(often) else np.zeros(0, np.uint64)
    return made.filter("gram IS NULL").drop("gram"), frequent


_SET_NAMES = ["id", "at", "n", "cls", "gram"]


def shared_segments(docs: DataFrame, frequent: np.ndarray, gram: int, percent: int, text: str) -> DataFrame:
    """(sig, cls, n) of all segments that at least two classes have."""
    parts = GROUPS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compress = lambda *arrays: zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            if not sigs:
                return
            sig = np.concatenate(sigs)
            cls, n = (np.repeat(np.array(x, np.int64), lengths) for x in (classes, sizes))
            part = (sig % U64(parts)).astype(np.int64)
            order = np.lexsort((cls, sig, part))
            sig, cls, n, part = sig[order], cls[order], n[order], part[order]
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])])
            sig, cls, n, part = sig[new], cls[new], n[new], part[new]
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            rows = [(int(part[a]), compress(sig[a:b], cls[a:b], n[a:b]), b - a) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.int64()))], ["part", "packed", "m"])

        sigs, lengths, classes, sizes, total = [], [], [], [], 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                found, cut = gram_sets(data, offsets, gram)
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    if a == b:
                        continue
                    own = np.concatenate(signatures(found[a:b], frequent, percent))
                    sigs.append(own)
                    lengths.append(len(own))
                    classes.append(class_digest(found[a:b]))
                    sizes.append(b - a)
                    total += len(own)
                if total > 1_500_000:
                    yield from flush()
                    sigs, lengths, classes, sizes, total = [], [], [], [], 0
        yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        values, counts = table.column("packed").to_pylist(), table.column("m").to_pylist()
        raw = [zstandard.ZstdDecompressor().decompress(v) for v in values]
        sig = np.concatenate([np.frombuffer(r, np.uint64, m) for r, m in zip(raw, counts)])
        cls = np.concatenate([np.frombuffer(r, np.int64, m, 8 * m) for r, m in zip(raw, counts)])
        n = np.concatenate([np.frombuffer(r, np.int64, m, 16 * m) for r, m in zip(raw, counts)])
        order = np.lexsort((cls, sig))
        sig, cls, n = sig[order], cls[order], n[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])])
        sig, cls, n = sig[new], cls[new], n[new]
        group = np.cumsum(np.concatenate([[True], sig[1:] != sig[:-1]])) - 1
        several = np.bincount(group)[group] > 1
        return pa.table({"sig": sig[several].view(np.int64), "cls": cls[several], "n": n[several]})

    packed = docs.select(text_of(text).alias("_text")).mapInArrow(show, "part int, packed binary, m long")
    return packed.groupBy("part").applyInArrow(meet, "sig long, cls long, n long")


def _close(n: str, m: str, percent: int):
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _passing(rows: DataFrame, wanted: DataFrame, digest: str) -> DataFrame:
    """The rows but for those whose digest, their first column, is surely not among the wanted ones."""
    bits = rows.sparkSession.sparkContext.broadcast(digest_filter(wanted, digest))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits.value, batch.column(0).to_numpy())))

    return rows.mapInArrow(choose, rows.schema)


def candidate_texts(classes: DataFrame, sets: DataFrame, docs: DataFrame, gram: int, text: str, key: str) -> DataFrame:
    """(cls, _text): a text of each class that may take part in a pair, written once. Only texts that pass the filter are dealt out."""
    one = sets.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("at").alias("at")).join(classes.distinct(), "cls", "left_semi")
    holders = materialize(one.select("cls", "at", F.xxhash64("at").alias("h")))
    rows = docs.select(F.xxhash64(content_key(key, text_of(text))).alias("h"), content_key(key, text_of(text)).alias("at"), text_of(text).alias("_text"))
    chosen = _passing(rows, holders, "h").select("at", "_text")
    # A row that repeats gives its text twice, which does no harm.
    return materialize(chosen.join(holders.select("cls", "at"), "at").select("cls", "_text"))


def _layouts(n: int, percent: int) -> list[int]:
    """The size classes in which a set of ``n`` n-grams is compared: its own, and the next if it can link into it."""
    own = n.bit_length() - 1
    return [own] + [own + 1] * (100 * n >= percent * (2 << own))


def sketch_table(texts: DataFrame, gram: int, percent: int) -> DataFrame:
    """(cls, layout, sketch): for each size class a byte per fragment, 0 where it is empty, written once."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = batch.column(0).to_pylist()
            for lo, _, data, offsets in text_chunks(batch.column(1)):
                found, cut = gram_sets(data, offsets, gram)
                rows = []
                for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist()), lo):
                    for layout in _layouts(b - a, percent) if b > a else []:
                        fragment, segment = _segments(found[a:b], fragments(layout, percent))
                        sketch = np.zeros(fragments(layout, percent), np.uint8)
                        sketch[fragment.astype(np.int64)] = mix(segment) % U64(255) + U64(1)
                        rows.append((classes[i], layout, sketch.tobytes()))
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["cls", "layout", "sketch"])

    return materialize(texts.select("cls", "_text").mapInArrow(draw, "cls long, layout int, sketch binary"))


def likely_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose differing segments do not exclude that they reach the threshold; written."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8) for c in ("x", "y"))
                lengths = pa.compute.binary_length(part.column("x")).to_numpy()
                differ = np.add.reduceat((x != y).astype(np.int64), np.cumsum(lengths) - lengths)
                sizes = part.column("na").to_numpy() + part.column("nb").to_numpy()
                yield part.select(["a", "b", "na", "nb"]).filter(pa.array(differ * (100 + percent) <= sizes * (100 - percent)))

    size_class = lambda c: F.length(F.bin(c)) - 1
    placed = pairs.withColumn("layout", F.greatest(size_class("na"), size_class("nb")))
    met = placed.join(sketches.select(F.col("cls").alias("a"), "layout", F.col("sketch").alias("x")), ["a", "layout"])
    met = met.join(sketches.select(F.col("cls").alias("b"), "layout", F.col("sketch").alias("y")), ["b", "layout"])
    return materialize(met.select("a", "b", "na", "nb", "x", "y").mapInArrow(compare, "a long, b long, na long, nb long").distinct())


def verify(pairs: DataFrame, texts: DataFrame, gram: int, percent: int) -> DataFrame:
    """The pairs of classes (a, b) that reach the threshold, by partial overlaps per slice of the order, summed per pair.

    The texts of a pair meet in the group of its first class; a class with very many pairs has several such groups.
    """
    parts = GROUPS * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_GROUP).cast("int").alias("shares"))
    placed = pairs.select("a", "b").join(shares, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"))
    uses = placed.select("a", "share", F.col("b").alias("cls")).unionByName(placed.select("a", "share", F.col("a").alias("cls")).distinct())
    part = F.pmod(F.xxhash64("a", "share"), F.lit(parts)).cast("int")
    # Few of the texts are in a pair that got so far; the others are not dealt out.
    rows = uses.join(_passing(texts.select("cls", "_text"), uses, "cls"), "cls").select(part.alias("part"), "a", "share", "cls", "_text")
    borders = np.arange(1, SLICES, dtype=np.uint64) * U64((1 << 64) // SLICES)

    def count(table: pa.Table) -> pa.Table:
        hubs, share, cls = (table.column(c).to_numpy() for c in ("a", "share", "cls"))
        sets: list[np.ndarray] = []
        for _, _, data, offsets in text_chunks(table.column("_text").combine_chunks()):
            found, cut = gram_sets(data, offsets, gram)
            sets += [found[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
        at = {(a, s): i for i, (a, s, c) in enumerate(zip(hubs.tolist(), share.tolist(), cls.tolist())) if a == c}
        links = []
        for i, (a, s, c) in enumerate(zip(hubs.tolist(), share.tolist(), cls.tolist())):
            if a != c:
                x, y = sets[at[a, s]], sets[i]
                partial = [len(np.intersect1d(u, v, assume_unique=True))
                           for u, v in zip(np.split(x, np.searchsorted(x, borders)), np.split(y, np.searchsorted(y, borders)))]
                if sum(partial) * 100 >= (len(x) + len(y) - sum(partial)) * percent:
                    links.append((a, c))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return rows.groupBy("part").applyInArrow(count, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(cls, component) for all ends of the links: the smallest class that each reaches, by passing minima on and jumping."""
    both = materialize(links.union(links.select("b", "a")).distinct().toDF("cls", "other"))
    label = materialize(both.groupBy("cls").agg(F.least(F.min("other"), F.first("cls")).alias("component")))
    while True:
        seen = both.join(label.withColumnsRenamed({"cls": "other", "component": "theirs"}), "other").groupBy("cls").agg(F.min("theirs").alias("theirs"))
        moved = label.join(seen, "cls").select("cls", F.least("component", "theirs").alias("near"), F.col("component").alias("before"))
        # Jump: take the label of the label. Labels are classes, so they have one.
        jump = label.withColumnsRenamed({"cls": "near", "component": "far"})
        new = materialize(moved.join(jump, "near", "left").select("cls", F.least("near", F.coalesce("far", "near")).alias("component"), "before"))
        label = new.select("cls", "component")
        if new.filter("component <> before").isEmpty():
            return label


def _pairs(found: DataFrame, tested: DataFrame | None, percent: int) -> DataFrame:
    """Distinct pairs of (h, hn) and (cls, n) that are near enough in size and not yet tested; written, so that their size is known."""
    found = found.filter(_close("n", "hn", percent))
    low, high = F.struct(F.col("h").alias("c"), F.col("hn").alias("n")), F.struct(F.col("cls").alias("c"), F.col("n").alias("n"))
    pairs = found.select(F.least(low, high).alias("l"), F.greatest(low, high).alias("r"))
    pairs = pairs.select(F.col("l.c").alias("a"), F.col("r.c").alias("b"), F.col("l.n").alias("na"), F.col("r.n").alias("nb")).distinct()
    return materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))


def _placed(members: DataFrame) -> DataFrame:
    """The members (family, cls, component, n) in every pair of blocks ``i``, ``j`` of their family that their ``own`` block is in."""
    sizes = members.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("grams"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_CLASSES, F.col("grams") / BLOCK_GRAMS)).cast("int")
    placed = members.join(sizes.select("family", blocks.alias("blocks")), "family").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("family", "cls", "component", "n", "own", other)
    return placed.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "component", "n")


def _sift(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b) that join the classes of a family that have a likely partner of another component to their partners: one row per class and pair of blocks."""

    def compare(table: pa.Table) -> pa.Table:
        cls, component, n = (table.column(c).to_numpy() for c in ("cls", "component", "n"))
        layout, sketch = table.column("layout").to_numpy(), table.column("sketch").to_pylist()
        own = np.array([int(x).bit_length() - 1 for x in n.tolist()])
        joined = np.unique(cls, return_inverse=True)[1]
        first = joined.copy()
        for c in np.unique(layout).tolist():
            at = np.flatnonzero(layout == c)
            bytes_ = np.frombuffer(b"".join(sketch[i] for i in at.tolist()), np.uint8).reshape(len(at), -1)
            for k in range(len(at)):
                differ = (bytes_ != bytes_[k]).sum(1)
                near = (differ * (100 + percent) <= (n[at] + n[at[k]]) * (100 - percent)) & (component[at] != component[at[k]])
                near &= np.maximum(own[at], own[at[k]]) == c
                if near.any():
                    met = np.unique(np.append(joined[at[near]], joined[at[k]]))
                    joined[np.isin(joined, met)] = met[0]
        order = np.unique(cls)
        moved = joined != first
        return pa.table({"a": order[joined[moved]], "b": cls[moved]})

    return materialize(_placed(members).join(sketches, "cls").groupBy("family", "i", "j").applyInArrow(compare, "a long, b long").distinct())


def _block_links(members: DataFrame, texts: DataFrame, sketches: DataFrame, gram: int, percent: int) -> DataFrame | None:
    """Links (a, b) between classes of one family and of different components; ``members`` is (family, cls, component, n). None if no pair is likely.

    The sketch of each class is sent to the tasks of all pairs of blocks that its own block is in. Classes that likely pairs join are a family of
    their own, so that a text is sent for one family only, in however many the class was before.
    """
    likely = _sift(members, sketches, percent)
    if likely.isEmpty():
        return None
    family = components(likely).withColumnRenamed("component", "family")
    kept = materialize(members.select("cls", "component", "n").distinct().join(family, "cls").select("family", "cls", "component", "n"))

    def compare(table: pa.Table) -> pa.Table:
        cls, component, own = (table.column(c).to_numpy() for c in ("cls", "component", "own"))
        last = int(table.column("j")[0].as_py())
        grams, lengths = [], []
        for _, _, data, offsets in text_chunks(table.column("_text").combine_chunks()):
            found, cut = gram_sets(data, offsets, gram)
            grams.append(found)
            lengths += np.diff(cut).tolist()
        tokens, n = np.concatenate(grams), np.array(lengths, np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = counts[inverse] > 1
        column = (np.cumsum(counts > 1) - 1)[inverse[shared]]
        row, common = owner[shared], np.zeros((len(n), len(n)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, MATRIX_GRAMS):
            a, b = np.searchsorted(column, (lo, lo + MATRIX_GRAMS))
            part = np.zeros((len(n), MATRIX_GRAMS), np.float32)
            part[row[a:b], column[a:b] - lo] = 1
            common += part @ part.T
        x, y = np.nonzero(common.astype(np.int64) * (100 + percent) >= (n[:, None] + n[None, :]) * percent)
        kept = (cls[x] < cls[y]) & (component[x] != component[y]) & ((own[x] != own[y]) | (own[x] == last) & (table.column("i")[0].as_py() == last))
        return pa.table({"a": cls[x[kept]], "b": cls[y[kept]]})

    placed = _placed(kept).join(_passing(texts.select("cls", "_text"), kept, "cls"), "cls")
    return placed.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def link_documents(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``id``, ``at`` (content key), ``n_shingles`` and ``component_id``."""
    sets, frequent = set_table(docs, gram, text, key)
    shared = materialize(shared_segments(docs, frequent, gram, percent, text))
    texts = candidate_texts(shared.select("cls"), sets, docs, gram, text, key)
    sketches = sketch_table(texts, gram, percent)
    tested = links = label = None

    def labelled() -> DataFrame:
        """Segments with the component of each class, a class of its own if it has no link."""
        if label is None:
            return shared.withColumn("component", F.col("cls"))
        return shared.join(label, "cls", "left").withColumn("component", F.coalesce("component", "cls"))

    def take(pairs: DataFrame) -> None:
        nonlocal tested, links, label
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        likely = likely_pairs(pairs, sketches, percent)
        if not likely.isEmpty():
            linked = materialize(verify(likely, texts, gram, percent))
            links = linked if links is None else links.union(linked)
            label = components(links)

    for _ in range(STAR_ROUNDS):
        known = labelled()
        hub = known.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by(F.struct("cls", "n"), "component").alias("hub"))
        hub = hub.filter("low < high").select("sig", "low", F.col("hub.cls").alias("h"), F.col("hub.n").alias("hn"))
        take(_pairs(known.join(hub, "sig").filter(F.col("component") != F.col("low")), tested, percent))
    known = labelled()
    # A large group's family is its smallest class, whose groups have most classes in common. Groups are not joined by all classes they share: chains of
    # groups grow much faster than the input, and only members of one group can be a pair.
    split = known.groupBy("sig").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("cls").alias("family"))
    split = materialize(known.join(split.filter("low < high").select("sig", "m", "family"), "sig"))
    small, large = split.filter(F.col("m") <= LARGE), split.filter(F.col("m") > LARGE)
    if not large.isEmpty():
        members = materialize(large.select("family", "cls", "component", "n").distinct())
        likely = _block_links(members, texts, sketches, gram, percent)
        if likely is not None:
            linked = materialize(likely)
            links = linked if links is None else links.union(linked)
    mine = small.select("sig", F.col("cls").alias("h"), F.col("n").alias("hn"), F.col("component").alias("hc"))
    take(_pairs(small.join(mine, "sig").filter(F.col("hc") < F.col("component")), tested, percent))
    if links is not None:
        label = components(links)
    rows = sets
    if label is None:
        rows = rows.withColumn("component", F.col("cls"))
    else:
        rows = rows.join(label, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    # Rows without a set keep their own id; the groups are made over the others, by partial minima.
    smallest = rows.filter("cls IS NOT NULL").groupBy("component").agg(F.min("id").alias("smallest"))
    return rows.join(smallest, "component", "left").select(
        "id", "at", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("smallest")).alias("component_id"))


def keep_one(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each group, that with the smallest id, with the columns it came with; repeated rows are one document."""
    found = materialize(link_documents(docs, gram, percent, text, key).withColumn("h", F.xxhash64("at")))
    stays = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("at").agg(F.first("h").alias("h"), F.count("*").alias("rows"))
    # Rows that go, or that repeat, have their bit set; all others stay where they are and are not dealt out.
    once = stays.filter("rows = 1").select(F.col("at").alias("_at"))
    leaves = found.select("at", "h").join(once, F.col("at") == F.col("_at"), "left_anti")
    bits = docs.sparkSession.sparkContext.broadcast(digest_filter(leaves, "h"))

    @F.arrow_udf("boolean")
    def may_leave(h: pa.Array) -> pa.Array:
        return pa.array(passes(bits.value, h.to_numpy()))

    key_ = content_key(key, text_of(text))
    rows = docs.select(F.struct("*").alias("row"), key_.alias("_at"), may_leave(F.xxhash64(key_)).alias("_leaves"))
    sure = rows.filter(~F.col("_leaves")).select("row.*")
    asked = rows.filter("_leaves").join(stays.select(F.col("at").alias("_at")), "_at", "left_semi").dropDuplicates(["_at"]).select("row.*")
    return sure.unionByName(asked)
