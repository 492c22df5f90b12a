"""Ranked lexical search: the highest-scoring documents of each item, exact, by a dual-tree search.

Documents are read once into vectors of the terms that some item has (``document_vectors``, a written table). The items stand in a tree: a
node holds the union of its items' terms, the coordinate maxima of their 0/1 vectors. Every ``LEAF * FAN ** LEVELS`` documents of a task stand in a tree,
too: a node holds, for each term, the largest contribution of its documents. The product of two nodes' maxima bounds the score of every
pair below them. If the bound is under the weakest k-th score of the node's items so far, the whole batch of pairs is skipped; else both
nodes are opened. What is left are leaves, whose pairs are scored. A task keeps the k-th scores from tree to tree and gives its k best
per item; the best of all tasks are ranked. A bound that equals the k-th score does not skip, as a tie may go to a smaller id.

Items are searched in blocks of at most ``ITEM_TERMS`` terms (an item with more is a block), which bounds what is broadcast and what a task
holds; more blocks mean more passes over the documents. Terms are known by 64-bit digests of their bytes.

Null texts have no terms. An item without terms, or none of whose terms is in a document, gives no rows. Items with the same id and text are
one item; items with the same id and different texts are searched one by one. Repeated documents are ranked each; a document without an id
comes last among equal scores. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .common import text_of
from .windows import lower_bytes, text_chunks, word_digests

#: Documents in a leaf, and children of an inner node of either tree; inner levels of documents.
LEAF, FAN, LEVELS = 8, 8, 3
#: Terms of a block of items: 2 MB of digests.
ITEM_TERMS = 1 << 18
_LAST = np.iinfo(np.int64).max


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digest and text number of every term: a maximal run of letters and digits of ASCII and of all other characters, A-Z in lower case."""
    data = lower_bytes(data)
    inner = (data >= 128) | ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122))
    n = len(data)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before, after = np.concatenate([[False], inner])[:n], np.concatenate([inner, [False]])[1:]
    starts = np.flatnonzero(inner & (~before | border[:n]))
    ends = np.flatnonzero(inner & (~after | border[1:])) + 1
    return word_digests(data, starts, ends).astype(np.int64), np.searchsorted(offsets, starts, side="right") - 1


def _distinct(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct terms, sorted, and how often they occur."""
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (term[1:] != term[:-1])])) if len(text) else np.zeros(0, np.int64)
    return text[new], term[new], np.diff(np.concatenate([new, [len(text)]]))


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """One list per owner from 0 to n - 1; the owners are sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item`` (a number that tells items apart), ``item_id`` and the sorted distinct ``terms``, as a written table."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                digests, owner = terms(data, offsets)
                owner, digests, _ = _distinct(owner, digests)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(digests, owner, hi - lo, pa.int64())], ["item_id", "terms"])

    rows = items.select(F.col(key).cast("long").alias("item_id"), text_of(text).alias("text")).distinct()
    found = rows.mapInArrow(read, "item_id long, terms array<long>").filter(F.size("terms") > 0)
    return materialize(found.select(F.monotonically_increasing_id().alias("item"), "item_id", "terms"))


def document_vectors(docs: DataFrame, vocabulary: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every document with terms: ``doc_id``, ``n`` (its terms with repeats), and the numbers and counts of those in the sorted vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = known.value
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                digests, owner = terms(data, offsets)
                n = np.bincount(owner, minlength=hi - lo)
                at = np.minimum(np.searchsorted(vocabulary, digests), len(vocabulary) - 1)
                hit = vocabulary[at] == digests
                owner, number, count = _distinct(owner[hit], at[hit])
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), _lists(number, owner, hi - lo, pa.int32()), _lists(count, owner, hi - lo, pa.int32())],
                    ["doc_id", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return materialize(rows.mapInArrow(read, "doc_id long, n long, terms array<int>, counts array<int>"))


def _frequencies(vectors: DataFrame) -> DataFrame:
    """``(term, df)`` of the terms that occur: counted per batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(n, pa.int64())], ["term", "n"])

    return vectors.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("df"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class ItemTree:
    """A block of items, each a list of term numbers, and levels of nodes from the root to the leaves (one item each)."""

    def __init__(self, ids: list[int], lists: list[np.ndarray], weights: np.ndarray):
        self.weights = weights
        # Items that share their heaviest terms lie next to each other.
        order = sorted(range(len(ids)), key=lambda i: lists[i][np.argsort(-weights[lists[i]], kind="stable")].tolist())
        self.ids = [ids[i] for i in order]
        self.levels = [[lists[i] for i in order]]
        while len(self.levels[0]) > 1:
            below = self.levels[0]
            self.levels.insert(0, [np.unique(np.concatenate(below[i : i + FAN])) for i in range(0, len(below), FAN)])
        self.flat = [np.concatenate(nodes) for nodes in self.levels]
        self.starts = [np.cumsum([0, *[len(t) for t in nodes]]) for nodes in self.levels]

    def gathered(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of some nodes of a level, one after another, and where each node's begin."""
        if len(nodes) == len(self.levels[level]):
            return self.flat[level], self.starts[level][:-1]
        lengths = np.diff(self.starts[level])[nodes]
        begins = np.cumsum(lengths) - lengths
        return self.flat[level][np.arange(lengths.sum()) + np.repeat(self.starts[level][nodes] - begins, lengths)], begins


class Search:
    """The k best documents of each item of a tree, over trees of documents that come one after another."""

    def __init__(self, items: ItemTree, k: int):
        self.items, self.k = items, k
        n = len(items.ids)
        # An empty place holds score 0 and the last id: a score above 0 always takes it.
        self.scores, self.docs = np.zeros((n, k), np.int64), np.full((n, k), _LAST)
        self.none = np.zeros((n, k), bool)
        self.board = np.zeros(len(items.weights), np.int64)
        self.leaf_board = np.zeros((len(items.weights), LEAF), np.int64)
        self.pairs = self.scored = 0

    def weakest(self) -> list[np.ndarray]:
        """Per level and node: the weakest k-th score of its items."""
        found = [self.scores[:, -1]]
        while len(found) < len(self.items.levels):
            below = found[0]
            found.insert(0, np.minimum.reduceat(below, np.arange(0, len(below), FAN)))
        return found

    def add(self, docs: np.ndarray, nulls: np.ndarray, owner: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Documents with the contributions of the block's terms, sorted by owner, then term."""
        # Documents whose largest contributions come from the same term lie next to each other.
        n, by_value = len(docs), np.lexsort((value, owner))
        top = term[by_value][np.searchsorted(owner, np.arange(n), side="right") - 1]
        order = np.lexsort((docs, top))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        owner = place[owner]
        by_owner = np.argsort(owner, kind="stable")
        owner, term, value = owner[by_owner], term[by_owner], value[by_owner]
        docs, nulls = docs[order], nulls[order]
        levels = [(owner // LEAF, term, value)]
        for _ in range(LEVELS + 1):
            node, t, v = levels[0]
            by_term = np.lexsort((t, node))
            node, t, v = node[by_term], t[by_term], v[by_term]
            new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (t[1:] != t[:-1])]))
            maxima = node[new], t[new], np.maximum.reduceat(v, new)
            levels[0] = maxima
            levels.insert(0, (maxima[0] // FAN, maxima[1], maxima[2]))
        levels.pop(0)
        self.pairs += n * len(self.items.ids)
        bounds = [np.searchsorted(level[0], np.arange(level[0][-1] + 2)) for level in levels]
        at_leaf = np.searchsorted(owner, np.arange(0, n + LEAF, LEAF))
        for node in range(len(bounds[0]) - 1):
            self._visit(0, node, 0, np.arange(len(self.items.levels[0])), levels, bounds, (docs, nulls, owner, term, value, at_leaf))

    def _visit(self, level: int, node: int, depth: int, nodes: np.ndarray, levels, bounds, leaves) -> None:
        """A document node against item nodes of one level: what cannot be skipped is opened on both sides."""
        _, term, value = levels[level]
        a, b = bounds[level][node], bounds[level][node + 1]
        self.board[term[a:b]] = value[a:b]
        last = len(self.items.levels) - 1
        bottom = level == len(levels) - 1
        weakest = self.weakest()
        while True:
            flat, begins = self.items.gathered(depth, nodes)
            bound = np.add.reduceat(self.board[flat], begins)
            nodes = nodes[(bound >= weakest[depth][nodes]) & (bound > 0)]
            # Of item nodes one level is opened per document level, and all that are left at the documents' leaves.
            if depth == last or not len(nodes):
                break
            depth, nodes = depth + 1, (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            nodes = nodes[nodes < len(self.items.levels[depth])]
            if not bottom:
                break
        self.board[term[a:b]] = 0
        if not len(nodes):
            return
        if bottom:
            self._score(node, nodes, leaves)
            return
        n_children = len(bounds[level + 1]) - 1
        for child in range(node * FAN, min(node * FAN + FAN, n_children)):
            self._visit(level + 1, child, depth, nodes, levels, bounds, leaves)

    def _score(self, leaf: int, items: np.ndarray, leaves) -> None:
        docs, nulls, owner, term, value, at_leaf = leaves
        a, b = at_leaf[leaf], at_leaf[leaf + 1]
        lo, hi = leaf * LEAF, min(leaf * LEAF + LEAF, len(docs))
        board = self.leaf_board[:, : hi - lo]
        board[term[a:b], owner[a:b] - lo] = value[a:b]
        flat, begins = self.items.gathered(len(self.items.levels) - 1, items)
        scores = np.add.reduceat(board[flat], begins, axis=0)
        board[term[a:b], owner[a:b] - lo] = 0
        self.scored += scores.size
        good = (scores > 0) & (scores >= self.scores[items, -1][:, None])
        for i in np.flatnonzero(good.any(1)).tolist():
            item, chosen = items[i], np.flatnonzero(good[i])
            score = np.concatenate([self.scores[item], scores[i, chosen]])
            doc = np.concatenate([self.docs[item], docs[lo + chosen]])
            none = np.concatenate([self.none[item], nulls[lo + chosen]])
            best = np.lexsort((doc, none, -score))[: self.k]
            self.scores[item], self.docs[item], self.none[item] = score[best], doc[best], none[best]

    def best(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for i, item in enumerate(self.items.ids):
            found = self.scores[i] > 0
            yield item, self.docs[i][found], self.none[i][found], self.scores[i][found]


def _searcher(block, facts: tuple[int, int], k: int):
    """Search of one block of items over the vectors of a task, a tree of documents at a time."""
    n_docs, total = facts
    size = LEAF * FAN**LEVELS

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Search(block.value, k)
        tree = state.items

        def add(batch: pa.RecordBatch) -> None:
            lists, tf = batch.column(2), batch.column(3).flatten().to_numpy().astype(np.int64)
            at = lists.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            if not len(owner):
                return
            n = batch.column(1).to_numpy()
            m = 100 - 50 + (50 * n * n_docs) // total
            value = tree.weights[at] * ((1000000000 * tf) // (1000 * tf + 20 * m[owner]))
            rows, owner = np.unique(owner, return_inverse=True)
            ids = batch.column(0)
            docs = ids.fill_null(_LAST).to_numpy()[rows]
            state.add(docs, ids.is_null().to_numpy(zero_copy_only=False)[rows], owner, at, value)

        for batch in batches:
            for i in range(0, batch.num_rows, size):
                add(batch.slice(i, size))
        for item, docs, none, scores in state.best():
            columns = [pa.array(np.full(len(docs), item), pa.int64()), pa.array(docs, pa.int64(), mask=none), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return search


def _blocks(asked: DataFrame) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """The items in blocks of at most ``ITEM_TERMS`` terms, read one after another."""
    ids, lists, size = [], [], 0
    for r in asked.select("item", "terms").toLocalIterator():
        if ids and size + len(r.terms) > ITEM_TERMS:
            yield ids, lists
            ids, lists, size = [], [], 0
        ids.append(r.item)
        lists.append(np.array(r.terms, np.int64))
        size += len(r.terms)
    if ids:
        yield ids, lists


def _search_block(docs: DataFrame, ids: list[int], lists: list[np.ndarray], k: int) -> DataFrame:
    """``item``, ``doc_id``, ``score``: the best of every task."""
    vocabulary = np.unique(np.concatenate(lists))
    vectors = document_vectors(docs, vocabulary)
    n_docs, total = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = _frequencies(vectors).toArrow()  # at most one row per term of the block
    df = np.zeros(len(vocabulary), np.int64)
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    tree = ItemTree(ids, [np.searchsorted(vocabulary, x) for x in lists], weights)
    block = docs.sparkSession.sparkContext.broadcast(tree)
    return vectors.mapInArrow(_searcher(block, (n_docs, total), k), "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id``, ``rank`` from 1, ``doc_id``, ``score``: the ``k`` documents with the highest scores above 0 of each item."""
    asked = item_terms(items)
    both = docs.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    for ids, lists in _blocks(asked):
        both = both.unionByName(_search_block(docs, ids, lists, k))
    ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = both.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
