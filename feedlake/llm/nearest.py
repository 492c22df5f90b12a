"""Approximate nearest neighbours by collision counting.

The measure is the inner product. With ``m`` the largest length of a vector, a vector ``x`` gets one more component, the root of
``m * m - x.x``, and a query gets 0: then the largest inner product is the smallest distance. Each of ``LINES`` random lines has its own
array of all vectors sorted by their projection. A query looks at a window around its own projection on every line; a vector
that lies in the windows of at least ``threshold`` lines is verified with its exact inner product. If too few vectors are verified,
the windows grow by ``GROWTH`` (virtual rehashing: the arrays stay, only the bounds move) and the search goes on where it stopped.

The vectors are dealt out into blocks of about ``BLOCK_ROWS`` and the queries into blocks of about ``QUERY_ROWS``; each pair of blocks
is one task of bounded memory, with the sorted arrays of its vectors. A block gives its ``k`` best per query, and the best of all
blocks are ranked. Every vector is in the index, whatever the size.

Vectors that are null, zero, or hold null or non-finite components take no part; a query meets the vectors of its own length. Ties go to
the smaller id; rows with a null id take no part; repeated ids are candidates of their own, and a query is asked once per id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines; the part of them on which a vector must lie in the window; half the first window in standard deviations; growth of a window.
LINES, COLLISIONS, START, GROWTH = 48, 0.6, 1.1, 1.1
#: Part of a block that is verified at least before the windows stop growing, and the fewest vectors.
VERIFIED, FEWEST = 0.33, 400
BLOCK_ROWS, QUERY_ROWS = 8192, 2048
SEED = 11


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _search(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, longest: float) -> Iterator[tuple]:
    """The ``k`` best found of one block for each query: (query id, ids, scores)."""
    n, d = points.shape
    lines = np.random.default_rng(SEED).normal(size=(d + 1, LINES))
    tail = np.sqrt(np.maximum(longest * longest - (points * points).sum(1), 0))
    places = (points @ lines[:d] + np.outer(tail, lines[d])).T
    order = np.argsort(places, axis=1, kind="stable").astype(np.int32)
    arrays = np.take_along_axis(places, order, 1)
    spread = places.std(1) + 1e-12
    asked = (queries @ lines[:d]).T
    wanted, threshold = min(n, max(FEWEST, 10 * k, int(VERIFIED * n))), int(COLLISIONS * LINES)

    def window(step: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of all queries on all lines after so many growths."""
        half = spread * START * GROWTH**step
        low = np.stack([np.searchsorted(a, x - h) for a, x, h in zip(arrays, asked, half)])
        return low, np.stack([np.searchsorted(a, x + h, side="right") for a, x, h in zip(arrays, asked, half)])

    steps = [window(0)]
    for q in range(len(query_ids)):
        low, high = steps[0][0][:, q], steps[0][1][:, q]
        counts = np.bincount(np.concatenate([o[a:b] for o, a, b in zip(order, low.tolist(), high.tolist())]), minlength=n)
        step = 0
        while (counts >= threshold).sum() < wanted and not (low.max() == 0 and high.min() == n):
            step += 1
            if step == len(steps):
                steps.append(window(step))
            wider = steps[step][0][:, q], steps[step][1][:, q]
            new = [x for o, a, b, c, e in zip(order, wider[0].tolist(), low.tolist(), high.tolist(), wider[1].tolist()) for x in (o[a:b], o[c:e])]
            counts += np.bincount(np.concatenate(new), minlength=n)
            low, high = wider
        found = np.flatnonzero(counts >= threshold)
        found = found[ids[found] != query_ids[q]]
        # The same order of additions for every vector, so that equal vectors get equal scores.
        scores = (points[found] * queries[q]).sum(1)
        if len(found) > k:
            best = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
            found, scores = found[best], scores[best]
        best = np.lexsort((ids[found], -scores))[:k]
        yield query_ids[q], ids[found[best]], scores[best]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
            block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest rows of each query row but itself."""
    points = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    points = points.filter(F.col("id").isNotNull() & usable(F.col("v")))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = points.agg(F.count("*"), F.sum(F.col("q").cast("long")), F.max(length)).first()
    n, n_queries, longest = facts[0], facts[1] or 0, float(np.sqrt(facts[2] or 0.0))
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-n_queries // query_rows))
    of = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(m)).cast("int")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = points.select("id", "v", of(1, blocks).alias("block")).withColumn("query_block", spread(query_blocks)).withColumn("asks", F.lit(False))
    queries = points.filter("q").select("id", "v").dropDuplicates(["id"]).withColumn("query_block", of(2, query_blocks)).withColumn("block", spread(blocks))
    both = candidates.unionByName(queries.withColumn("asks", F.lit(True)))

    def search(table: pa.Table) -> pa.Table:
        ids, asks = table.column("id").to_numpy(), table.column("asks").to_numpy()
        flat = table.column("v").combine_chunks()
        points = (flat.flatten() if hasattr(flat, "flatten") else flat).to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        rows = [], [], []
        arranged = np.flatnonzero(~asks)
        arranged = arranged[np.argsort(ids[arranged], kind="stable")]
        if len(arranged):
            for query, found, scores in _search(ids[arranged], points[arranged], ids[asks], points[asks], k, longest):
                rows[0].append(np.full(len(found), query))
                rows[1].append(found)
                rows[2].append(scores)
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        return pa.table({"query_id": join(rows[0], np.int64), "vec_id": join(rows[1], np.int64), "score": join(rows[2], np.float64)})

    found = both.groupBy(F.size("v").alias("d"), "block", "query_block").applyInArrow(search, "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
