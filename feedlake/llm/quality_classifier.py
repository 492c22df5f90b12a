"""A quality classifier learnt from positive and unlabelled texts.

Trusted positives are documents whose label says 1; the unlabelled text is any other web text, good or bad. A small network minimises
the non-negative unbiased risk: ``prior * L(P, +) + max(0, L(U, -) - prior * L(P, -))``, where ``prior`` is the share of positives
among the unlabelled, estimated from the training labels. Labels are learnt only from training rows; the score sees the text alone.

The network is fitted on a bounded sample: at most ``SAMPLE`` positives and ``SAMPLE`` unlabelled texts, those with the smallest digests
of their id, as short vectors of rates. Scores are then worked out for every whole text, row by row, without a shuffle.

Null texts count as empty; an empty text has the rates of no text and a score as any other. Without any positives all scores are 0.5.
Repeated rows score alike; labels that repeat for an id count once, and contradicting ones count as 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, whole_rows, with_row

SAMPLE = 8000
THRESHOLD = 0.7
HIDDEN, STEPS, RATE, DECAY, SEED = 24, 600, 0.02, 1e-4, 7
FOLDS, HELD_OUT_FOLD = 4, 2

# Groups of characters whose share is a feature.
GROUPS = {
    "symbols": "#*$%&<>@^~_+=",
    "bars": "|",
    "marks": "!?",
    "stops": ".,;:",
    "digits": "0123456789",
    "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "brackets": "()[]{}\"'/\\",
}


def features(text: str) -> list[float]:
    """Rates of a text, each between 0 and about 3."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, chars = len(words), len(text)
    kinds = set(words)
    raw = text.encode(errors="replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, int)
    shares = [np.sqrt(sum(counts[ord(c)] for c in group) / max(chars, 1)) * 3 for group in GROUPS.values()]
    upper = sum(map(str.isupper, words)) / max(n, 1)
    repeats = sum(map(str.__eq__, words, words[1:])) / max(n - 1, 1)
    pairs = len(set(zip(words, words[1:]))) / max(n - 1, 1)
    return [
        *shares, upper, repeats, pairs, np.log1p(n) / 4, np.log1p(len(kinds)) / 4,
        len(kinds) / max(n, 1), (chars - counts[32] - counts[10]) / max(n, 1) / 6, len(set(lines)) / max(len(lines), 1), np.log1p(n / max(len(lines), 1)) / 4,
        float(counts[128:].sum()) / max(len(raw), 1) * 3, 1.0 if n == 0 else 0.0, min(max(map(len, words), default=0), 200) / 60,
    ]


def vectors(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), -1)


class Network:
    """One hidden layer; plain arrays, so that it travels to the workers as a small value."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w = mean, scale, [w1, b1, w2, b2]

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED) -> Network | None:
    """Full-batch Adam on the non-negative risk with the logistic loss. None without positives."""
    if not len(positive):
        return None
    if not len(unlabelled):
        unlabelled = positive
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 0.05
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    d = p.shape[1]
    w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = lambda z: np.logaddexp(0, z)
    for t in range(1, STEPS + 1):
        hp, hu = np.tanh(p @ w[0] + w[1]), np.tanh(u @ w[0] + w[1])
        zp, zu = hp @ w[2] + w[3], hu @ w[2] + w[3]
        negative = soft(zu).mean() - prior * soft(zp).mean()
        if negative >= 0:
            gp = prior * (-sigmoid(-zp) - sigmoid(zp)) / len(p)
            gu = sigmoid(zu) / len(u)
        else:  # the negative part has gone below what a risk can be, and counts as 0
            gp, gu = -prior * sigmoid(-zp) / len(p), np.zeros(len(u))
        back = lambda x, h, g: (x.T @ (np.outer(g, w[2]) * (1 - h * h)), (np.outer(g, w[2]) * (1 - h * h)).sum(0), h.T @ g, g.sum())
        grads = [a + b for a, b in zip(back(p, hp, gp), back(u, hu, gu), strict=True)]
        for i, g in enumerate(grads):
            g = g + DECAY * w[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, *w)


def fold(key: Column) -> Column:
    """Remainder of the CRC-32 of the id as text; a null id is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Network | None:
    """Fit on the training rows. The texts of the sample are turned into vectors by the executors; only vectors reach the driver."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).dropna().groupBy("_key").agg(F.min("_label").alias("_label"))
    known = known.filter(fold(F.col("_key")) != HELD_OUT_FOLD)
    prior, n = known.agg(F.avg((F.col("_label") == 1).cast("double")), F.count("*")).first()
    if not prior:
        return None
    # The lower end of the estimate: with too large a prior, bad texts pass for the positives that are thought to be missing.
    prior = max(prior - 2 * (prior * (1 - prior) / n) ** 0.5, 0.5 * prior)
    rows = docs.select(F.col(key).alias("_key")).filter(fold(F.col("_key")) != HELD_OUT_FOLD).dropDuplicates()
    order = F.xxhash64(F.lit(SEED), "_key")
    positive = rows.join(known.filter("_label = 1"), "_key", "left_semi").orderBy(order, "_key").limit(sample).withColumn("_positive", F.lit(True))
    unlabelled = rows.orderBy(F.xxhash64(F.lit(SEED + 1), "_key"), "_key").limit(sample).withColumn("_positive", F.lit(False))
    chosen = positive.unionAll(unlabelled).groupBy("_key").agg(F.max("_positive").alias("p"), F.min("_positive").alias("u"))
    # At most twice the sample, so small enough to broadcast.
    picked = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text")).join(F.broadcast(chosen), "_key").select("p", "u", "_text", "_key")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = vectors(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(list(found), pa.list_(pa.float64()))], ["p", "u", "_key", "x"])

    key_type = docs.schema[key].dataType.simpleString()
    turned = picked.mapInArrow(turn, f"p boolean, u boolean, _key {key_type}, x array<double>")
    # One row per id, however many rows share it: the sample bounds what reaches the driver.
    found = turned.groupBy("_key").agg(F.max("p").alias("p"), F.min("u").alias("u"), F.min("x").alias("x")).toArrow()
    x = np.array(found.column("x").to_pylist(), dtype=np.float64).reshape(found.num_rows, -1)
    is_p, not_u = np.array(found.column("p").to_pylist(), bool), np.array(found.column("u").to_pylist(), bool)
    # Rows arrive in any order; sorted, the sums and so the scores are the same in every run.
    arrange = lambda a: a[np.lexsort(a.T[::-1])] if len(a) else a
    return fit(arrange(x[is_p]), arrange(x[~not_u]), min(prior, 0.99))


def score_documents(docs: DataFrame, network: Network | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row (its columns ``keep``) as ``row`` with ``score``."""
    rows = whole_rows(docs, text_of(text).alias("_text"), keep=keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                found = np.full(part.num_rows, 0.5)
                if network is not None:
                    found = network.scores(np.vstack([vectors([t.as_py()]) for t in part.column(1)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], ["row", "score"])

    return rows.mapInArrow(score, with_row(rows, "score double"))
