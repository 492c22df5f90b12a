"""What the pipeline's stages move: texts no more often than they must, and families of near copies that do not chain."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from feedlake.llm import ngram_join, secret_scans, source_mixing

from . import brute
from .test_operators import FOLDER


def moves(spark, make):
    """For each scan of the texts in the plan, how many exchanges by key its rows pass."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above, found = [], []
    for line in plan.splitlines():
        depth = len(re.match(r"[ :+-]*", line)[0])
        above = [(d, x) for d, x in above if d < depth] + [(depth, line)]
        if "FileScan" in line and "documents.parquet" in line:
            found.append(sum("Exchange hashpartitioning" in x for _, x in above))
    return sorted(found)


def test_texts_without_secrets_stay(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert moves(spark, lambda: secret_scans.mask_secrets(docs)) == [0, 1]


def test_mixed_texts_are_moved_once(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert moves(spark, lambda: source_mixing.mixed(docs)) == [1]


def test_mask_of_many_and_of_no_secrets(spark, tmp_path):
    secret = "password=abcdefgh1234 "
    rows = [(i, secret * (i % 3) + f"text {i}") for i in range(300)] + [(None, secret), (None, None), (7, "text 7"), (1, secret + "text 1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    found = secret_scans.mask_secrets(spark.read.parquet(str(tmp_path / "d")))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    expected = [(i, t and t.replace(secret.strip(), secret_scans.MASK)) for i, t in rows]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)
    plain = docs.filter("doc_id % 3 = 0 AND doc_id <> 1")
    assert sorted(map(tuple, secret_scans.mask_secrets(plain).collect())) == sorted(map(tuple, plain.collect()))


def test_chains_of_groups_are_no_family(spark, tmp_path, monkeypatch):
    """Documents that share one passage with those before and one with those behind them meet only those."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    passages = [[word() for _ in range(16)] for _ in range(13)]
    texts = [" ".join(passages[g] + [word() for _ in range(8)] + passages[g + 1]) for g in range(12) for _ in range(3)]
    # Two that are near the first and the last, but share the passages with the others too.
    texts += [texts[0].rsplit(" ", 2)[0], texts[-1].rsplit(" ", 2)[0]]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    sizes, whole = [], ngram_join._block_links

    def seen(members, *rest):
        sizes.extend(r["count"] for r in members.groupBy("family").count().collect())
        return whole(members, *rest)

    monkeypatch.setattr(ngram_join, "_block_links", seen)
    monkeypatch.setattr(ngram_join, "LARGE", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 4)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 0)
    found = {r.id: r.component_id for r in ngram_join.link_documents(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert found == {i: c for (i, _), (_, c) in zip(rows, brute.components(rows, ngram_join.GRAM, ngram_join.PERCENT))}
    assert found[36] == 0 and found[37] == 35 and len(set(found.values())) == 36
    assert sizes and max(sizes) <= 12


def test_only_texts_of_likely_pairs_are_dealt_out(spark):
    texts = spark.createDataFrame([(i, f"a b c d e f{i}") for i in range(200)], "cls long, _text string")
    wanted = spark.createDataFrame([(3,), (5,)], "cls long")
    assert sorted(r.cls for r in ngram_join._passing(texts, wanted, "cls").collect()) == [3, 5]
    assert ngram_join._passing(texts, wanted.filter(F.lit(False)), "cls").count() == 0
