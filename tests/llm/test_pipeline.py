"""The stages of the pipeline and the whole of it against plain versions, also on awkward rows with clashing columns."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedlake.llm import ngram_join, registry, secret_scans, source_mixing

from . import brute
from .test_operators import FOLDER, awkward  # noqa: F401


def one_of_each(rows, gram=5, percent=80):
    """(id, text) pairs that stay of ``(id, text)`` rows: those whose id is their component's, repeated rows once."""
    found = brute.components(rows, gram, percent)
    return {(key, text or "") for (key, text), (n, component) in zip(rows, found) if (component if n else key) == key}


def copies_of(rows):
    """How often each (id, text) is taken, of rows of ``source_mixing.mix``."""
    out = Counter()
    for r in rows:
        chance = int(hashlib.md5(f"copy:{r.digest}".encode()).hexdigest()[:8], 16) / 2**32
        if r["size"]:
            out[r.row.doc_id, r.row.text] += math.floor(r.taken / r["size"] + chance)
    return +out


@pytest.mark.parametrize("which", ["given", "awkward"])
def test_one_document_of_each_group(spark, which, request):
    docs = request.getfixturevalue("awkward") if which == "awkward" else spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text or "") for r in kept.select("doc_id", "text").collect()]
    assert len(found) == len(set(found))
    assert set(found) == one_of_each([tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("which", ["given", "awkward"])
def test_documents_as_often_as_they_are_taken(spark, which, request):
    docs = request.getfixturevalue("awkward") if which == "awkward" else spark.read.parquet(f"{FOLDER}/documents.parquet")
    taken = source_mixing.mix(docs).collect()
    out = source_mixing.mixed(docs)
    assert out.columns == docs.columns
    rows = Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect())
    assert rows == copies_of(taken)
    assert rows == Counter((r.doc_id, r.text) for r in source_mixing.mixed(docs).select("doc_id", "text").collect())
    words = Counter()
    for (_, text), n in rows.items():
        words["all"] += n * len(brute.words(text))
    longest = max(r["size"] for r in taken)
    assert abs(words["all"] - sum(r.taken for r in taken)) <= longest * math.sqrt(len(taken)) + longest


def test_the_whole_pipeline(spark):
    """Every document of the result, its copies and its tokens, from the rows that pass the quality rules on."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = corpus_pipeline.good_documents(spark, docs, FOLDER).collect()
    stays = one_of_each([(r.doc_id, r.text) for r in good])
    by_id = {r.doc_id: r for r in good if (r.doc_id, r.text or "") in stays}
    masked = {}
    for key, r in by_id.items():
        out, upto = "", 0
        for start, _, end, _ in brute.secrets(r.text):
            if start >= upto:
                out += r.text[upto:start] + secret_scans.MASK
            upto = max(upto, end)
        masked[key] = out + r.text[upto:]
    table = spark.createDataFrame([(k, t, by_id[k].source) for k, t in masked.items()], "doc_id long, text string, source string")
    wanted = {k: n for (k, _), n in copies_of(source_mixing.mix(table).collect()).items()}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter(r.doc_id for r in rows) == wanted
    plain = Tokenizer.from_file(registry.word_vocabulary())
    plain.no_truncation()
    plain.no_padding()
    assert all(r.ids == plain.encode(masked[r.doc_id], add_special_tokens=False).ids for r in rows)


def test_stages_keep_columns_of_awkward_rows(spark, awkward):  # noqa: F811
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, awkward, FOLDER).columns == awkward.columns
    assert corpus_pipeline.STAGES[-1][1](spark, awkward.select("*", F.lit(1).alias("ids")), FOLDER).count() == awkward.count()
