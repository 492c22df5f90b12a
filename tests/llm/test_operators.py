"""The operators against plain versions, on the smallest given tables and on awkward rows."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from feedlake.llm import bpe, ngram_join, quality_rules, registry, secret_scans, source_mixing, substring_dedup, suffix_dedup, url_filters

from . import brute

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def given(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def awkward_rows():
    """Nulls everywhere, empty and blank texts, repeated rows, equal ids, ties, long texts, other white space, unusual characters."""
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "ε", "zeta!", "eta", "theta", "日本", "𝒳y"]
    prose = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randrange(60)) for _ in range(n))
    base, passage = prose(150), prose(60)
    edited = base.split(" ")
    edited[70] = "changed"
    long = prose(20_000)
    texts = [
        None, "", " \t\n", "one", "two words", base, base, " ".join(edited), passage, f"{prose(40)}\n{passage}\r\n{prose(30)}",
        f"{prose(25)} {passage}  {prose(45)}", "again " * 400, "again " * 333 + "end", "x" * 500, "x" * 700 + "y", "ab" * 300, long, long[5000:9000],
        "line\nline\nline\nother\n \n", "a\u00a0b\u2003c\u0085d", "tab\tand\x0bvertical\x0cfeed\rreturn\x1cunit", "\0null\0byte " * 30,
        "password = 'abcdefghijkl' token:short secret: password: abcdefghijklmnop", "Passwd==ABCDEF0123456789abcdef AKIAABCDEFGHIJKLMN", "AKIAAKIA deadbeefdeadbeef0123 API_KEY=\"x_y.z-0123456789",
        "deadbeefdeadbeefAPIKEY=deadbeefdeadbeef", "#*$%&|<> " * 20, "WHY!! " * 30,
    ]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (7, prose(80), "en", "a", 1), (None, base, None, None, 0), (None, None, None, None, None), (None, passage, "en", "b", 2), (900, "", "en", "only empty", 0), (901, None, "en", "only empty", 0)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """The awkward rows as a table with further columns named like the operators' own."""
    path = str(tmp_path_factory.mktemp("awkward") / "documents.parquet")
    clashing = ["rid", "row", "kept", "score", "size", "target", "n_words", "spans", "component_id", "cls", "_text", "_at", "taken", "shard", "id", "digest", "an odd: name`"]
    df = spark.createDataFrame(awkward_rows(), DOCS)
    df.select("*", *[F.lit("clash").alias(c) for c in clashing]).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def table(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("given") / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("which", ["given", "awkward"])
class TestAgainstPlainVersions:
    @pytest.fixture
    def docs(self, which, request, spark):
        return request.getfixturevalue("awkward") if which == "awkward" else spark.read.parquet(f"{FOLDER}/documents.parquet")

    def test_base_secrets(self, docs):
        found = secret_scans.scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", secret_scans.joined_spans(F.col("base")).alias("b")).collect()
        wanted = []
        for key, text in pairs(docs):
            spans = brute.secrets(text)
            counts = [sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")]
            wanted.append((key, *counts, ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)))
        assert sorted_rows(map(tuple, found)) == sorted_rows(wanted)

    def test_quality_counts(self, docs):
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        rated = quality_rules.rate_documents(docs).select("row.doc_id", *names, "kept").collect()
        wanted = [(key, *[brute.quality(text)[n] for n in names]) for key, text in pairs(docs)]
        assert sorted_rows(tuple(r)[:-1] for r in rated) == sorted_rows(wanted)
        assert not any(r.kept and r.base_failed for r in rated)

    def test_components(self, docs):
        for gram, percent in ((4, 85), (5, 80)):
            found = ngram_join.link_documents(docs, gram, percent).select("id", "n_shingles", "component_id").collect()
            rows = pairs(docs)
            wanted = [(key, n, c) for (key, _), (n, c) in zip(rows, brute.components(rows, gram, percent))]
            assert sorted_rows(map(tuple, found)) == sorted_rows(wanted)

    def test_repeated_words(self, docs):
        for window in (35, 8):
            found = substring_dedup.remove_repeats(docs, window=window).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect()
            rows = pairs(docs)
            wanted = [(key, *r) for (key, _), r in zip(rows, brute.repeated_words([t for _, t in rows], window))]
            assert sorted_rows(map(tuple, found)) == sorted_rows(wanted)

    def test_repeated_bytes(self, docs):
        for window in (100, 30):
            found = suffix_dedup.remove_repeats(docs, window=window).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
            rows = pairs(docs)
            wanted = [(key, *r) for (key, _), r in zip(rows, brute.repeated_bytes(rows, window))]
            assert sorted_rows(map(tuple, found)) == sorted_rows(wanted)

    def test_encoding(self, docs):
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(registry.word_vocabulary())
        plain.no_truncation()
        plain.no_padding()
        found = bpe.encode_documents(docs, registry.word_vocabulary(), full=True).select("row.doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256").collect()
        wanted = []
        for key, text in pairs(docs):
            ids = plain.encode(text or "", add_special_tokens=False).ids
            wanted.append((key, len(ids), ids, brute.sha(struct.pack(f"<{len(ids)}I", *ids)), brute.sha(plain.decode(ids, skip_special_tokens=False))))
        assert sorted_rows(map(tuple, found)) == sorted_rows(wanted)

    def test_mix(self, docs):
        rows = source_mixing.mix(docs).select("row.doc_id", F.col("row.source").alias("source"), "size", "source_size", "target", "taken").collect()
        sizes = {}
        for r, in zip(rows):
            sizes[r.source] = sizes.get(r.source, 0) + r.size
        order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        target, free, left = {}, list(order), float(sum(sizes.values()))
        while True:
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            full = [s for s in free if share[s] > 3 * sizes[s]]
            if not full:
                target |= share
                break
            for s in full:
                target[s] = 3.0 * sizes[s]
                left -= target[s]
                free.remove(s)
        assert len(rows) == docs.count()
        for s in order:
            taken = sum(r.taken for r in rows if r.source == s)
            assert abs(taken - target[s]) <= 1 + 0.002 * target[s]
            assert all(abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.source_size == sizes[s] for r in rows if r.source == s)
        assert all(0 <= r.taken <= 3 * r.size for r in rows)
        again = source_mixing.mix(docs).select("row.doc_id", F.col("row.source").alias("source"), "size", "source_size", "target", "taken").collect()
        assert sorted_rows(map(tuple, rows)) == sorted_rows(map(tuple, again))


def test_urls(spark):
    urls = [r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    urls += [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com", "http://a.example.com/en/?q#f", "https://x.net/es/", "https://net/fr/a", "https://xnet/es/",
             "http://www.example.com/en/a://b", "ftp://a.net?x=/es/", "http://a.net#/es/", "http://a.net/e", "http://ünet/es/", "x://com/", "http://" + "a." * 3000 + "net/es/" + "p" * 5000, "http://.net/fr/"]
    urls += urls[-3:]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    found = url_filters.judge_urls(pages, url_filters.rule_table(spark)).select("row.page_id", "host", "path", "rule", "verdict").collect()
    assert sorted_rows(map(tuple, found)) == sorted_rows((i, *brute.url(u)) for i, u in enumerate(urls))
    assert url_filters.judge_urls(pages.limit(0), url_filters.rule_table(spark)).count() == 0
    none = url_filters.rule_table(spark).limit(0)
    assert {r.verdict for r in url_filters.judge_urls(pages, none, default="block").collect()} == {"block"}


def test_empty_tables(spark, empty):
    assert secret_scans.scan_secrets(empty).count() == 0
    assert quality_rules.rate_documents(empty).count() == 0
    assert ngram_join.link_documents(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert source_mixing.mix(empty).count() == 0
    assert bpe.encode_documents(empty, registry.word_vocabulary()).count() == 0


def test_large_families_of_near_copies(spark, tmp_path_factory, monkeypatch):
    """Hundreds of texts that share most of their n-grams, above and below the threshold, compared block by block."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(140)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(30) if i % 3 else rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = table(spark, rows, tmp_path_factory)
    wanted = [(key, n, c) for (key, _), (n, c) in zip(rows, brute.components(rows, 4, 85))]
    assert 3 < len({c for _, _, c in wanted}) < 250
    for size in (1024, 60):
        monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", size)
        found = ngram_join.link_documents(docs, 4, 85).select("id", "n_shingles", "component_id").collect()
        assert sorted_rows(map(tuple, found)) == sorted_rows(wanted)
