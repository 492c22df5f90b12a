"""Secrets in texts: fixed patterns, and character Markov models for strings that look random.

The patterns give the base spans. Their values are the labelled samples of random strings; the other long character runs of the same
texts are the samples of ordinary identifiers. Two first-order Markov models, with add-one smoothing, are counted from the different
samples of all documents. A long run is a further secret (kind ``random``) if the log-likelihood ratio of the two models, summed over
its character pairs, reaches ``MIN_RATIO``. Its own pairs are left out of the ordinary model, so that a bare secret does not vouch for
itself, however often it is repeated. Without samples both models are uniform and no run is added.

Spans are ``kind:start:end`` of the whole match in code points, end exclusive. Matches that fail their length are dropped, but use up
their characters, as in any leftmost search. A run that holds or meets a base span is not added. Null texts count as empty; empty
texts have no spans; repeated rows are scanned one by one, alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basic import let
from ..storage import materialize
from .common import content_key, numbered, text_of, whole_rows
from .filters import filter_row, may_hold

# The base patterns, the group that holds the value, and the least length of the value, in the order of the kinds.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
RANDOM = "random"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN_CLASS = "[A-Za-z0-9+/_=-]"
#: Runs of so many characters are scored, and are samples of ordinary identifiers.
MIN_SAMPLE = 12
#: Nats by which the random model must explain a run better: none of the 41,045 bare runs of sf0.1 reaches it.
MIN_RATIO = 11.0
MASK = "[secret]"


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """The matches of one kind in order: characters since the match before, length, value, whether it passes."""
    gaps = F.split(text, pattern, -1)

    def matches(g: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern if group else f"({pattern})"), F.lit(0 if group else 1))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
        each = F.transform(F.arrays_zip(hits.alias("hit"), values.alias("value")), lambda h, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(g, i)).cast("long").alias("gap"), F.length(h["hit"]).cast("long").alias("n"),
            h["value"].alias("value"), (F.length(h["value"]) >= least).alias("ok")))
        return F.when(F.size(g) > 1, each).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:bigint,n:bigint,value:string,ok:boolean>>"))

    return let(gaps, matches)


def _masked(text: Column) -> Column:
    """The text with all base matches blanked out."""
    for _, pattern, _, _ in BASE:
        text = F.regexp_replace(text, pattern, " ")
    return text


def pair_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Character pairs ``a``, ``b`` of the different labelled samples with their number ``n`` per ``label``: at most two rows per pair of the alphabet."""
    body = docs.select(text_of(text).alias("t"))
    values = F.flatten(F.array(*[F.transform(F.filter(_found(F.col("t"), *kind), lambda m: m["ok"]), lambda m: m["value"]) for kind in BASE]))
    ordinary = F.regexp_extract_all(_masked(F.col("t")), F.lit(f"({RUN_CLASS}{{{MIN_SAMPLE},}})"), F.lit(1))
    labelled = lambda found, label: F.transform(found, lambda s: F.struct(F.lit(label).alias("label"), s.alias("s")))
    samples = body.select(F.explode(F.concat(labelled(values, "random"), labelled(ordinary, "ordinary"))).alias("x")).select("x.*")
    # Equal samples count once, so that copies of a text neither weigh more nor cost further pairs.
    samples = samples.distinct()
    pairs = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, 2))
    counted = samples.filter(F.length("s") > 1).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n"))
    code = lambda c: F.locate(c, F.lit(ALPHABET)) if isinstance(c, str) else F.instr(F.lit(ALPHABET), c)
    return counted.select("label", code(F.substring("pair", 1, 1)).alias("a"), code(F.substring("pair", 2, 1)).alias("b"), "n").filter("a > 0 AND b > 0")


def _grid(counts: DataFrame) -> DataFrame:
    """``random`` and ``ordinary``: the counts of every pair of the alphabet."""
    n = len(ALPHABET)
    sums = counts.groupBy("a", "b").agg(*[F.sum(F.when(F.col("label") == x, F.col("n"))).alias(x) for x in ("random", "ordinary")])
    grid = counts.sparkSession.range(n * n).select((F.floor(F.col("id") / n) + 1).cast("int").alias("a"), (F.col("id") % n + 1).cast("int").alias("b"))
    return grid.join(sums, ["a", "b"], "left").fillna(0, ["random", "ordinary"])


def ratio_table(counts: DataFrame) -> list[float]:
    """``log P(b | a, random) - log P(b | a, ordinary)`` for all pairs of the alphabet, row by row. Bounded by the alphabet."""
    row = Window.partitionBy("a")
    share = lambda x: F.log((F.col(x) + 1) / (F.sum(x).over(row) + len(ALPHABET)))
    return [r[0] for r in _grid(counts).select("a", "b", (share("random") - share("ordinary")).alias("d")).orderBy("a", "b").select("d").collect()]


def count_tables(counts: DataFrame) -> tuple[list[int], list[int]]:
    """The counts of all pairs of the alphabet, row by row, in random and in ordinary samples. Bounded by the alphabet."""
    rows = _grid(counts).orderBy("a", "b").select("random", "ordinary").collect()
    return [r[0] for r in rows], [r[1] for r in rows]


def log_ratio(run: Column, ratios: list[float]) -> Column:
    """Sum of the ratios over the pairs of a run; other characters than the alphabet's count nothing."""
    n = len(ALPHABET)
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def summed(cs: Column) -> Column:
        terms = F.transform(F.sequence(F.lit(1), F.size(cs) - 1), lambda i: F.when(
            (F.get(cs, i - 1) > 0) & (F.get(cs, i) > 0), F.get(table, (F.get(cs, i - 1) - 1) * n + F.get(cs, i) - 1)).otherwise(0.0))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    return F.when(F.length(run) > 1, let(codes, summed)).otherwise(0.0)


def _tallied(ordered: Column) -> Column:
    """The different values ``x`` of a sorted array and their numbers ``c``."""

    def tally(ends: Column) -> Column:
        return F.transform(ends, lambda e, k: F.struct(F.get(ordered, e - 1).alias("x"), (e - F.coalesce(F.get(ends, k - 1), F.lit(0))).alias("c")))

    last = lambda e: (e == F.size(ordered)) | (F.get(ordered, e - 1) != F.get(ordered, e))
    return let(F.filter(F.sequence(F.lit(1), F.size(ordered)), last), tally)


def left_out_ratio(run: Column, random: list[int], ordinary: list[int]) -> Column:
    """The log ratio of a run of the alphabet's characters whose own pairs are left out of the ordinary counts."""
    n = len(ALPHABET)
    sums = lambda counts: [sum(counts[i * n:(i + 1) * n]) for i in range(n)]
    table = lambda values, kind: F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")
    shares = table([math.log((x + 1) / (total + n)) for total, i in zip(sums(random), range(n)) for x in random[i * n:(i + 1) * n]], "double")
    pairs_of, heads_of = table(ordinary, "bigint"), table(sums(ordinary), "bigint")
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = lambda cs: F.array_sort(F.transform(F.sequence(F.lit(1), F.size(cs) - 1), lambda i: F.get(cs, i - 1) * n + F.get(cs, i)))
    total = lambda terms: F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    def rest(ordered: Column, counts: Column, more: int) -> Column:
        """The logarithms of the counts without the run's own, summed over the run."""
        return total(F.transform(_tallied(ordered), lambda t: t["c"] * F.log(F.greatest(F.get(counts, t["x"]) - t["c"], F.lit(0)) + more)))

    def ratio(ps: Column) -> Column:
        heads = F.transform(ps, lambda p: F.floor(p / n).cast("int"))
        return total(F.transform(ps, lambda p: F.get(shares, p))) - rest(ps, pairs_of, 1) + let(heads, lambda hs: rest(hs, heads_of, n))

    return F.when(F.length(run) > 1, let(codes, lambda cs: let(pairs(cs), ratio))).otherwise(0.0)


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row per document: ``rid``, the key, ``n_<kind>`` per base kind, ``n_random``, and ``base`` and ``spans`` as sorted arrays of
    (start, kind number, end, kind).

    The matches are dealt out by document, without the texts; a running sum turns their lengths into places.
    """
    random, ordinary = count_tables(materialize(pair_counts(docs, text)))
    rows = numbered(docs, F.col(key).alias("_key"), text_of(text).alias("t"))
    runs = F.transform(_found(F.col("t"), RANDOM, f"{RUN_CLASS}{{{MIN_SAMPLE},}}", 0, MIN_SAMPLE), lambda m: m.withField(
        "ok", (left_out_ratio(m["value"], random, ordinary) >= min_ratio) & ~m["value"].rlike("|".join(p for k, p, _, _ in BASE if k != "assign"))))
    found = F.concat(*[_found(F.col("t"), *kind) for kind in BASE], runs)
    narrow = F.transform(found, lambda m: m.dropFields("value"))
    each = rows.select("rid", "_key", F.explode_outer(narrow).alias("m")).select("rid", "_key", "m.*").repartition("rid")
    upto = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto)).withColumn("start", F.col("end") - F.col("n"))
    before = Window.partitionBy("rid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    is_base = F.col("ok") & (F.col("kind") != RANDOM)
    placed = placed.withColumn("covered", F.coalesce(F.max(F.when(is_base, F.col("end"))).over(before) > F.col("start"), F.lit(False)))
    number = F.array_position(F.array(*[F.lit(k) for k, *_ in BASE], F.lit(RANDOM)), F.col("kind")).cast("int")
    span = F.struct("start", number.alias("number"), "end", "kind")
    kept = is_base | (F.col("ok") & ~F.col("covered"))
    return placed.groupBy("rid", F.col("_key").alias(key)).agg(
        *[F.sum(F.when(is_base & (F.col("kind") == k), 1).otherwise(0)).cast("long").alias(f"n_{k}") for k, *_ in BASE],
        F.sum(F.when(kept & (F.col("kind") == RANDOM), 1).otherwise(0)).cast("long").alias("n_random"),
        F.sort_array(F.collect_list(F.when(is_base, span))).alias("base"),
        F.sort_array(F.collect_list(F.when(kept, span))).alias("spans"),
    )


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", mask: str = MASK) -> DataFrame:
    """The documents with every span replaced by ``mask`` (spans that overlap are replaced together); ``n_chars`` follows the text.

    Documents without a span stay where they are: a map of fixed size tells them, and only the others meet their spans.
    """
    at = content_key(key, text_of(text)).alias("_at")
    found = scan_secrets(docs.select(at, text), text, key="_at").filter(F.size("spans") > 0)
    # Copies of a row have the same spans.
    found = materialize(found.groupBy("_at").agg(F.min("spans").alias("spans")).withColumn("_h", F.xxhash64("_at")))
    rows = whole_rows(docs, text_of(text).alias("_text"), at).withColumn("_h", F.xxhash64("_at"))
    asked = may_hold(F.col("_words"), F.col("_h"))
    words = filter_row(found, "_h", "_words")
    clean = rows.join(words, ~asked).select("row.*")
    rows = rows.join(words, asked).drop("_words", "_h").join(found.drop("_h"), "_at", "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("upto"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(F.col("_text"), (acc["upto"] + 1).cast("int"), F.greatest(s["start"] - acc["upto"], F.lit(0)).cast("int"))
        apart = (s["start"] >= acc["upto"])
        return F.struct(F.concat(acc["out"], gap, F.when(apart, F.lit(mask)).otherwise("")).alias("out"), F.greatest(acc["upto"], s["end"]).alias("upto"))

    rest = lambda a: F.concat(a["out"], F.substr(F.col("_text"), (a["upto"] + 1).cast("int"), F.length("_text")))
    masked = F.aggregate("spans", start, step, rest)
    changed = F.col("row").withField(text, masked)
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length(masked).cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(rows.select(F.when(F.col("spans").isNull(), F.col("row")).otherwise(changed).alias("row")).select("row.*"))
