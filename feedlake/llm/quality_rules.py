"""Quality rules with thresholds that adapt to each language and source.

A fixed rule rejects texts that are too short or repeat themselves. The other rules compare a rate of the text (symbols per word and
so on) with a fence above the upper quartile of that rate among the documents of the same language and source. Quartiles come from
mergeable sketches: each rate, in thousandths, is cut to its leading bits, and documents are counted per cut value. Counts of
parts of the corpus add up to the counts of the whole, in any order, so a hot source is counted where its rows lie. A sketch has
at most ``2 ** SKETCH_BITS * 64`` entries whatever the corpus, and its quantiles are exact to one part in ``2 ** (SKETCH_BITS - 1)``.

Null texts count as empty and null languages or sources as values of their own. Empty texts fail the fixed rule and are not
counted in the sketches. Repeated rows are judged one by one, alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basic import let
from ..storage import materialize
from .common import SPACE_CLASS, text_of, whole_rows, words_of

# The symbols that are counted.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SKETCH_BITS = 7
#: Fences lie ``SPREAD`` quartile distances and a slack (thousandths) above the upper quartile. The slack keeps clean texts where
#: nearly all documents of a source have the same rate.
SPREAD = 3
SLACK = {"symbols": 250, "marks": 300, "word_length": 3000, "dup_lines": 300}


def repeated_words(windows: Column) -> Column:
    """How many words lie in a window that occurs at least twice. ``windows``: all windows of the text in order, as strings."""
    ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def covered(s: Column) -> Column:
        twin = lambda x, j: F.coalesce(x["w"] == F.get(s, j)["w"], F.lit(False))
        same = F.filter(s, lambda x, j: twin(x, j - 1) | twin(x, j + 1))
        places = F.array_sort(F.transform(same, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(repeats, let(ordered, covered)).otherwise(0).cast("long")


def _count(text: Column, characters: str) -> Column:
    """How often the text has one of the characters."""
    return (F.size(F.split(text, characters, -1)) - 1).cast("long")


def counted(rows: DataFrame) -> DataFrame:
    """The rows with the counts of their ``_text`` in its place, and the rates in thousandths.

    Words joined by one space give the windows by a look-ahead at the start of each word, in one pass of the pattern.
    """
    rest = [c for c in rows.columns if c != "_text"]
    split = rows.select("*", words_of(F.col("_text")).alias("_words"), F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS[1:]}")).alias("_lines"))
    joined = split.select(*rest, "_text", "_lines", F.size("_words").cast("long").alias("n_words"), F.array_join("_words", " ").alias("_joined"))
    window = f"(?<![^ ])(?=([^ ]++(?: [^ ]++){{{WINDOW - 1}}}))"
    windowed = joined.select(
        *rest, "n_words", (F.length("_joined") - F.greatest(F.col("n_words") - 1, F.lit(0))).cast("long").alias("word_chars"),
        _count(F.col("_text"), f"[{SYMBOLS}]").alias("n_symbols"), _count(F.col("_text"), "[!?]").alias("_marks"),
        F.size("_lines").alias("_n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_extract_all("_joined", F.lit(window), F.lit(1)).alias("_windows"))
    return windowed.select(
        *rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("_windows")).alias("n_repeat_words"),
        _milli(F.col("n_symbols"), F.col("n_words")).alias("symbols"), _milli(F.col("_marks"), F.col("n_words")).alias("marks"),
        _milli(F.col("word_chars"), F.col("n_words")).alias("word_length"), _milli(F.col("n_dup_lines"), F.col("_n_lines")).alias("dup_lines"))


def _milli(part: Column, whole: Column) -> Column:
    """Thousandths, rounded down; 0 of nothing. Integers, so that no rounding differs between machines."""
    part, whole = part.cast("long"), whole.cast("long")
    return F.when(whole > 0, F.floor((part * 1000 - F.pmod(part * 1000, whole)) / whole)).otherwise(0).cast("long")


def leading_bits(value: Column) -> Column:
    """The value with all but its first ``SKETCH_BITS`` bits set to zero: the bucket of a non-negative integer in a sketch."""
    drop = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(rated: DataFrame, groups: list[str]) -> DataFrame:
    """Documents per group, rate and bucket."""
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), leading_bits(F.col(r)).alias("bucket")) for r in SLACK]))
    return rated.select(*groups, rates.alias("r")).groupBy(*groups, "r.rate", "r.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """The largest rates that pass, one row per group."""
    whole = Window.partitionBy(*groups, "rate")
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sketch.select(*groups, "rate", "bucket", F.sum("n").over(upto).alias("at"), F.sum("n").over(whole).alias("total"))
    quartile = lambda q: F.min(F.when(F.col("at") * 4 >= F.col("total") * q, F.col("bucket")))
    slack = F.element_at(F.create_map(*[F.lit(x) for pair in SLACK.items() for x in pair]), F.col("rate"))
    by_rate = ranked.groupBy(*groups, "rate").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    fence = F.col("q3") + SPREAD * (F.col("q3") - F.col("q1")) + slack
    by_rate = by_rate.select(*groups, "rate", fence.alias("fence"))
    return by_rate.groupBy(*groups).agg(*[F.max(F.when(F.col("rate") == r, F.col("fence"))).alias(f"max_{r}") for r in SLACK])


def rate_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Each row (its columns ``keep``) as ``row``, its counts, ``base_failed`` and ``kept``.

    Texts are read once; rows and counts are written to the shared folder. So are the fences, a row per language and source, so that
    Spark knows their size when it picks the join.
    """
    keys = [F.col(lang).alias("_lang"), F.col(source).alias("_source"), text_of(text).alias("_text")]
    rows = materialize(counted(whole_rows(docs, *keys, keep=keep)))
    limits = materialize(fences(sketches(rows.filter("n_words > 0"), ["_lang", "_source"]), ["_lang", "_source"]))
    limits = limits.withColumnsRenamed({"_lang": "_of_lang", "_source": "_of_source"})
    same = F.col("_lang").eqNullSafe(F.col("_of_lang")) & F.col("_source").eqNullSafe(F.col("_of_source"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    passes = ~failed
    for r in SLACK:
        passes = passes & (F.col(r) <= F.col(f"max_{r}"))
    return rows.join(limits, same, "left").select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *SLACK,
        failed.alias("base_failed"), F.coalesce(passes, F.lit(False)).alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass all rules, with the columns they came with."""
    return rate_documents(docs).filter("kept").select("row.*")
