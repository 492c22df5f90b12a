"""URL filters: host and path rules found by hashed expressions.

A URL is expanded into the expressions (host suffix, path prefix) that a rule could have. Only suffixes with as many labels and prefixes
with as many characters as some rule has are formed; both sets are small, so a URL gives few expressions however long it is. An
expression meets the rules by an equi-join on the first hex digits of its SHA-256, and a meeting counts if the whole digests agree.
The longest fitting rule decides.

The host of a URL follows its first ``://`` and ends before ``/``, ``?``, ``#`` or the end; the path ends before ``?``, ``#`` or the end.
Null URLs and URLs without ``://`` have an empty host and path and fit no rule. Two rules of the same length: the longer host wins, and
a rule that both allows and blocks, blocks. Without a rule the verdict is ``default``. Repeated rows are judged one by one, alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, whole_rows

PREFIX_DIGITS = 8
# The rules of the registered query.
DEFAULT_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rule_table(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    """A short list of rules as a table, made of literals."""
    names = ("host", "path", "verdict")
    rows = [F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, rule)]) for rule in rules]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path."""
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1)).otherwise(F.lit(""))
    after = F.substring_index(F.coalesce(after, F.lit("")), "?", 1)
    host = F.substring_index(after, "/", 1)
    return lower_ascii(host), F.substr(after, F.length(host) + 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _bounds(rules: DataFrame) -> tuple[list[int], list[int]]:
    """The numbers of labels and the path lengths that rules have: two small sets, however many rules there are."""
    labels = F.size(F.split("host", "[.]"))
    found = rules.agg(F.sort_array(F.collect_set(labels)), F.sort_array(F.collect_set(F.length("path")))).first()
    return list(found[0]), list(found[1])


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Each row as ``row`` with ``host``, ``path``, the deciding ``rule`` (null if none) and ``verdict``.

    The join kind is left to Spark, which knows the size of the rules: a short list is broadcast, a long one is shuffled, and then
    an expression shared by many URLs (``com/``) is split by adaptive execution.
    """
    rules = rules.select(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna()
    # One row per rule: a rule that is listed twice decides once, and "block" sorts after "allow".
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    rules = rules.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_DIGITS))
    labels, lengths = _bounds(rules.select(F.col("r_host").alias("host"), F.col("r_path").alias("path")))

    parts = whole_rows(pages, F.col(url).cast("string").alias("_url"))
    host, path = url_parts(F.col("_url"))
    parts = parts.select("row", "_url", host.alias("host"), path.alias("path"))
    n_labels = F.size(F.split("host", "[.]"))
    suffixes = F.array(*[F.when(n_labels >= n, F.substring_index("host", ".", -n)) for n in labels]).cast("array<string>")
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]).cast("array<string>")
    some = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    pairs = F.flatten(F.transform(some(suffixes), lambda h: F.transform(some(prefixes), lambda p: _digest(h, p))))
    # Equal URLs are judged once.
    narrow = parts.select("_url", "host", "path").distinct().select("_url", F.explode(F.when(F.col("host") != "", pairs)).alias("digest"))
    hits = narrow.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS)).join(
        rules, (F.col("prefix") == F.col("r_prefix")) & (F.col("digest") == F.col("r_digest")))
    order = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), "r_verdict",
                     F.concat("r_host", "r_path").alias("rule"))
    best = hits.groupBy("_url").agg(F.max(order).alias("best"))
    return parts.join(best, "_url", "left").select(
        "row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
