"""Companies named in texts, found by a join to a table of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import col
from ..schemas import SUMMARY_ARRAYS


def name_words(text: str | Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def company_mentions(texts: DataFrame, names: DataFrame, key: str = "episode_id", text: str = "text") -> DataFrame:
    """``(key, company_mentions)`` for the texts that name a company of the table ``(name, industry)``, in the order of the names.

    A name is found as the same run of words. The word runs of a text, of the lengths that names have, are joined to the names on equal
    text; how is left to Spark, which knows the size of the name table. Only matches are regrouped. Names without a word find nothing.
    """
    listed = names.select("name", "industry", F.array_join(name_words("name"), " ").alias("_run"), F.size(name_words("name")).alias("_n"))
    listed = listed.filter("_n > 0").dropDuplicates(["name", "_run"])
    lengths = sorted(r[0] for r in listed.select("_n").distinct().collect())  # a few small numbers
    if not lengths:
        return texts.limit(0).select(key, F.array().cast(SUMMARY_ARRAYS["company_mentions"]).alias("company_mentions"))
    worded = texts.select(key, name_words(text).alias("_words"))

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice("_words", i, n), " "))

    said = worded.select(key, F.explode(F.array_distinct(F.concat(*[runs(n) for n in lengths]))).alias("_run")).join(listed, "_run")
    mention = F.struct("name", F.coalesce("industry", F.lit("")).alias("industry"), F.lit("Named in the transcript").alias("context"), F.lit("").alias("details"))
    grouped = said.groupBy(key).agg(F.sort_array(F.collect_list(mention)).alias("company_mentions"))
    return grouped.select(key, F.col("company_mentions").cast(SUMMARY_ARRAYS["company_mentions"]).alias("company_mentions"))


def with_mentions(summaries: DataFrame, mentions: DataFrame, key: str = "episode_id", summary: str = "summary") -> DataFrame:
    """Summaries ``(key, summary)`` with the companies that their texts name; a missing summary stays missing."""
    found = mentions.withColumnRenamed("company_mentions", "_found")
    named = F.when(F.col("_found").isNull(), F.col(summary)).otherwise(F.col(summary).withField("company_mentions", F.col("_found")))
    return summaries.join(found, key, "left").withColumn(summary, named).drop("_found")
