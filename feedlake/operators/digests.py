"""The periodic digest as an ordered table of text parts.

A digest grows with the number of items, so it is never built as one string: it is a table ``(part, position, text)`` whose rows,
in that order and joined by line ends, are the document. ``sinks.documents`` writes it as ordered text files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digest as fd
from ..functions import summaries as fs
from .aggregates import digest_heading
from .ordering import with_position

# The titles and the texts of an empty digest. The frame around them is our own.
TITLE = "Your Weekly Podcast Digest"
CONTENTS = "This Week's Episodes"
EMPTY_TEXT = "No podcast episodes were processed this week."
EMPTY_SUBTITLE = "No episodes processed this week"
EMPTY_BODY = "No podcast episodes were processed in the last 7 days. Check your feeds or processing status."
HTML_HEAD = '<!DOCTYPE html>\n<html>\n<head><meta charset="UTF-8"></head>\n<body>'
HTML_FOOT = "<footer>This is an automated weekly digest.</footer>\n</body>\n</html>"
TEXT_FOOT = "\n" + "=" * 50 + "\nGenerated by feedlake"


def positioned(base: DataFrame) -> DataFrame:
    """Newest completion first: ``position`` 0..n-1 counts items without a summary too."""
    return with_position(base, F.col("completed_at").desc(), "id", into="position", start=0)


def with_summary(base: DataFrame, summaries: DataFrame) -> DataFrame:
    """Left join to the latest summary of each item, one job instead of one lookup per item.

    The latest row is picked on ids and times alone; only then are the texts fetched, by the picked ids. ``base`` is read once.
    """
    versions = summaries.select(F.col("episode_id").alias("_of"), "created_at", F.col("id").alias("_version"))
    newest = F.max(F.struct("created_at", "_version")).alias("_newest")
    picked = base.join(versions, F.col("id") == F.col("_of"), "left").groupBy(*base.columns).agg(newest)
    texts = fs.stored(summaries).select(F.col("id").alias("_version"), "summary")
    return picked.withColumn("_version", F.col("_newest._version")).join(texts, "_version", "left").select(*base.columns, "summary")


def _episode() -> Column:
    return F.struct("title", "feed_name", "published_date")


def _rows(df: DataFrame, *parts: tuple[int, Column, Column, Column | None]) -> DataFrame:
    """Rows ``(part, position, text)`` out of each row of ``df``, for the parts whose condition holds: one pass for all."""
    made = []
    for part, position, text, condition in parts:
        row = F.struct(F.lit(part).alias("part"), position.cast("bigint").alias("position"), text.alias("text"))
        made.append(row if condition is None else F.when(condition, row))
    # The outer form adds no filter below, which would render every text twice.
    return df.select(F.explode_outer(F.array(*made)).alias("r")).filter("r IS NOT NULL").select("r.*")


def _frame(base: DataFrame, *parts: tuple[int, Column | str, Column | None]) -> DataFrame:
    """The parts that occur once."""
    fixed = [(part, F.lit(0), F.lit(t) if isinstance(t, str) else t, condition) for part, t, condition in parts]
    return _rows(digest_heading(base), *fixed)


def html_digest(base: DataFrame, summaries: DataFrame, full: bool = False) -> DataFrame:
    """``base``: items with ``position``. Without items, the fixed empty page."""
    some, none = F.col("n") > 0, F.col("n") == 0
    intro = F.concat(
        F.lit(f"<header>\n<h1>🎧 {TITLE}</h1>\n<p>"), "date_range", F.lit("<br>"), "counted", F.lit("</p>\n</header>"),
    )
    empty = f"<header>\n<h1>🎧 {TITLE}</h1>\n<p>{EMPTY_SUBTITLE}</p>\n</header>\n<p>{EMPTY_BODY}</p>"
    frame = _frame(
        base, (0, HTML_HEAD, None), (1, intro, some), (1, empty, none),
        (2, f"<nav>\n<h2>{CONTENTS}</h2>\n<ol>", some), (4, "</ol>\n</nav>", some), (6, HTML_FOOT, None),
    )
    position, summary = F.col("position"), F.col("summary")
    items = _rows(
        with_summary(base, summaries),
        (3, position, fd.contents_line(_episode(), position, summary.isNotNull()), None),
        (5, position, fd.html_block(_episode(), summary, position, full), summary.isNotNull()),
    )
    return frame.unionByName(items)


def text_digest(base: DataFrame, summaries: DataFrame) -> DataFrame:
    """Plain-text form; the numbers start at 1 and count items without a summary."""
    some, none = F.col("n") > 0, F.col("n") == 0
    intro = F.concat(F.lit(f"{TITLE.upper()}\n{'=' * 50}\n\n"), "counted", F.lit("\n"))
    frame = _frame(base, (0, intro, some), (0, EMPTY_TEXT, none), (2, TEXT_FOOT, some))
    position, summary = F.col("position"), F.col("summary")
    items = _rows(
        with_summary(base, summaries).filter(summary.isNotNull()),
        (1, position, fd.text_block(_episode(), summary, position + 1), None),
    )
    return frame.unionByName(items)
