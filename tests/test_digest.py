"""The digest documents."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from feedlake.functions import digest as fd
from feedlake.operators import aggregates, digests
from feedlake.plans import jobs
from feedlake.schemas import TABLES

NOW = datetime(2024, 3, 8)


def tables(spark, completed, summaries):
    """Items 1.. of one feed with the given completion times, and stored summaries ``(episode_id, overview, quotes)``."""
    feeds = spark.createDataFrame([(1, "F & co", "u", True, None, None)], TABLES["feeds"])
    episodes = spark.createDataFrame(
        [(i, 1, f"<Title {i}>", "", "a", NOW if i == 1 else None, None, f"g{i}", None) for i in range(1, len(completed) + 1)], TABLES["episodes"])
    status = spark.createDataFrame([(i, "completed", None, None, None, None, None, None, c, None) for i, c in enumerate(completed, 1)],
                                   TABLES["processing_status"])
    stored = spark.createDataFrame(
        [(n, e, None, text, None, json.dumps(quotes), "", None, None, "m", datetime(2024, 1, 1 + n)) for n, (e, text, quotes) in enumerate(summaries)],
        TABLES["summaries"])
    return episodes, feeds, status, stored


def lines(parts):
    return "\n".join(r.text for r in parts.orderBy("part", "position").collect())


def test_text(spark):
    quotes = [{"quote": f"q{i}", "speaker": "S" if i else None} for i in range(3)]
    digest = jobs.weekly_digest(*tables(spark, [datetime(2024, 3, 5), datetime(2024, 3, 7), datetime(2024, 3, 6)],
                                        [(1, "old", []), (1, "new", quotes), (3, "", [])]), as_of=NOW)
    rule = "=" * 50
    assert lines(digest.text) == f"""YOUR WEEKLY PODCAST DIGEST
{rule}

3 episodes processed this week


2. <Title 3>
   F & co
{"-" * 50}

3. <Title 1>
   F & co
{"-" * 50}

new

Top Quotes:
  "q0" - Unknown
  "q1" - S


{rule}
Generated by feedlake"""


def test_html(spark):
    digest = jobs.weekly_digest(*tables(spark, [datetime(2024, 3, 5), datetime(2024, 3, 7)], [(1, "a < b", [])]), as_of=NOW)
    html = lines(digest.html)
    assert '<p>March 05 - March 07, 2024<br>' in html and "2 episodes processed this week" in html
    assert '<li>&lt;Title 2&gt; <em>F &amp; co</em></li>' in html  # no summary: listed without a link
    assert '<li><a href="#item-1">&lt;Title 1&gt;</a>' in html and 'id="item-1"' in html and 'id="item-0"' not in html
    assert "<p>a &lt; b</p>" in html and "March 08, 2024" in html and "Top Quotes" not in html


def test_empty(spark):
    digest = jobs.weekly_digest(*tables(spark, [datetime(2024, 1, 1)], []), as_of=NOW)
    assert lines(digest.text) == digests.EMPTY_TEXT
    html = lines(digest.html)
    assert "No episodes processed this week" in html and "toc" not in html and html.endswith("</html>")


def test_heading(spark):
    def heading(*times):
        return aggregates.digest_heading(spark.createDataFrame([(t,) for t in times], "completed_at timestamp_ntz")).first()

    one = heading(datetime(2024, 3, 5, 1), datetime(2024, 3, 5, 23))
    assert (one.n, one.date_range) == (2, "March 05, 2024")
    assert heading(datetime(2024, 3, 1), datetime(2024, 3, 5)).date_range == "March 01 - March 05, 2024"
    assert (heading(None).date_range, heading(None).counted) == ("This Week", "1 episode processed this week")


def test_display_dates(spark):
    cases = {"2024-03-05T10:00:00Z": "March 05, 2024", "2024-03-05": "March 05, 2024", "soon": "soon", "": "Unknown date", None: "Unknown date"}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    assert {r[0]: r[1] for r in df.select("d", fd.display_date("d")).collect()} == cases
    assert spark.range(1).select(fd.display_date(F.lit("2024-03-05").cast("timestamp_ntz"))).first()[0] == "March 05, 2024"
