"""Feed lists: scan, validation, import, export."""

from __future__ import annotations

import subprocess
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from feedlake.operators import aggregates, state
from feedlake.plans import jobs
from feedlake.schemas import TABLES
from feedlake.sinks import documents
from feedlake.sources import outlines

CASES = {
    "flat": '<opml><body><outline type="rss" text="A" xmlUrl="https://a/rss"/></body></opml>',
    "nested": '<opml><body><outline text="C"><outline text="D"><outline text="A" xmlUrl="https://a"/></outline></outline>'
              '<outline text="B" xmlUrl="https://b"/></body></opml>',
    "names": '<opml><body><outline title="T" xmlUrl="https://a"/><outline text="" title="" xmlUrl="https://b"/></body></opml>',
    "types": '<opml><body><outline text="1" type="rss" xmlUrl="https://a"/><outline text="2" type="link" xmlUrl="https://b"/>'
             '<outline text="3" xmlUrl="https://c"/><outline text="4" type="audio" xmlUrl="https://d/RSS"/>'
             '<outline text="5" type="video" xmlUrl="https://e"/></body></opml>',
    "optional": '<opml><body><outline text="A" xmlUrl="https://a" description="d &amp; e" htmlUrl="h" category="k"/></body></opml>',
    "below a feed": '<opml><body><outline text="A" xmlUrl="https://a"><outline text="B" xmlUrl="https://b"/></outline></body></opml>',
    "other elements": '<opml><body><group><outline text="A" xmlUrl="https://a"/></group></body></opml>',
    "empty category": '<opml><body><outline text="C"><outline text="D"/></outline></body></opml>',
    "no body": "<opml><head/></opml>",
    "not xml": "This is no XML.",
    "latin": '<?xml version="1.0" encoding="ISO-8859-1"?><opml><body><outline text="é" xmlUrl="https://a"/></body></opml>',
}


def documents_of(spark, cases):
    return spark.createDataFrame(
        [(k, v.encode("latin-1" if k == "latin" else "utf-8")) for k, v in cases.items()], "file string, content binary")


def test_scan(spark):
    rows = outlines.outline_rows(documents_of(spark, CASES))
    found = {}
    for r in outlines.feeds_of(rows).orderBy("file", "pos").collect():
        found.setdefault(r.file, []).append((r.name, r.url))
    assert found == {
        "flat": [("A", "https://a/rss")],
        "nested": [("A", "https://a"), ("B", "https://b")],
        "names": [("T", "https://a"), ("Unnamed Feed", "https://b")],
        "types": [("1", "https://a"), ("2", "https://b"), ("3", "https://c"), ("4", "https://d/RSS")],
        "optional": [("A", "https://a")],
        "below a feed": [("A", "https://a")],
        "latin": [("é", "https://a")],
    }
    failed = {r.file for r in rows.filter("error IS NOT NULL").collect()}
    assert failed == {"no body", "not xml"}
    optional = outlines.feeds_of(rows).filter("file = 'optional'").first()
    assert (optional.description, optional.html_url, optional.category) == ("d & e", "h", "k")


def test_scan_of_files(spark, tmp_path):
    groups = "".join(
        f'<outline text="G{g}">' + "".join(f'<outline text="P{g}.{i}" type="rss" xmlUrl="https://x/{g}/{i}"/>' for i in range(20)) + "</outline>"
        for g in range(5))
    (tmp_path / "large.opml").write_text(f"<opml><body>{groups}</body></opml>")
    (tmp_path / "broken.opml").write_text("<opml><body>")
    rows = outlines.read_outline_files(spark, str(tmp_path))
    assert outlines.feeds_of(rows).count() == 100
    assert rows.filter("error IS NOT NULL").count() == 1


def test_many_rows_cross_frames(spark):
    many = "".join(f'<outline xmlUrl="https://x/{i}"/>' for i in range(12_000))
    rows = outlines.outline_rows(documents_of(spark, {"a": f"<opml><body>{many}</body></opml>", "b": CASES["flat"], "c": CASES["not xml"]}))
    assert rows.groupBy("file").count().orderBy("file").collect() == [("a", 12_000), ("b", 1), ("c", 1)]


def test_validation(spark):
    feeds = spark.createDataFrame(
        [("A", "https://a"), ("B", None), ("C", ""), (None, "https://d"), ("", " https://e "), ("F", "ftp://f"), ("G", "not-a-url"),
         ("H", "HTTP://h"), ("I", "httpx://i"), ("J", " \nhttp://j\t")], "name string, url string")
    rows = {(r.name, r.url) for r in outlines.valid_feeds(feeds).collect()}
    assert rows == {("A", "https://a"), ("Feed from https://d", "https://d"), ("Feed from  https://e ", "https://e"),
                    ("I", "httpx://i"), ("J", "http://j")}


def no_feeds(spark):
    return spark.createDataFrame([], TABLES["feeds"])


def batch(spark, rows):
    return spark.createDataFrame(rows, "pos int, name string, url string").withColumn("enabled", F.lit(True))


def test_batch_import(spark):
    outcomes = state.feed_outcomes(no_feeds(spark), batch(spark, [(0, "a", "u1"), (1, "b", "u1"), (2, "c", ""), (3, "d", "u2")]))
    assert aggregates.import_counts(outcomes).first() == (2, 2)
    rows = state.upsert_feeds(no_feeds(spark), outcomes, "2024-01-01").orderBy("id").collect()
    assert [(r.id, r.name, r.url, r.enabled) for r in rows] == [(1, "b", "u1", True), (2, "d", "u2", True)]


def test_import_twice(spark):
    first = batch(spark, [(i, f"Podcast {i}", f"https://example.com/feed/{i}") for i in range(100)])
    feeds = state.upsert_feeds(no_feeds(spark), state.feed_outcomes(no_feeds(spark), first), "2024-01-01")
    again = state.feed_outcomes(feeds, first)
    assert aggregates.import_counts(again).first() == (0, 100)
    assert state.upsert_feeds(feeds, again, "2024-01-02").exceptAll(feeds).count() == 0


def test_import_job(spark):
    result = jobs.import_outlines(no_feeds(spark), documents_of(spark, CASES), "2024-01-01", enabled=False)
    assert result.counts.first() == (5, 7)
    assert result.feeds.count() == 5
    assert result.confirmed.count() == 0  # imported as disabled


def test_import_of_nothing(spark):
    result = jobs.import_outlines(no_feeds(spark), documents_of(spark, {"x": CASES["not xml"]}), "2024-01-01")
    assert result.counts.first() == (0, 0)


def whole(parts):
    return "\n".join(r.text for r in parts.orderBy("part", "position").collect())


def test_export(spark):
    feeds = spark.createDataFrame(
        [(2, "B", "https://b", None, ""), (1, 'A & "x" <y>', "https://a?x=1&y=2", "d\n2", "h"), (3, None, "https://c", "", None)],
        "id bigint, name string, url string, description string, html_url string")
    assert whole(documents.outline_document(feeds, "Mine & yours")) == """<?xml version='1.0' encoding='utf-8'?>
<opml version="2.0">
  <head>
    <title>Mine &amp; yours</title>
  </head>
  <body>
    <outline type="rss" text="A &amp; &quot;x&quot; &lt;y&gt;" xmlUrl="https://a?x=1&amp;y=2" description="d&#10;2" htmlUrl="h" />
    <outline type="rss" text="B" xmlUrl="https://b" />
    <outline type="rss" text="Unnamed Feed" xmlUrl="https://c" />
  </body>
</opml>"""


def test_export_of_nothing(spark):
    feeds = spark.createDataFrame([], "id bigint, name string, url string")
    assert whole(documents.outline_document(feeds)).endswith("  </head>\n  <body />\n</opml>")


def test_round_trip_through_files(spark, tmp_path):
    feeds = spark.createDataFrame([(i, f"Pod & {i}", f"https://example.com/{i}", i % 2 == 0, None, None) for i in range(50)], TABLES["feeds"])
    documents.write_document(jobs.export_outline(feeds), str(tmp_path / "out"))
    joined = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "out").glob("part-*")) if p.stat().st_size)
    back = outlines.feeds_of(outlines.outline_rows(documents_of(spark, {"f": joined}))).select("name", "url")
    assert back.exceptAll(feeds.filter("enabled").select("name", "url")).count() == 0
    assert back.count() == 25


def test_worker_code_needs_no_package(tmp_path):
    """Executors without this repository can run the outline scan."""
    (tmp_path / "f").write_bytes(cloudpickle.dumps(outlines._read))
    code = (
        "import pickle, pandas as pd; read = pickle.load(open('f', 'rb'));"
        "frame = pd.DataFrame({'file': ['a'], 'content': [b'<opml><body><outline xmlUrl=\"u\"/></body></opml>']});"
        "print(next(read(iter([frame])))['url'][0])"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "u", done.stderr
