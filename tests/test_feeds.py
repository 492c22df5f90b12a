"""Feed documents and item rules."""

from __future__ import annotations

import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedlake.functions import feeds as ff
from feedlake.operators import joins, state
from feedlake.plans import jobs
from feedlake.schemas import TABLES
from feedlake.sources import names, payloads

ITEM = "array<struct<type: string, href: string>>"
RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:itunes="i" xmlns:atom="a"><channel><title>Show</title>
<description>About</description><link>https://show</link><atom:link rel="self" href="self"/><language>en</language>{items}</channel></rss>"""


def item(guid, url="https://x.mp3", date="Tue, 05 Mar 2024 10:00:00 GMT", more=""):
    guid = f"<guid>{guid}</guid>" if guid else ""
    return f'<item>{guid}<title>T {guid and "g"}</title><pubDate>{date}</pubDate><enclosure type="audio/mpeg" url="{url}"/>{more}</item>'


@pytest.mark.parametrize("enclosures, links, expected", [
    ([("image/jpeg", "i"), ("audio/mpeg", "a")], [], "a"),
    ([], [("text/html", "p"), ("audio/x", "l")], "l"),
    ([("audio/mpeg", "")], [("audio/x", "l")], "l"),
    ([("audio/mpeg", None), ("audio/ogg", "second")], [], None),
    ([("image/jpeg", "i")], [("text/html", "p")], None),
    (None, None, None),
    ([(None, "x"), ("audio/mpeg", "a")], None, "a"),
])
def test_audio_url(spark, enclosures, links, expected):
    df = spark.createDataFrame([(enclosures, links)], f"e {ITEM}, l {ITEM}")
    assert df.select(ff.audio_url("e", "l")).first()[0] == expected


def test_durations(spark):
    cases = {"90": 90, "1:30": 90, "1:00:00": 3600, "1:75": 135, "1:2:3:4": None, "x": None, "12.5": None, " 7 ": 7, "": None, "1:": None,
             "1:x": None, "-5": -5, "99999999999999999999": None, "9999999999": None, "0:0:0": 0}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "d string")
    found = {r[0]: r[1] for r in df.select("d", ff.duration_seconds("d")).collect()}
    assert found == {**cases, None: None}


def test_dates(spark):
    ten = datetime(2024, 3, 5, 10)
    cases = {
        "Tue, 05 Mar 2024 10:00:00 GMT": ten, "Tue, 05 Mar 2024 12:00:00 +0200": ten, "5 Mar 24 10:00 UT": ten,
        "Tue, 5 Mar 2024 05:00:00 EST": ten, "2024-03-05T10:00:00Z": ten, "2024-03-05T11:00:00.5+01:00": ten, "2024-03-05T10:00Z": ten,
        "2024-03-05 10:00:00": ten, "Tue Mar  5 10:00:00 2024": ten, "March 5, 2024 10:00": ten, "2024/03/05 10:00": ten,
        "2024-03-05": datetime(2024, 3, 5), "Tuesday, March 5, 2024": datetime(2024, 3, 5), "20240305": datetime(2024, 3, 5),
        "3/5/2024": datetime(2024, 3, 5), "Tue,05 Mar 2024 10:00:00 GMT": ten, "2024-3-5": datetime(2024, 3, 5), "3/5/24": datetime(2024, 3, 5),
        "Tue Mar 5 10:00:00 UTC 2024": ten, "5.3.2024": datetime(2024, 5, 3), "25.3.2024": datetime(2024, 3, 25), "5th of March 2024 at 10 a.m.": ten, "10:00 March 5, 2024": ten,
        "05-Mar-24": datetime(2024, 3, 5), "05/Mar/2024:12:00:00 +0200": ten, "2024-03-05T02:00:00-08": ten, "2024-03": datetime(2024, 3, 1), "13 PM Mar 5 2024": None, "Mars 5 2024": None,
        "5 Mar 2024 6 7": None, "a|b": None, "29.2.2023": None, "soon": None, "": None, "40 Mar 2024 10:00:00 GMT": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert {r[0]: r[1] for r in df.select("d", ff.published_date("d")).collect()} == cases
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_file_names(spark):
    df = spark.createDataFrame([(7, "Héllo, wörld! #3")], "id int, title string")
    assert df.select(ff.safe_file_name("id", "title")).first()[0] == "7_Héllo_wörld_3_92541a3c.mp3"


def test_documents(spark):
    docs = {
        "rss": RSS.format(items=item("g1", more="<itunes:duration>1:30</itunes:duration><description><![CDATA[<b>x</b>]]></description>") + item(None)),
        "no audio": RSS.format(items="<item><title>T</title></item>"),
        "empty": RSS.format(items=""),
        "cut": RSS.format(items=item("g1"))[:200],
        "text": "nope",
        "null": None,
        "atom": '<feed xmlns="http://www.w3.org/2005/Atom"><title>At</title><subtitle>S</subtitle><link rel="self" href="s"/><link href="h"/><entry>'
                '<title>E</title><id>i1</id><published>2024-03-05T10:00:00Z</published><link rel="enclosure" type="audio/mpeg" href="a1"/></entry></feed>',
    }
    parsed = payloads.parsed(spark.createDataFrame(list(docs.items()), "name string, xml string"))
    headers = {r.name: (r.title, r.description, r.link, r.language, r.has_items) for r in payloads.feed_headers(parsed).collect()}
    show = ("Show", "About", "https://show", "en")
    assert headers == {
        "rss": (*show, True), "no audio": (*show, True), "empty": (*show, False), "cut": ("Unknown", "", "", "", False),
        "text": ("Unknown", "", "", "", False), "null": ("Unknown", "", "", "", False), "atom": ("At", "S", "h", "", True),
    }
    assert {r.name for r in payloads.feed_headers(parsed).collect() if r.malformed} == {"cut", "text", "null"}
    items = payloads.episode_items(payloads.raw_items(parsed))
    rows = [(r.name, r.pos, r.title, r.description, r.audio_url, r.published_date, r.duration_seconds, r.guid) for r in items.orderBy("name", "pos").collect()]
    date = datetime(2024, 3, 5, 10)
    assert rows == [
        ("atom", 0, "E", "", "a1", date, None, "i1"),
        ("rss", 0, "T g", "<b>x</b>", "https://x.mp3", date, 90, "g1"),
        ("rss", 1, "T", "", "https://x.mp3", date, None, "https://x.mp3"),
    ]


def table(spark, name, rows=()):
    return spark.createDataFrame(list(rows), TABLES[name])


def test_age_rule(spark):
    dates = [datetime(2024, 3, 1), datetime(2024, 2, 29, 23, 59, 59), None]
    df = spark.createDataFrame([(d,) for d in dates], "published_date timestamp_ntz")
    kept = [r[0] for r in df.filter(joins.recent_enough("published_date", datetime(2024, 3, 31), 30)).collect()]
    assert kept == [datetime(2024, 3, 1), None]
    assert df.filter(joins.recent_enough("published_date", datetime(2024, 3, 31), 0)).count() == 3


def sync(spark, payload_rows, episodes=(), **options):
    feeds = table(spark, "feeds", [(1, "A", "ua", True, None, None), (2, "B", "ub", True, None, None), (3, "C", "uc", False, None, None)])
    fetched = spark.createDataFrame([(n, *row) for n, row in enumerate(payload_rows)], "payload_no int, url string, xml string")
    return jobs.sync_feeds(feeds, table(spark, "episodes", episodes), table(spark, "processing_status"), fetched, datetime(2024, 3, 10), 30, **options)


def test_sync(spark):
    known = (9, 1, "old", "", "https://old.mp3", None, None, "known", None)
    result = sync(spark, [
        ("ua", RSS.format(items=item("known") + item("twice") + item("twice") + item("both") + item("late", date="Mon, 1 Jan 2024 10:00:00 GMT")
                          + item("undated", date="x"))),
        ("ub", RSS.format(items=item("both") + item("own"))),
        ("uc", RSS.format(items=item("disabled"))),
    ], [known])
    rows = [(r.id, r.feed_id, r.guid) for r in result.inserted.orderBy("id").collect()]
    assert rows == [(10, 1, "twice"), (11, 1, "both"), (12, 1, "undated"), (13, 2, "own")]
    assert {(r.feed_id, r.new_episodes) for r in result.totals.collect()} == {(1, 3), (2, 1), (None, 4)}
    assert {(r.id, r.last_checked) for r in result.feeds.collect()} == {(1, datetime(2024, 3, 10)), (2, datetime(2024, 3, 10)), (3, None)}
    assert {(r.episode_id, r.status) for r in result.status.collect()} == {(i, "pending") for i in range(10, 14)}
    assert result.episodes.count() == 5


def test_sync_with_hash_ids_and_configured_feeds(spark):
    configured = spark.createDataFrame([(0, "New", "un", True), (1, "A2", "ua", False)], "pos int, name string, url string, enabled boolean")
    result = sync(spark, [("un", RSS.format(items=item("n1"))), ("ua", RSS.format(items=item("a1")))], ids="hash", configured=configured)
    rows = result.inserted.collect()
    assert [(r.feed_id, r.guid) for r in rows] == [(4, "n1")] and rows[0].id is not None
    assert {r.name: r.enabled for r in result.feeds.collect()} == {"A2": False, "B": True, "C": False, "New": True}


def test_insert_rules(spark):
    """NULL guids never collide; rows that miss a value or a feed are dropped and do not claim their guid."""
    feeds = table(spark, "feeds", [(1, "A", "ua", True, None, None)])
    schema = "feed_id bigint, pos int, title string, description string, audio_url string, published_date timestamp_ntz, duration_seconds int, guid string"
    rows = [(1, 0, None, "", "a", None, None, "g"), (1, 1, "ok", "", "a", None, None, "g"), (1, 2, "n1", "", "a", None, None, None),
            (1, 3, "n2", "", "a", None, None, None), (5, 0, "x", "", "a", None, None, "h"), (1, 4, "t", "", None, None, None, "i")]
    inserted = state.insert_items(table(spark, "episodes"), spark.createDataFrame(rows, schema), feeds, "2024-01-01")
    assert [(r.id, r.title) for r in inserted.orderBy("id").collect()] == [(1, "ok"), (2, "n1"), (3, "n2")]


def test_quality_and_shortening(spark):
    df = spark.createDataFrame([("best",), ("good",), ("medium",), ("x",), (None,)], "q string")
    assert [r[0] for r in df.select(ff.quality_level("q")).collect()] == ["0", "2", "5", "2", "2"]
    df = spark.createDataFrame([("a" * 60,), ("a" * 61,)], "t string")
    assert [r[0] for r in df.select(ff.shorten("t", 60)).collect()] == ["a" * 60, "a" * 60 + "..."]


def test_media_type_filter(spark):
    df = spark.createDataFrame([("rss", "u"), ("link", "u"), ("", "u"), (None, "u"), ("video", "u"), ("video", "https://RSS"), ("RSS", "u")], "t string, u string")
    assert [r[0] for r in df.select(F.coalesce(ff.is_feed("t", "u"), F.lit(None))).collect()] == [True, True, True, True, False, True, False]


def test_two_payloads_of_one_feed(spark):
    """The first payload wins; without numbers the order would be undefined, and is refused."""
    rows = [("ua", RSS.format(items=item("same"))), ("ua", RSS.format(items=item("other") + item("same")))]
    result = sync(spark, rows).inserted.orderBy("id").collect()
    assert [r.guid for r in result] == ["same", "other"]
    with pytest.raises(ValueError, match="payload_no"):
        jobs.sync_feeds(table(spark, "feeds"), table(spark, "episodes"), table(spark, "processing_status"),
                        spark.createDataFrame(rows, "url string, xml string"), datetime(2024, 3, 10))


NAMED = {
    "atom": '<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>At</a:title><a:link href="h"/><a:entry><a:title>E</a:title><a:id>i</a:id>'
            '<a:link rel="enclosure" type="audio/x" href="u"/><a:summary>s</a:summary></a:entry></a:feed>',
    "other case": '<rss xmlns:x="HTTP://WWW.ITUNES.COM/dtds/PodCast-1.0.dtd"><channel><title>T</title><item><x:duration>1:00</x:duration><title>E</title><guid>i</guid>'
                  '<enclosure type="audio/x" url="u"/><description>s</description></item></channel></rss>',
    "rebound": '<rss xmlns:x="urn:none"><channel><title>T</title><item><x:duration>9</x:duration><x:duration xmlns:x="http://www.itunes.com/dtds/podcast-1.0.dtd">1:00</x:duration>'
               '<x:guid>no</x:guid><guid>i</guid><title>E</title><enclosure type="audio/x" url="u"/><description>s</description></item></channel></rss>',
    "local atom": '<rss><channel><title>T</title><item><title>E</title><guid>i</guid><link xmlns="http://www.w3.org/2005/Atom" rel="enclosure" type="audio/x" href="u"/>'
                  '<description>s</description></item></channel></rss>',
    "entities": '<!DOCTYPE rss [<!ENTITY e "E"> <!ENTITY b "a&b;"> <!ENTITY m "<i>"> <!ENTITY x SYSTEM "f">]><rss><channel><title>&Eacute;&nbsp;&lt;&#233;</title><item><title>&e;</title><guid>i</guid>'
                '<enclosure type="audio/x" url="u"/><description><![CDATA[s]]></description></item></channel></rss>',
    "cdata": '<rss xmlns:x="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>T</title><item><title>E</title><guid>i</guid><enclosure type="audio/x" url="u"/>'
             '<description><![CDATA[<x:duration>&eacute;<!--]]></description><!-- <x:duration>7</x:duration> --></item></channel></rss>',
    "rdf": '<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:c="http://purl.org/rss/1.0/"><c:channel><c:title>T</c:title></c:channel><c:item><c:title>E</c:title><guid>i</guid>'
           '<enclosure type="audio/x" url="u"/><c:description>s</c:description></c:item></r:RDF>',
    "unknown entity": '<rss><channel><title>a &nosuch; b</title></channel></rss>',
    "page": "<html><body>&eacute;</body></html>",
}


def test_names_and_entities(spark):
    parsed = payloads.parsed(spark.createDataFrame(list(NAMED.items()), "name string, xml string"))
    headers = {r.name: (r.title, r.malformed) for r in payloads.feed_headers(parsed).collect()}
    assert headers == {"atom": ("At", False), "other case": ("T", False), "rebound": ("T", False), "local atom": ("T", False), "entities": ("É <é", False), "cdata": ("T", False),
                       "rdf": ("T", False), "unknown entity": ("a &nosuch; b", True), "page": ("Unknown", True)}
    items = {r.name: (r.title, r.guid, r.audio_url, r.description, r.duration_seconds) for r in payloads.episode_items(payloads.raw_items(parsed)).collect()}
    plain = ("E", "i", "u", "s", None)
    assert items == {"atom": plain, "other case": (*plain[:4], 60), "rebound": (*plain[:4], 60), "local atom": plain, "entities": plain,
                     "cdata": ("E", "i", "u", "<x:duration>&eacute;<!--", None), "rdf": plain}


def test_plain_documents_do_not_leave_the_jvm(spark):
    """Usual prefixes and the five entities of XML need no pass; a document that closes wrongly keeps its names."""
    usual = ['<rss xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:atom="http://www.w3.org/2005/Atom"><channel><atom:link href="x"/><title>&amp;&#233;</title></channel></rss>',
             '<feed xmlns="http://www.w3.org/2005/Atom"><title>x</title></feed>', '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><item/></rdf:RDF>', None]
    df = spark.createDataFrame([(x,) for x in usual], "xml string")
    assert not any(r[0] for r in df.select(names.needs_pass(F.col("xml"))).collect())
    broken = "<a><b></a></b><c x='>' y=\"<\"/>&x;<!-- "
    assert names.resolved(broken) == broken
    assert names.resolved("<" * 5000 + "\"'" * 5000) == "<" * 5000 + "\"'" * 5000


def test_documents_that_need_the_pass_are_found_fast(spark):
    """The pattern that tells them looks at few characters twice; tried as a whole at every character, it cost more than all the rest of the parsing."""
    any_of = lambda p: "(?:" + "|".join(re.escape(a) for a in names.NAMESPACES[p]) + ")"
    plain = [r"&(?!(?:amp|lt|gt|quot|apos);)[a-z_][a-z0-9_.-]*;", r"<(?!rdf:)[a-z_][^\s<>:/]*:(?:feed|rdf|rss)[\s>]",
             rf"""<(?!(?:feed|rss)[\s>])[a-z_][^<>]*\sxmlns\s*=\s*["']{any_of("atom")}["']"""]
    for p in names.NAMESPACES:
        plain.append(rf"""\sxmlns:{f"(?!{p}\\s*=)" if p else ""}[^\s=]+\s*=\s*["']{any_of(p)}["']""")
        plain += [rf"""\sxmlns\s*=\s*["']{any_of(p)}["']"""] if p not in ("", "atom") else []
    itunes, atom, dc = (names.NAMESPACES[p][0] for p in ("itunes", "atom", "dc"))
    texts = [
        "", "x", "&", "a &AMP; b", "a &nbsp b", "a &Nbsp; b", "&amp;&lt;", "<", "<a:feed>", "<rdf:RDF >", "<RDF:rdf>", "<A:RSS\n>", f"<rss xmlns:itunes='{itunes}'>",
        f"<rss XMLNS:own = '{itunes.upper()}'>", f"<rss axmlns:own='{itunes}'>", f"<p xmlns='{dc}'>", f"<feed xmlns='{atom}'>", f"<p xmlns='{atom}'>", f"xmlns:a='{atom}'",
        f"<feed\txmlns:atom='{atom}'>", "<rss xmlns:q='http://purl.org/rss/1.0/'>", f"<p a='1' xmlns=\"{atom}\">", "xxmlns xmlns", f" xxmlns:a='{dc}'", None]
    rows = spark.createDataFrame([(t,) for t in texts], "xml string")
    found = rows.select("xml", names.needs_pass(F.col("xml")).alias("is"), F.rlike("xml", F.lit("(?i)" + "|".join(plain))).alias("plain")).collect()
    assert [r["is"] for r in found] == [r.plain for r in found] and 8 <= sum(bool(r["is"]) for r in found) < len(texts) - 8

    long = spark.range(8).select(F.repeat(F.lit("Some words of a long text without any markup. "), 50_000).alias("xml"))

    def seconds(test):
        start = time.perf_counter()
        assert long.filter(test).count() == 0
        return time.perf_counter() - start

    assert min(seconds(names.needs_pass(F.col("xml"))) for _ in range(2)) < 0.5 * min(seconds(F.rlike("xml", F.lit("(?i)" + "|".join(plain)))) for _ in range(2))
