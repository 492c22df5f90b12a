"""Scans, sinks, digests, streams and whole jobs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.basic import escape_attribute, escape_xml, utc_instant
from feedlake.operators import digests, state
from feedlake.plans import jobs
from feedlake.schemas import TABLES
from feedlake.sinks import documents
from feedlake.sinks import tables as table_sinks
from feedlake.sinks.keyed import KeyedTable
from feedlake.sinks.packs import write_packs
from feedlake.sources import files, outlines, packs, payloads
from feedlake.sources import tables as table_sources
from feedlake.storage import fresh_dir, spread
from feedlake.streaming import streams

from .registry import query
from .relational import DIGEST_BASE, digest_base_of
from .texts import CHUNK, CHUNKS, replies
from .updates import UPSERT, _with_batch
from .views import AS_OF, DAYS, Tables, logs_of_events, sql

NOW = f"TIMESTAMP '{AS_OF}'"
SYNC_AS_OF, SYNC_AGE = "2025-02-01 00:00:00", 200


# --- feed lists ---------------------------------------------------------------------------------------------------------------


def outline_files(t: Tables) -> DataFrame:
    """One outline document per customer: nested feeds, a rejected type, a feed below a feed.

    A few are cut short, have no body, an unknown encoding, or no content.
    """
    key, name = F.col("c_custkey").cast("string"), escape_attribute("c_name")
    whole = F.concat(
        F.lit('<?xml version="1.0"?><opml version="2.0"><head/><body><outline text="Group"><outline type="rss" text="'), name,
        F.lit('" xmlUrl="https://feeds.example.com/'), key, F.lit('" description="a &amp; b" htmlUrl="h"/><outline text="Sub"><outline title="T'),
        key, F.lit('" text="" type="video" xmlUrl="https://RSS.example.com/'), key,
        F.lit('"><outline xmlUrl="https://inner.example.com/"/></outline></outline></outline><outline type="video" text="v" xmlUrl="https://v.example.com/'),
        key, F.lit('" category="'), F.col("c_mktsegment"), F.lit('"/></body></opml>'),
    )
    odd = F.col("c_custkey") % 20
    content = (
        F.when(odd == 3, F.substring(whole, 1, 80)).when(odd == 7, F.lit("<opml><head/></opml>"))
        .when(odd == 11, F.replace(whole, F.lit('version="1.0"'), F.lit('version="1.0" encoding="no-such"'))).when(odd != 13, whole)
    )
    return t.given("customer").select(F.concat(F.lit("c"), key).alias("file"), content.alias("content"))


GOOD = "FROM customer WHERE c_custkey % 20 NOT IN (3, 7, 11, 13)"
NESTED = f"""SELECT 'c' || c_custkey AS file, 0 AS pos, c_name AS name, 'https://feeds.example.com/' || c_custkey AS url {GOOD}
    UNION ALL SELECT 'c' || c_custkey, 1, 'T' || c_custkey, 'https://RSS.example.com/' || c_custkey {GOOD}"""


@query("s1_outline_rows", f"""SELECT 'c' || c_custkey AS file, 0 AS pos, c_name AS text, CAST(NULL AS VARCHAR) AS title, 'rss' AS type,
        'https://feeds.example.com/' || c_custkey AS url, 'a & b' AS description, CAST(NULL AS VARCHAR) AS category, false AS failed {GOOD}
    UNION ALL SELECT 'c' || c_custkey, 1, '', 'T' || c_custkey, 'video', 'https://RSS.example.com/' || c_custkey, NULL, NULL, false {GOOD}
    UNION ALL SELECT 'c' || c_custkey, 2, 'v', NULL, 'video', 'https://v.example.com/' || c_custkey, NULL, c_mktsegment, false {GOOD}
    UNION ALL SELECT 'c' || c_custkey, 0, NULL, NULL, NULL, NULL, NULL, NULL, true FROM customer
        WHERE c_custkey % 20 IN (3, 7, 11, 13)""")
def outline_rows(t):
    rows = outlines.outline_rows(outline_files(t))
    return rows.select("file", "pos", "text", "title", "type", "url", "description", "category", F.col("error").isNotNull().alias("failed"))


@query("s1_outline_feeds", NESTED)
def outline_feeds(t):
    return outlines.feeds_of(outlines.outline_rows(outline_files(t))).select("file", "pos", "name", "url")


OUTLINE = """SELECT 0 AS part, CAST(0 AS BIGINT) AS position, '<?xml version=''1.0'' encoding=''utf-8''?>
<opml version="2.0">
  <head>
    <title>My &amp; feeds</title>
  </head>
  <body>' AS text
    UNION ALL SELECT 1, row_number() OVER (ORDER BY id) - 1, '    <outline type="rss" text="' || name || '" xmlUrl="' || url || '" />'
        FROM feeds WHERE enabled
    UNION ALL SELECT 2, 0, '  </body>
</opml>'"""


@query("k1_outline_document", sql("""SELECT 0 AS part, CAST(0 AS BIGINT) AS position, '<?xml version=''1.0'' encoding=''utf-8''?>
<opml version="2.0">
  <head>
    <title>Feeds</title>
  </head>
  <body>' AS text UNION ALL SELECT 2, 0, '  </body>
</opml>' UNION ALL SELECT 1 AS part, row_number() OVER (ORDER BY id) - 1 AS position, '    <outline type="rss" text="'
    || replace(replace(name, '#', '&amp;'), 'C', '&lt;') || '" xmlUrl="' || url || '" description="a&#10;&quot;b&quot;" '
    || CASE WHEN enabled THEN 'htmlUrl="' || id || '" ' ELSE '' END || '/>' AS text FROM feeds""", "feeds"))
def outline_document(t):
    marked = t.feeds.withColumn("name", F.replace(F.replace("name", F.lit("#"), F.lit("&")), F.lit("C"), F.lit("<")))
    marked = marked.withColumn("description", F.lit('a\n"b"')).withColumn("html_url", F.when(F.col("enabled"), F.col("id").cast("string")))
    return documents.outline_document(marked)


@query("o2_round_trip", sql("""SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra
    FROM feeds""", "feeds"))
def round_trip(t):
    feeds = t.feeds.select(F.concat(F.lit("<"), "name", F.lit(' & "'), "id").alias("name"), "url")
    line = documents.outline_line(F.col("name"), F.col("url"), F.lit(""), F.lit(""))
    files = feeds.select(F.col("url").alias("file"), F.concat(F.lit("<opml><body>"), line, F.lit("</body></opml>")).alias("content"))
    back = outlines.feeds_of(outlines.outline_rows(files)).select("name", "url")
    marks = [feeds.withColumn("kind", F.lit("all")), feeds.exceptAll(back).withColumn("kind", F.lit("missing")),
             back.exceptAll(feeds).withColumn("kind", F.lit("extra"))]
    rows = marks[0].unionByName(marks[1]).unionByName(marks[2])
    return rows.agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(a) for k, a in (("all", "n"), ("missing", "missing"), ("extra", "extra"))])


@query("p4_import", sql(_with_batch(f"SELECT row_number() OVER (ORDER BY file, pos) AS pos, name, url, true AS enabled FROM ({NESTED})", UPSERT), "feeds"))
def import_outlines(t):
    return jobs.import_outlines(t.feeds, outline_files(t), AS_OF).feeds


@query("p4_import_counts", f"""SELECT count(*) FILTER (WHERE url LIKE 'https://RSS%') AS added,
    count(*) FILTER (WHERE url NOT LIKE 'https://RSS%') AS skipped FROM ({NESTED})""")
def import_counts(t):
    return jobs.import_outlines(t.feeds, outline_files(t), AS_OF).counts


@query("p4_confirmed", NESTED)
def confirmed(t):
    return jobs.import_outlines(t.feeds, outline_files(t), AS_OF).confirmed


@query("p5_export", sql(OUTLINE, "feeds"))
def export_outline(t):
    return jobs.export_outline(t.feeds, "My & feeds")


# --- feed documents -----------------------------------------------------------------------------------------------------------


def fetched(t: Tables) -> DataFrame:
    """A feed document per row: Atom for French, else RSS with a second item without audio; German ones use a prefix of their own.

    A few are malformed: cut within a second item, with a bare ampersand and an entity of HTML, with one bad item, cut within the header.
    Others are well-formed in unusual ways: Atom under a prefix of its own, entities of HTML and of the document's own type, a prefix that is
    bound on each element, and CDATA that looks like a renamed element.
    """
    key = F.col("doc_id").cast("string")
    guid = F.md5(F.encode("text", "UTF-8"))
    spoilt = F.col("doc_id") % 50
    text = escape_xml("text")
    date = F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, n_chars % 400)")
    rss = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>'),
        F.when(spoilt == 13, F.lit('<!DOCTYPE rss [<!ENTITY co "Compa&#241;y"> <!ENTITY out SYSTEM "x">]>')).otherwise(F.lit("")),
        F.lit('<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>Feed '),
        F.when(spoilt == 17, F.lit("R&D &nbsp; ")).when(spoilt == 13, F.lit("Caf&eacute;&nbsp;&mdash; &co; ")).otherwise(F.lit("")), "source",
        F.lit("</title><link>https://example.com/"), "source", F.lit("</link><language>"), "lang", F.lit("</language>"),
        F.when(spoilt == 27, F.lit("<item><title>bad<b></title></item>")).otherwise(F.lit("")), F.lit("<item><title>Item "), key,
        F.lit('</title><guid isPermaLink="false">'), guid, F.lit("</guid><description>"),
        F.when(spoilt == 19, F.concat(F.lit("<![CDATA[<own:i xmlns:own='x'>&eacute;"), "text", F.lit("]]>"))).otherwise(text), F.lit("</description><pubDate>Tue, "),
        F.date_format(date, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><itunes:duration>0:"), F.col("n_chars").cast("string"),
        F.lit('</itunes:duration><enclosure url="image" type="image/png"/><enclosure url="https://media.example.com/'), key,
        F.lit('.mp3" type="audio/mpeg" length="1"/></item><item><title>No audio'),
        F.when(spoilt == 7, F.lit("")).otherwise(F.lit("</title><guid>g</guid></item></channel></rss>")),
    )
    own = F.replace(F.replace(rss, F.lit("xmlns:itunes"), F.lit("xmlns:own")), F.lit("itunes:duration"), F.lit("own:duration"))
    bound = F.replace(rss, F.lit("<itunes:duration>"), F.lit("<p:duration xmlns:p='HTTP://www.itunes.com/DTDs/Podcast-1.0.dtd'>"))
    bound = F.replace(F.replace(bound, F.lit("</itunes:duration>"), F.lit("</p:duration >")), F.lit("<title>Item"), F.lit("<title xmlns:p='urn:other'>Item"))
    rss = F.when(spoilt == 15, bound).when(F.col("lang") == "de", own).otherwise(rss)
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title type="text">Feed '), "source",
        F.lit('</title><link rel="self" href="self"/><link href="https://example.com/'), "source",
        F.lit('"/><entry><title>Item '), key, F.lit("</title><id>"), guid, F.lit('</id><summary type="text">'), text,
        F.lit("</summary><published>"), F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit('Z</published><link href="page"/><link rel="enclosure" type="audio/mpeg" href="https://media.example.com/'), key,
        F.lit('.mp3"/></entry>'), F.when(spoilt == 7, F.lit("<entry><title>x")).otherwise(F.lit("</feed>")),
    )
    prefixed = F.replace(F.regexp_replace(atom, "<(/?)(?=[a-z])", "<$1a:"), F.lit("xmlns="), F.lit("xmlns:a="))
    whole = F.when((F.col("lang") == "fr") & (spoilt == 11), prefixed).when(F.col("lang") == "fr", atom).otherwise(rss)
    xml = F.when(spoilt == 37, F.substring(whole, 1, 45)).otherwise(whole)
    return t.documents.select(
        F.col("doc_id").alias("payload_no"), F.concat(F.lit("https://feeds.example.com/"), key).alias("url"), xml.alias("xml"))


PARSED = """SELECT doc_id AS payload_no, 0 AS pos, 'Item ' || doc_id AS title,
    CASE WHEN doc_id % 50 = 19 AND lang <> 'fr' THEN '<own:i xmlns:own=''x''>&eacute;' || text ELSE text END AS description,
    'https://media.example.com/' || doc_id || '.mp3' AS audio_url, TIMESTAMP '2024-01-01' + to_days(CAST(n_chars % 400 AS INTEGER)) AS published_date,
    CASE WHEN lang <> 'fr' THEN CAST(n_chars AS INTEGER) END AS duration_seconds, md5(text) AS guid FROM documents WHERE doc_id % 50 <> 37"""


@query("s2_feed_items", PARSED)
def feed_items(t):
    items = payloads.episode_items(payloads.raw_items(payloads.parsed(fetched(t))))
    return items.select("payload_no", "pos", "title", "description", "audio_url", "published_date", "duration_seconds", "guid")


@query("s3_feed_headers", """SELECT doc_id AS payload_no, CASE WHEN doc_id % 50 = 37 THEN 'Unknown' WHEN doc_id % 50 = 17 AND lang <> 'fr'
        THEN 'Feed R&D ' || chr(160) || ' ' || source WHEN doc_id % 50 = 13 AND lang <> 'fr'
        THEN 'Feed Café' || chr(160) || '— Compañy ' || source ELSE 'Feed ' || source END AS title,
    CASE WHEN doc_id % 50 = 37 THEN '' ELSE 'https://example.com/' || source END AS link,
    CASE WHEN doc_id % 50 = 37 OR lang = 'fr' THEN '' ELSE lang END AS language, doc_id % 50 <> 37 AS has_items,
    doc_id % 50 IN (7, 37) OR (doc_id % 50 IN (17, 27) AND lang <> 'fr') AS malformed FROM documents""")
def feed_headers(t):
    return payloads.feed_headers(payloads.parsed(fetched(t))).select("payload_no", "title", "link", "language", "has_items", "malformed")


@query("x4_item_defaults", """SELECT doc_id AS payload_no, CASE lang WHEN 'en' THEN 'Untitled' ELSE '' END AS title, '' AS description,
    'https://media.example.com/' || doc_id AS guid, '' AS link FROM documents""")
def item_defaults(t):
    key = F.col("doc_id").cast("string")
    title = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.lit("<title></title>"))
    xml = F.concat(F.lit("<rss><channel><item>"), title, F.lit('<enclosure type="audio/ogg" url="https://media.example.com/'), key,
                   F.lit('"/></item></channel></rss>'))
    rows = t.given("documents").select(F.col("doc_id").alias("payload_no"), xml.alias("xml"))
    return payloads.episode_items(payloads.raw_items(payloads.parsed(rows))).select("payload_no", "title", "description", "guid", "link")


SYNCED = f"""SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY feed_id) AS id, feed_id, title, guid, published_date
    FROM (SELECT p.*, f.id AS feed_id, row_number() OVER (PARTITION BY guid ORDER BY f.id) AS rn FROM ({PARSED}) p
        JOIN feeds f ON f.url = 'https://feeds.example.com/' || p.payload_no
        WHERE f.enabled AND published_date >= TIMESTAMP '{SYNC_AS_OF}' - INTERVAL {SYNC_AGE} DAY)
    WHERE rn = 1 AND guid NOT IN (SELECT guid FROM known)"""


def synced(t: Tables) -> jobs.Sync:
    return jobs.sync_feeds(t.feeds, t.known, t.status, fetched(t), SYNC_AS_OF, SYNC_AGE)


@query("p1_sync", sql(SYNCED, "feeds", "known"))
def sync(t):
    return synced(t).inserted.select("id", "feed_id", "title", "guid", "published_date")


@query("p1_sync_episodes", sql(f"""SELECT id, feed_id, guid FROM known UNION ALL SELECT id, feed_id, guid FROM ({SYNCED})""", "feeds", "known"))
def sync_episodes(t):
    return synced(t).episodes.select("id", "feed_id", "guid")


@query("p1_sync_status", sql(f"""SELECT episode_id, status FROM status_rows UNION ALL SELECT id, 'pending' FROM ({SYNCED})""", "feeds", "known", "status_rows"))
def sync_status(t):
    return synced(t).status.select("episode_id", "status")


@query("p1_two_payloads", sql(f"""SELECT feed_id, guid, title, count(*) OVER () AS n FROM ({SYNCED})""", "feeds", "known"))
def two_payloads(t):
    """Every payload arrives twice; the second copy, under other titles, brings nothing new."""
    first = fetched(t)
    second = first.withColumn("payload_no", F.col("payload_no") + 10_000_000_000).withColumn("xml", F.replace("xml", F.lit("<title>Item "), F.lit("<title>Late ")))
    inserted = jobs.sync_feeds(t.feeds, t.known, t.status, first.unionByName(second), SYNC_AS_OF, SYNC_AGE, ids="hash").inserted
    return inserted.select("feed_id", "guid", "title").withColumn("n", F.lit(inserted.count()))


@query("p1_sync_totals", sql(f"SELECT feed_id, count(*) AS new_episodes FROM ({SYNCED}) GROUP BY ROLLUP (feed_id)", "feeds", "known"))
def sync_totals(t):
    return synced(t).totals


@query("p1_sync_feeds", sql(f"""SELECT id, enabled, CASE WHEN enabled THEN TIMESTAMP '{SYNC_AS_OF}' END AS last_checked FROM feeds""", "feeds"))
def sync_feeds(t):
    return synced(t).feeds.select("id", "enabled", "last_checked")


# --- digest -------------------------------------------------------------------------------------------------------------------


def _esc(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


# The frame of an HTML digest as it has to be, said here on its own so that a wrong frame in the library shows.
FRAME_HEAD = """<!DOCTYPE html>
<html>
<head><meta charset="UTF-8"></head>
<body>"""
FRAME_FOOT = """<footer>This is an automated weekly digest.</footer>
</body>
</html>"""

NUMBERED = f"""WITH base AS ({DIGEST_BASE}), numbered AS (SELECT b.*, row_number() OVER (ORDER BY completed_at DESC, b.id) - 1 AS position,
    d.doc_id, d.text AS body, d.source, d.lang FROM base b LEFT JOIN documents d ON b.id = d.doc_id),
    heading AS (SELECT count(*) AS n, strftime(min(completed_at), '%B %d') || ' - ' || strftime(max(completed_at), '%B %d, %Y') AS days,
        count(*) || ' episodes processed this week' AS counted FROM base)"""


def _html_sql(full: bool) -> str:
    quote = f"""'<figure><blockquote>' || k || ' ' || {_esc('body')} || '</blockquote><figcaption>' || CASE WHEN lang = 'en' THEN source ELSE 'Unknown' END
        || '</figcaption></figure>'"""
    theses = """'<section>
<h4>💡 Investment Theses</h4>
<dl>
<dt>a &lt; b &amp; c ' || doc_id || '</dt><dd>' || lang || '</dd>
</dl>
</section>
' ||""" if full else ""
    return f"""{NUMBERED}
    SELECT 0 AS part, CAST(0 AS BIGINT) AS position, '{FRAME_HEAD}' AS text
    UNION ALL SELECT 1, 0, '<header>
<h1>🎧 Your Weekly Podcast Digest</h1>
<p>' || days || '<br>' || counted || '</p>
</header>' FROM heading
    UNION ALL SELECT 2, 0, '<nav>
<h2>This Week''s Episodes</h2>
<ol>'
    UNION ALL SELECT 3, position, '<li>' || CASE WHEN doc_id IS NULL THEN title ELSE '<a href="#item-' || position || '">' || title || '</a>' END
        || ' <em>' || feed_name || '</em></li>' FROM numbered
    UNION ALL SELECT 4, 0, '</ol>
</nav>'
    UNION ALL SELECT 5, position, '<article id="item-' || position || '">
<h3>' || title || '</h3>
<p>' || feed_name || ', <time>' || strftime(published_date, '%B %d, %Y') || '</time></p>
<section>
<h4>🎙️ Host and Guest</h4>
<p>' || source || '</p>
</section>
<section>
<h4>📝 Summary</h4>
<p>' || {_esc('body')} || '</p>
</section>
<section>
<h4>💬 Top Quotes</h4>
' || (SELECT string_agg({quote}, chr(10) ORDER BY k) FROM range(1, 4) r(k)) || '
</section>
' || {theses} '<section>
<h4>🔑 Key Topics</h4>
<dl>
' || (SELECT string_agg('<dt>' || lang || k || '</dt><dd>' || source || '</dd>', chr(10) ORDER BY k) FROM range(1, 6) r(k)) || '
</dl>
</section>
<section>
<h4>🏢 Companies Mentioned</h4>
<dl>
' || (SELECT string_agg('<dt>Firm ' || k || ' (' || CASE WHEN lang = 'fr' THEN 'N/A' ELSE lang END || ')</dt><dd>' || source || '</dd>',
        chr(10) ORDER BY k) FROM range(1, 6) r(k)) || '
</dl>
</section>
</article>' FROM numbered WHERE doc_id IS NOT NULL
    UNION ALL SELECT 6, 0, '{FRAME_FOOT}'"""


@query("x13_empty_digest", f"""SELECT * FROM (VALUES (0, '{FRAME_HEAD}'), (1, '<header>
<h1>🎧 Your Weekly Podcast Digest</h1>
<p>No episodes processed this week</p>
</header>
<p>No podcast episodes were processed in the last 7 days. Check your feeds or processing status.</p>'), (6, '{FRAME_FOOT}')) d(part, text)""")
def empty_html_digest(t):
    # No item was completed in the seven days before this date.
    return jobs.weekly_digest(t.episodes, t.feeds, t.status, t.summaries, "2031-01-01 00:00:00", 7).html.select("part", "text")


@query("x14_empty_digest", "SELECT 0 AS part, 'No podcast episodes were processed this week.' AS text")
def empty_text_digest(t):
    return jobs.weekly_digest(t.episodes, t.feeds, t.status, t.summaries, "2031-01-01 00:00:00", 7).text.select("part", "text")


@query("x13_html_digest", sql(_html_sql(True), "episodes", "feeds", "status_rows"))
def html_digest(t):
    return digests.html_digest(digests.positioned(digest_base_of(t)), t.summaries, full=True)


TEXT_DIGEST = NUMBERED + """
    SELECT 0 AS part, CAST(0 AS BIGINT) AS position, 'YOUR WEEKLY PODCAST DIGEST
' || repeat('=', 50) || '

' || counted || '
' AS text FROM heading
    UNION ALL SELECT 1, position, '
' || (position + 1) || '. ' || title || '
   ' || feed_name || '
' || repeat('-', 50) || '

' || body || '

Top Quotes:
' || (SELECT string_agg('  "' || k || ' ' || body || '" - ' || CASE WHEN lang = 'en' THEN source ELSE 'Unknown' END, chr(10) ORDER BY k)
    FROM range(1, 3) r(k)) || '
' FROM numbered WHERE doc_id IS NOT NULL
    UNION ALL SELECT 2, 0, '
' || repeat('=', 50) || '
Generated by feedlake'"""


@query("x14_text_digest", sql(TEXT_DIGEST, "episodes", "feeds", "status_rows"))
def text_digest(t):
    return digests.text_digest(digests.positioned(digest_base_of(t)), t.summaries)


def weekly(t: Tables) -> jobs.Digest:
    return jobs.weekly_digest(t.episodes, t.feeds, t.status, t.summaries, AS_OF, DAYS)


@query("p3_weekly_html", sql(_html_sql(False), "episodes", "feeds", "status_rows"))
def weekly_html(t):
    return weekly(t).html


@query("p3_weekly_text", sql(TEXT_DIGEST, "episodes", "feeds", "status_rows"))
def weekly_text(t):
    return weekly(t).text


@query("k6_digest_document", sql(f"""SELECT unnest(string_split(text, chr(10))) AS line FROM ({TEXT_DIGEST})""", "episodes", "feeds", "status_rows"))
def digest_document(t):
    folder = fresh_dir(t.spark, "digest")
    documents.write_document(text_digest(t), folder)
    return t.spark.read.text(folder).select(F.col("value").alias("line"))


# --- processing ---------------------------------------------------------------------------------------------------------------


class Editor:
    """Cleaning model: marks letters, gives up on tables."""

    def __call__(self, prompt: str) -> str:
        text = prompt.split("\n\n", 1)[1]
        if "|" in text:
            raise ValueError("a table")
        return text.replace("e", "E")


class Analyst:
    """Summary model: answers in JSON, but not about texts with digits."""

    def __call__(self, prompt: str) -> str:
        text = prompt.split("\n\n", 1)[1]
        if any(d in text for d in "0123456789"):
            return "I cannot say."
        return "```json\n" + json.dumps({"comprehensive_summary": text, "key_topics": [{"topic": "length"}]}) + "\n```"


def waiting_items(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("episode_id"), F.lit("pending").alias("status"),
        *[F.lit(None).cast("string").alias(c) for c in (*state.STATUS_PATHS, "error_message")],
        *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("started_at", "completed_at", "updated_at")])


def processed(t: Tables) -> jobs.Processing:
    docs = t.documents
    queue = docs.select(F.col("doc_id").alias("id"))
    media = docs.filter("doc_id % 20 <> 9").select(F.col("doc_id").alias("episode_id"), F.concat(F.lit("audio/"), F.col("doc_id").cast("string")).alias("audio_path"))
    nothing = t.spark.createDataFrame([], TABLES["transcripts"]), t.spark.createDataFrame([], TABLES["summaries"])
    return jobs.process_items(queue, media, replies(t), Editor, Analyst, AS_OF, waiting_items(t), *nothing, chunk_size=CHUNK)


FAILED_AT = "CASE WHEN doc_id % 20 = 9 THEN 0 WHEN doc_id % 20 = 3 THEN 1 WHEN regexp_matches(text, '[0-9]') THEN 3 ELSE 4 END"
CLEANED = CHUNKS + """, cleaned AS (SELECT episode_id, string_agg(CASE WHEN contains(chunk, '|') THEN chunk ELSE replace(chunk, 'e', 'E') END,
    chr(10) || chr(10) ORDER BY chunk_no) AS cleaned_text FROM chunks GROUP BY episode_id)"""


@query("p2_status", f"""SELECT doc_id AS episode_id, CASE f WHEN 4 THEN 'completed' ELSE 'failed' END AS status,
    CASE f WHEN 0 THEN 'Audio download failed' WHEN 1 THEN 'Transcription failed' WHEN 3 THEN 'Summarization failed' END AS error_message,
    CASE WHEN f > 0 THEN 'audio/' || doc_id END AS audio_path, CASE WHEN f > 1 THEN 'transcripts/' || doc_id || '_cleaned.txt' END AS cleaned_transcript_path,
    CASE WHEN f = 4 THEN 'summaries/' || doc_id || '_summary.md' END AS summary_path, CASE WHEN f = 4 THEN {NOW} END AS completed_at
    FROM (SELECT doc_id, {FAILED_AT} AS f FROM documents)""")
def process_status(t):
    return processed(t).status.select("episode_id", "status", "error_message", "audio_path", "cleaned_transcript_path", "summary_path", "completed_at")


@query("p2_kept", f"""{CLEANED} SELECT doc_id AS episode_id, CASE f WHEN 4 THEN 'completed' ELSE 'failed' END AS status,
    CASE f WHEN 0 THEN 'Audio download failed' WHEN 1 THEN 'Transcription failed' WHEN 3 THEN 'Summarization failed' END AS error_message,
    CASE WHEN f > 1 THEN md5(text) END AS raw_digest, CASE WHEN f > 1 THEN md5(cleaned_text) END AS cleaned_digest
    FROM (SELECT doc_id, text, {FAILED_AT} AS f FROM documents) d LEFT JOIN cleaned c ON c.episode_id = d.doc_id""")
def kept_processing(t):
    """The results in tables that are merged on read; the batch is given twice, as by a job that is repeated."""
    status = KeyedTable(t.spark, fresh_dir(t.spark, "status"), TABLES["processing_status"], "episode_id")
    status.create(waiting_items(t))
    transcripts = KeyedTable(t.spark, fresh_dir(t.spark, "transcripts"), TABLES["transcripts"], "episode_id")
    done = processed(t)
    for _ in range(2):
        jobs.keep_processing(done, status, transcripts, AS_OF, 1)
    digest = lambda c: F.md5(F.encode(c, "UTF-8"))
    texts = transcripts.read().select("episode_id", digest("raw_text").alias("raw_digest"), digest("cleaned_text").alias("cleaned_digest"))
    return status.read().select("episode_id", "status", "error_message").join(texts, "episode_id", "left")


@query("p2_transcripts", f"""{CLEANED} SELECT doc_id AS episode_id, text AS raw_text, cleaned_text, 'cleaner' AS cleaning_model FROM documents d
    JOIN cleaned c ON c.episode_id = d.doc_id WHERE {FAILED_AT} > 1""")
def process_transcripts(t):
    return processed(t).transcripts.select("episode_id", "raw_text", "cleaned_text", "cleaning_model")


@query("p2_summaries", f"""{CLEANED} SELECT doc_id AS episode_id, cleaned_text AS comprehensive_summary,
    '[{{"topic":"length","description":null}}]' AS key_topics, '[]' AS company_mentions FROM documents d
    JOIN cleaned c ON c.episode_id = d.doc_id WHERE {FAILED_AT} = 4""")
def process_summaries(t):
    return processed(t).summaries.select("episode_id", "comprehensive_summary", "key_topics", "company_mentions")


@query("p2_logs", f"""{CLEANED}, items AS (SELECT doc_id AS episode_id, {FAILED_AT} AS f, length(text) AS raw, length(cleaned_text) AS clean
        FROM documents d JOIN cleaned c ON c.episode_id = d.doc_id),
    stages AS (SELECT * FROM (VALUES (0, 'download', 'Download failed'), (1, 'transcribe', 'Transcription failed'), (2, 'clean', ''),
        (3, 'summarize', 'Summarization failed')) s(i, stage, failure))
    SELECT episode_id, stage, 'started' AS status, CAST(NULL AS VARCHAR) AS message FROM items, stages WHERE f >= i
    UNION ALL SELECT episode_id, stage, CASE WHEN f > i THEN 'success' ELSE 'error' END, CASE WHEN f = i THEN failure
        WHEN i = 0 THEN 'Downloaded to audio/' || episode_id WHEN i = 1 THEN 'Transcribed ' || raw || ' characters'
        WHEN i = 2 THEN 'Cleaned ' || clean || ' characters' ELSE 'Summary saved to summaries/' || episode_id || '_summary.md' END
    FROM items, stages WHERE f >= i""")
def process_logs(t):
    return processed(t).logs.select("episode_id", "stage", "status", "message")


@query("p2_outcomes", f"""SELECT CASE WHEN {FAILED_AT} = 4 THEN 'success' ELSE 'failed' END AS outcome, count(*) AS n FROM documents GROUP BY 1""")
def process_outcomes(t):
    return processed(t).outcomes


# --- files --------------------------------------------------------------------------------------------------------------------


def item_packs(t: Tables) -> str:
    """The raw transcripts of all items as packed files ``{id}_raw.txt``."""
    folder = fresh_dir(t.spark, "texts")
    rows = documents.transcript_rows(t.transcripts).filter("kind = 'raw'").select("episode_id", "file_name", "text")
    write_packs(spread(rows, "episode_id", t.partitions), folder, "file_name", "text")
    return folder


def packed_sizes(t: Tables) -> DataFrame:
    found = packs.packed_inventory(t.spark, item_packs(t))
    return found.select(F.regexp_extract("file_name", r"^([0-9]+)_raw\.txt$", 1).try_cast("bigint").alias("episode_id"), F.col("length").alias("size"))


@query("s4_all_transcript_files", "SELECT doc_id AS episode_id, 'raw' AS kind, text FROM documents")
def all_transcript_files(t):
    return packs.read_transcript_packs(t.spark, item_packs(t))


@query("s4_transcript_files", "SELECT doc_id AS episode_id, 'raw' AS kind, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM documents")
def transcript_files(t):
    """What the packed files hold, without their texts."""
    text = F.col("text")
    return packs.read_transcript_packs(t.spark, item_packs(t)).select("episode_id", "kind", F.length(text).alias("n_chars"), F.md5(F.encode(text, "UTF-8")).alias("digest"))


@query("s4_stored_transcripts", sql("SELECT episode_id, 'raw' AS kind, episode_id || '_raw.txt' AS file_name, raw_text AS text FROM transcripts", "transcripts"))
def stored_transcripts(t):
    """All transcripts through the table form of the sink, which keeps the file's name as a column."""
    folder = fresh_dir(t.spark, "transcripts")
    documents.transcript_rows(t.transcripts).write.partitionBy("kind").parquet(folder)
    return t.spark.read.parquet(folder).filter("kind = 'raw'").select("episode_id", "kind", "file_name", "text")


@query("s5_all_file_inventory", "SELECT doc_id AS episode_id, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def all_file_inventory(t):
    return packed_sizes(t)


@query("s5_file_inventory", """SELECT doc_id AS episode_id, doc_id || '_raw.txt' AS file_name, CAST(strlen(text) AS BIGINT) AS size, CAST(0 AS BIGINT) AS gap FROM documents""")
def file_inventory(t):
    """Every file with its size, and how far it lies from the end of the file before it in its pack: contents lie one behind another."""
    found = packs.packed_inventory(t.spark, item_packs(t))
    before = F.lag(F.col("offset") + F.col("length"), 1, 0).over(Window.partitionBy("path").orderBy("offset", "length"))
    number = F.regexp_extract("file_name", r"^([0-9]+)_raw\.txt$", 1).try_cast("bigint")
    return found.select(number.alias("episode_id"), "file_name", F.col("length").alias("size"), (F.col("offset") - before).alias("gap"))


@query("s5_located_media", sql("""SELECT id AS episode_id, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'm/' || id || '.mp3' WHEN 2 THEN 'm/' || id || '.m4a'
    ELSE 'm/' || id || '.mp3' END AS path, CASE WHEN id % 4 > 0 THEN id END AS size FROM episodes""", "episodes"))
def located_media(t):
    """Expected files against an inventory: missing, as expected, with another ending, with several endings."""
    key = F.col("id").cast("string")
    expected = t.episodes.select(F.col("id").alias("episode_id"), F.concat(key, F.lit(".mp3")).alias("file_name"))
    endings = F.expr("CASE id % 4 WHEN 0 THEN array('.wav') WHEN 1 THEN array('.mp3') WHEN 2 THEN array('.opus', '.m4a') ELSE array('.webm', '.mp3', '.m4a') END")
    present = t.episodes.select("id", F.explode(endings).alias("e")).select(
        F.concat(F.col("id").cast("string"), "e").alias("file_name"), F.concat(F.lit("m/"), F.col("id").cast("string"), "e").alias("path"), F.col("id").alias("length"))
    return files.located_media(expected, present).select("episode_id", "path", "size")


# --- logs and streams ---------------------------------------------------------------------------------------------------------

LOG_ROWS = sql('SELECT id, episode_id, stage, status, message, "timestamp" FROM logs', "logs")


@query("k5_log_append", LOG_ROWS)
def log_append(t):
    folder = fresh_dir(t.spark, "logs")
    table_sinks.append_log(t.logs.filter("stage = 'process'"), folder)
    table_sinks.append_log(t.logs.filter("stage <> 'process'"), folder)
    return table_sources.read_table(t.spark, "processing_logs", folder)


@query("s7_log_stream", LOG_ROWS)
def log_stream(t):
    folder, out = fresh_dir(t.spark, "logs"), fresh_dir(t.spark, "stream")
    table_sinks.append_log(t.logs, folder)
    stream = table_sources.stream_table(t.spark, "processing_logs", folder)
    streams.write_batches(stream, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/rows").drop("batch_id")


@query("st1_sync_stream", sql(f"SELECT feed_id, title, guid, published_date FROM ({SYNCED.replace(' AND guid NOT IN (SELECT guid FROM known)', '')})",
                              "feeds", "known"))
def sync_stream(t):
    folder, out = fresh_dir(t.spark, "fetched"), fresh_dir(t.spark, "sync")
    fetched(t).write.parquet(folder)
    arriving = t.spark.readStream.schema("payload_no BIGINT, url STRING, xml STRING").parquet(folder)
    streams.sync_stream(arriving, t.feeds, f"{out}/episodes", f"{out}/checkpoint", SYNC_AS_OF, SYNC_AGE).awaitTermination()
    return streams.stored_episodes(t.spark, f"{out}/episodes").select("feed_id", "title", "guid", "published_date")


@query("st1_sync_batches", sql(f"SELECT guid FROM ({SYNCED.replace(' AND guid NOT IN (SELECT guid FROM known)', '')})", "feeds", "known"))
def sync_batches(t):
    """Several files, taken up in several batches: the later ones meet what the earlier ones stored, so each guid is stored once."""
    folder, out = fresh_dir(t.spark, "fetched"), fresh_dir(t.spark, "sync")
    spread(fetched(t), "payload_no", 4).write.parquet(folder)
    arriving = t.spark.readStream.schema("payload_no BIGINT, url STRING, xml STRING").option("maxFilesPerTrigger", 2).parquet(folder)
    streams.sync_stream(arriving, t.feeds, f"{out}/episodes", f"{out}/checkpoint", SYNC_AS_OF, SYNC_AGE).awaitTermination()
    return streams.stored_episodes(t.spark, f"{out}/episodes").select("guid")


@query("st1_growing_history", sql(f"SELECT guid, true AS grew FROM ({SYNCED.replace(' AND guid NOT IN (SELECT guid FROM known)', '')})", "feeds", "known"))
def growing_history(t):
    """Many small batches: the history's buckets double as it grows, and each guid is stored once."""
    folder, out = fresh_dir(t.spark, "fetched"), fresh_dir(t.spark, "sync")
    payload_rows = fetched(t)
    spread(payload_rows, "payload_no", 8).write.parquet(folder)
    per_bucket = 1 + t.given("documents").count() // 1000
    arriving = t.spark.readStream.schema("payload_no BIGINT, url STRING, xml STRING").option("maxFilesPerTrigger", 1).parquet(folder)
    streams.sync_stream(arriving, t.feeds, f"{out}/episodes", f"{out}/checkpoint", SYNC_AS_OF, SYNC_AGE, rows_per_bucket=per_bucket).awaitTermination()
    history = streams.episode_table(t.spark, f"{out}/episodes", per_bucket)
    buckets = {v.name: v.buckets for v in history.versions(live=False)}
    return history.read().select("guid", F.lit(max(buckets.values()) >= 2 * buckets["v1"]).alias("grew"))


@query("st2_without_repeats", "SELECT DISTINCT md5(text) AS guid FROM documents")
def without_repeats(t):
    out = fresh_dir(t.spark, "distinct")
    arriving = t.stream("documents").select(
        F.md5(F.encode("text", "UTF-8")).alias("guid"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, n_chars % 400)").alias("published_date"))
    streams.write_batches(streams.without_repeats(arriving), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/rows").select("guid")


@query("st3_live_status", sql("""SELECT episode_id, last(stage ORDER BY "timestamp", id) AS stage, last(status ORDER BY "timestamp", id) AS status,
    max("timestamp") AS at_time FROM logs GROUP BY episode_id""", "logs"))
def live_status(t):
    out = fresh_dir(t.spark, "status")
    arriving = streams.live_status(logs_of_events(t.stream("events")))
    streams.write_batches(arriving, f"{out}/rows", f"{out}/checkpoint", mode="update").awaitTermination()
    now = streams.newest_batch(t.spark.read.parquet(f"{out}/rows"), "episode_id")
    return now.select("episode_id", "stage", "status", F.col("at").alias("at_time"))


STEPS = """WITH RECURSIVE reported AS (SELECT episode_id, id, epoch_us("timestamp") AS us, CASE WHEN status = 'error' THEN 'failed'
        WHEN stage = 'summarize' AND status = 'success' THEN 'completed' WHEN status = 'started' THEN
        CASE stage WHEN 'download' THEN 'downloading' WHEN 'transcribe' THEN 'transcribing' WHEN 'clean' THEN 'cleaning' WHEN 'summarize' THEN 'summarizing' END END AS state FROM logs),
    passed AS (SELECT (max(us) // 1000 - 7200000) * 1000 AS mark FROM reported WHERE state IS NOT NULL),
    placed AS (SELECT *, list_position(['pending', 'downloading', 'transcribing', 'cleaning', 'summarizing', 'completed', 'failed'], state) AS r,
        row_number() OVER (PARTITION BY episode_id ORDER BY us, id) AS n FROM reported, passed WHERE state IS NOT NULL AND us <= mark),
    run AS (SELECT episode_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS us, '' AS state, false AS ok, 1 AS now FROM (SELECT DISTINCT episode_id FROM placed)
        UNION ALL SELECT episode_id, n, id, us, state, ok, CASE WHEN ok THEN r ELSE was END FROM (SELECT p.*, q.now AS was, CASE WHEN q.now = 6 THEN false WHEN p.r = 7 THEN q.now <> 7
            WHEN q.now = 7 THEN p.r = 2 ELSE p.r = q.now + 1 END AS ok FROM run q JOIN placed p ON p.episode_id = q.episode_id AND p.n = q.n + 1)),
    followed AS (SELECT *, lead(us) OVER (PARTITION BY episode_id ORDER BY n) AS next FROM run WHERE n > 0)
    SELECT episode_id, id, state, CASE WHEN ok THEN 'step' ELSE 'illegal' END AS kind, make_timestamp(us) AS at_time FROM run WHERE n > 0
    UNION ALL SELECT episode_id, id, ['', 'downloading', 'transcribing', 'cleaning', 'summarizing'][now], 'stale', make_timestamp(us + 43200000000) FROM followed, passed
    WHERE now BETWEEN 2 AND 5 AND (next > us + 43200000000 OR (next IS NULL AND us + 43200000000 <= mark))"""


def late_logs(t: Tables) -> DataFrame:
    """The log as a stream of four parts, every second row up to an hour late. A part is taken up at once, so all have the same number of files: one
    per task, or a single one if the table has too few rows for that."""
    folder, logs = fresh_dir(t.spark, "logs"), t.logs
    micros = F.unix_micros(utc_instant("timestamp")) + (F.col("id") % 2) * 3_600_000_000
    low, high = logs.agg(F.min(micros), F.max(micros)).first()
    part = F.floor(4 * (micros - low) / (high - low + 1))
    file = F.pmod(F.xxhash64("id"), F.lit(t.partitions)).cast("int")
    files = t.partitions if logs.select(part, file).distinct().count() == 4 * t.partitions else 1
    for i in range(4):
        logs.filter(part == i).repartitionById(files, F.pmod(file, F.lit(files))).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(TABLES["processing_logs"]).option("maxFilesPerTrigger", files).parquet(folder)


@query("st3_item_steps", sql(STEPS, "logs"))
def item_steps(t):
    """Legal steps, illegal rows, and items that stand still."""
    out = fresh_dir(t.spark, "steps")
    steps = streams.item_steps(late_logs(t), delay="2 hours", stale_after="12 hours")
    streams.write_batches(steps, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/rows").select("episode_id", "id", "state", "kind", F.col("at").alias("at_time"))


@query("w5_stage_runs_stream", sql("""WITH timed AS (SELECT *, epoch_us("timestamp") AS us FROM logs), passed AS (SELECT (max(us) // 1000 - 7200000) * 1000 AS mark FROM timed),
    followed AS (SELECT *, lead(status) OVER w AS next_status, lead(us) OVER w AS next_us FROM timed, passed WHERE us <= mark WINDOW w AS (PARTITION BY episode_id, stage ORDER BY us, id)),
    runs AS (SELECT *, next_status IN ('success', 'error') AND next_us <= us + 259200000000 AS ended FROM followed
        WHERE status = 'started' AND (next_us IS NOT NULL OR us + 259200000000 <= mark))
    SELECT id, episode_id, stage, "timestamp" AS started_at, CASE WHEN ended THEN next_status END AS result, CASE WHEN ended THEN make_timestamp(next_us) END AS finished_at,
        CASE WHEN ended THEN CAST((next_us - us) // 1000000 AS BIGINT) END AS seconds FROM runs""", "logs"))
def stage_runs_stream(t):
    out = fresh_dir(t.spark, "runs")
    runs = streams.stage_runs(late_logs(t), delay="2 hours", longest="3 days")
    streams.write_batches(runs, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/rows").drop("batch_id")


@query("st4_weekly_completions", sql("""WITH done AS (SELECT e.feed_id, s.completed_at, TIMESTAMP '1970-01-01' + to_days(CAST(
        CAST(epoch(s.completed_at) AS BIGINT) // 604800 * 7 AS INTEGER)) AS week_start FROM episodes e JOIN status_rows s ON e.id = s.episode_id WHERE s.status = 'completed')
    SELECT week_start, feed_id, count(*) AS n FROM done
    WHERE week_start + INTERVAL 7 DAY <= (SELECT max(completed_at) FROM done) - INTERVAL 1 DAY GROUP BY week_start, feed_id""",
                                     "episodes", "status_rows"))
def weekly_completions(t):
    out = fresh_dir(t.spark, "weeks")
    finished = t.stream("orders").select(
        F.col("o_custkey").alias("feed_id"), F.expr("if(o_orderstatus = 'O', 'completed', 'pending')").alias("status"),
        F.expr("o_orderdate + INTERVAL 1 DAY").alias("completed_at"))
    streams.write_batches(streams.weekly_completions(finished), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/rows").drop("batch_id")
