"""Fetched feed documents (RSS and Atom) as tables of feeds and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import feeds as ff
from ..functions.basic import let
from .names import with_usual_names

_LINKS = "ARRAY<STRUCT<_VALUE: STRING, _href: STRING, _rel: STRING, _type: STRING>>"
_ITEM = (
    "STRUCT<title: STRING, guid: STRING, id: STRING, description: STRING, summary: STRING, `itunes:summary`: STRING, "
    "`content:encoded`: STRING, content: STRING, pubDate: STRING, published: STRING, `dc:date`: STRING, "
    f"`itunes:duration`: STRING, link: {_LINKS}, `atom:link`: {_LINKS}, "
    "enclosure: ARRAY<STRUCT<_url: STRING, _type: STRING>>>"
)
# One schema reads both formats in one pass: RSS has a channel, Atom has its fields at the top.
_DOCUMENT = (
    f"STRUCT<channel: STRUCT<title: STRING, description: STRING, language: STRING, link: {_LINKS}, item: ARRAY<{_ITEM}>>, "
    f"item: ARRAY<{_ITEM}>, title: STRING, subtitle: STRING, link: {_LINKS}, entry: ARRAY<{_ITEM}>, "
    "_corrupt_record: STRING>"
)


_BLOCKS = r"(?s)<(item|entry)(?=[\s>])[^>]*>.*?</\1\s*>"
# Characters that no XML document may hold, and ampersands that start none of the five known entities or a number.
_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
_BARE_AMPERSAND = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});)"


def _repaired(xml: Column) -> Column:
    """The document up to its first item, its complete items that can be read, and the end tags it needs."""

    def whole(text: Column) -> Column:
        blocks = F.filter(F.regexp_extract_all(text, F.lit(_BLOCKS), F.lit(0)), lambda b: F.from_xml(b, _DOCUMENT)["_corrupt_record"].isNull())
        head = F.get(F.split(text, r"<(item|entry)(?=[\s>])", 2), F.lit(0))
        root = F.regexp_extract(head, r"<(rss|feed|rdf:RDF)(?=[\s>])", 1)
        channel = F.when(F.rlike(head, F.lit(r"<channel[\s>]")) & ~F.contains(head, F.lit("</channel>")), F.lit("</channel>")).otherwise(F.lit(""))
        return F.concat(head, F.array_join(blocks, ""), channel, F.lit("</"), root, F.lit(">"))

    return let(F.regexp_replace(F.regexp_replace(xml, _CONTROLS, ""), _BARE_AMPERSAND, "&amp;"), whole)


def parsed(payloads: DataFrame, xml: str = "xml") -> DataFrame:
    """Add ``document``.

    Elements are read by their namespace, whatever their prefix, and named entities are characters (``sources.names``). A malformed payload does not end the job. It is repaired as far as its header and its complete items allow, so that only what is broken
    is lost; if even its header cannot be read, the document has no title and no items.
    """

    def read(text: Column) -> Column:
        return let(F.from_xml(text, _DOCUMENT), lambda d: F.when(
            d["_corrupt_record"].isNull(), d).otherwise(let(F.from_xml(_repaired(text), _DOCUMENT), lambda r: r.withField("_corrupt_record", text))))

    named = payloads.withColumn(xml, with_usual_names(F.col(xml)))
    return named.withColumn("document", read(F.col(xml))).drop(xml)


def _page(links: Column) -> Column:
    """Address of the page behind a link list: the text of an RSS link, or the alternate link of Atom."""
    pages = F.filter(links, lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    first = F.get(pages, F.lit(0))
    return F.coalesce(first["_VALUE"], first["_href"])


def feed_headers(documents: DataFrame) -> DataFrame:
    d = F.col("document")
    return documents.select(
        *[c for c in documents.columns if c != "document"],
        F.coalesce(d["channel"]["title"], d["title"], F.lit("Unknown")).alias("title"),
        F.coalesce(d["channel"]["description"], d["subtitle"], F.lit("")).alias("description"),
        F.coalesce(_page(d["channel"]["link"]), _page(d["link"]), F.lit("")).alias("link"),
        F.coalesce(d["channel"]["language"], F.lit("")).alias("language"),
        F.coalesce(F.size(_items(d)) > 0, F.lit(False)).alias("has_items"),
        # A document without any element of a feed is none, even if it is well-formed.
        (d.isNull() | d["_corrupt_record"].isNotNull() | F.coalesce(
            d["channel"]["title"], d["channel"]["description"], d["title"], d["subtitle"],
            F.when(_items(d).isNotNull() | d["channel"].isNotNull() | d["link"].isNotNull(), F.lit(""))).isNull()).alias("malformed"),
    )


def _items(d: Column) -> Column:
    return F.coalesce(d["channel"]["item"], d["item"], d["entry"])


def _targets(links: Column) -> Column:
    return F.transform(links, lambda k: F.struct(k["_type"].alias("type"), k["_href"].alias("href")))


def raw_items(documents: DataFrame) -> DataFrame:
    """One row per item, ``pos`` from 0, with the fields that item rules read."""
    carried = [c for c in documents.columns if c != "document"]
    # The outer form with a filter above it: the inner form would parse every document a second time to find those with items.
    exploded = documents.select(*carried, F.posexplode_outer(_items(F.col("document"))).alias("pos", "i")).filter("i IS NOT NULL")
    i = F.col("i")
    none = F.array().cast("ARRAY<STRUCT<type: STRING, href: STRING>>")
    attached = F.transform(i["enclosure"], lambda e: F.struct(e["_type"].alias("type"), e["_url"].alias("href")))
    linked = F.concat(F.coalesce(_targets(i["link"]), none), F.coalesce(_targets(i["atom:link"]), none))
    marked = F.filter(i["link"], lambda k: k["_rel"] == "enclosure")
    return exploded.select(
        *carried, "pos", i["title"].alias("title"),
        F.coalesce(i["description"], i["summary"], i["itunes:summary"], i["content:encoded"], i["content"]).alias("summary"),
        F.coalesce(i["guid"], i["id"]).alias("id"),
        F.coalesce(i["pubDate"], i["published"], i["dc:date"]).alias("published"),
        i["itunes:duration"].alias("itunes_duration"),
        F.concat(F.coalesce(attached, none), F.coalesce(_targets(marked), none)).alias("enclosures"),
        linked.alias("links"),
        _page(i["link"]).alias("link"),
    )


def episode_items(items: DataFrame) -> DataFrame:
    """Items with audio, in the columns of the episodes table plus ``pos`` and ``link``.

    Defaults replace absent fields only; an empty field stays empty.
    """
    fields = ("title", "summary", "id", "published", "itunes_duration", "enclosures", "links", "link", "pos")
    carried = [c for c in items.columns if c not in fields]
    found = items.withColumn("audio_url", ff.audio_url("enclosures", "links"))
    return found.filter(F.col("audio_url").isNotNull() & (F.col("audio_url") != "")).select(
        *carried, "pos",
        F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.coalesce("summary", F.lit("")).alias("description"),
        "audio_url",
        ff.published_date("published").alias("published_date"),
        ff.duration_seconds("itunes_duration").alias("duration_seconds"),
        F.coalesce("id", "audio_url").alias("guid"),
        F.coalesce("link", F.lit("")).alias("link"),
    )
