"""Feed lists in outline files."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import feeds as ff
from ..functions.basic import non_empty, strip

_ROWS = "file STRING, pos INT, text STRING, title STRING, type STRING, url STRING, html_url STRING, description STRING, " \
        "category STRING, error STRING"
_ROWS_PER_FRAME = 10_000
# column -> attribute of an outline element
_ATTRIBUTES = {"text": "text", "title": "title", "type": "type", "url": "xmlUrl", "html_url": "htmlUrl",
               "description": "description", "category": "category"}


def _feed_elements(document: bytes) -> Iterator[ElementTree.Element]:
    """Outlines with an address, in document order; what lies below such an outline is not visited."""
    body = ElementTree.fromstring(document).find("body")
    if body is None:
        raise ValueError("no body element")
    waiting = list(reversed(body.findall("outline")))
    while waiting:
        outline = waiting.pop()
        if outline.get("xmlUrl"):
            yield outline
        else:
            waiting.extend(reversed(outline.findall("outline")))


def _rows(file: str, document) -> list[dict]:
    try:
        if document is None:
            raise ValueError("no content")
        found = [{c: e.get(a) for c, a in _ATTRIBUTES.items()} for e in _feed_elements(bytes(document))]
    except Exception as e:  # whatever is wrong with one document, such as an unknown encoding, must not end the job
        found = [{"error": f"{type(e).__name__}: {e}"}]
    return [{"file": file, "pos": pos, **row} for pos, row in enumerate(found)]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file", "pos", *_ATTRIBUTES, "error"]
    rows: list[dict] = []
    for batch in batches:
        for file, document in zip(batch["file"], batch["content"]):
            rows += _rows(file, document)
            if len(rows) >= _ROWS_PER_FRAME:
                yield pd.DataFrame(rows, columns=columns, dtype=object)
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns, dtype=object)


def outline_rows(documents: DataFrame) -> DataFrame:
    """All feed outlines of documents ``(file, content)``, plus one row with ``error`` per document that cannot be read.

    The only scan that needs Python: the built-in XML path functions end the whole job on a malformed document.
    """
    whole = documents.select("file", F.col("content").cast("binary").alias("content"))
    return whole.mapInPandas(_read, _ROWS)


def read_outline_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return outline_rows(files.select(F.col("path").alias("file"), "content"))


def feeds_of(rows: DataFrame) -> DataFrame:
    """Feed rows of the accepted types with their names filled in."""
    accepted = rows.filter(F.col("error").isNull() & ff.is_feed("type", "url"))
    return accepted.select(
        "file", "pos", ff.feed_name("text", "title").alias("name"), "url",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("description", "html_url", "category")],
    )


def valid_feeds(feeds: DataFrame) -> DataFrame:
    """Feeds with an http address: named after the address if need be, the address trimmed."""
    name = F.coalesce(non_empty("name"), F.concat(F.lit("Feed from "), F.col("url")))
    trimmed = feeds.filter(non_empty("url").isNotNull()).withColumn("name", name).withColumn("url", strip("url"))
    return trimmed.filter(F.startswith("url", F.lit("http")))
