"""Documents as text files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import escape_attribute, escape_xml, non_empty
from ..functions import summaries as fs
from ..operators.ordering import with_position
from ..storage import store_of

# The frame of an outline document.
OUTLINE_HEAD = "<?xml version='1.0' encoding='utf-8'?>\n<opml version=\"2.0\">\n  <head>\n    <title>"
OUTLINE_BODY = "</title>\n  </head>\n"
#: Folders among which item files are dealt out.
FOLDERS = 64


def outline_line(name: str | Column, url: str | Column, description: str | Column, html_url: str | Column) -> Column:
    """One feed as an outline element; the optional attributes appear only when they are not empty."""

    def attribute(label: str, value: str | Column) -> Column:
        text = non_empty(value)
        return F.when(text.isNotNull(), F.concat(F.lit(f'{label}="'), escape_attribute(text), F.lit('" '))).otherwise(F.lit(""))

    label = escape_attribute(F.coalesce(name, F.lit("Unnamed Feed")))
    address = escape_attribute(F.coalesce(url, F.lit("")))
    return F.concat(
        F.lit('    <outline type="rss" text="'), label, F.lit('" xmlUrl="'), address, F.lit('" '),
        attribute("description", description), attribute("htmlUrl", html_url), F.lit("/>"),
    )


def outline_document(feeds: DataFrame, title: str = "Feeds") -> DataFrame:
    """Outline document as ordered lines ``(part, position, text)``; ``feeds`` is ordered by its ``id``."""
    for optional in ("description", "html_url"):
        if optional not in feeds.columns:
            feeds = feeds.withColumn(optional, F.lit(None).cast("string"))
    lines = feeds.select("id", outline_line(F.col("name"), F.col("url"), "description", "html_url").alias("text"))
    numbered = with_position(lines, "id", into="position", start=0)
    total = numbered.agg(F.count("*").alias("n"))
    head = F.concat(F.lit(OUTLINE_HEAD), escape_xml(F.lit(title)), F.lit(OUTLINE_BODY),
                    F.when(F.col("n") > 0, F.lit("  <body>")).otherwise(F.lit("  <body />")))
    foot = F.when(F.col("n") > 0, F.lit("  </body>\n</opml>")).otherwise(F.lit("</opml>"))
    at = F.lit(0).cast("bigint").alias("position")
    return reduce(DataFrame.unionByName, [
        total.select(F.lit(0).alias("part"), at, head.alias("text")),
        numbered.select(F.lit(1).alias("part"), "position", "text"),
        total.select(F.lit(2).alias("part"), at, foot.alias("text")),
    ])


def write_document(parts: DataFrame, path: str) -> None:
    """Write ordered parts as text files; joined in the order of their names, the files are the document."""
    parts.orderBy("part", "position").select("text").write.mode("errorifexists").text(path)


def transcript_rows(transcripts: DataFrame) -> DataFrame:
    """``(episode_id, kind, file_name, text)`` for the raw and the cleaned text, one scan for both."""
    both = transcripts.select("episode_id", F.expr("stack(2, 'raw', raw_text, 'cleaned', cleaned_text) AS (kind, text)"))
    name = F.concat(F.col("episode_id").cast("string"), F.lit("_"), F.col("kind"), F.lit(".txt"))
    return both.filter("text IS NOT NULL").select("episode_id", "kind", name.alias("file_name"), "text")


def summary_paths(output_format: str = "both", folder: str = "summaries") -> dict[str, Column]:
    """Paths of an item's JSON and Markdown files, NULL for a form that is not wanted, and the path the status table keeps."""
    base = F.concat(F.lit(f"{folder}/"), F.col("episode_id").cast("string"), F.lit("_summary"))
    none = F.lit(None).cast("string")
    json_path = F.concat(base, F.lit(".json")) if output_format in ("json", "both") else none
    markdown_path = F.concat(base, F.lit(".md")) if output_format in ("markdown", "both") else none
    return {"json_path": json_path, "markdown_path": markdown_path, "summary_path": F.coalesce(markdown_path, json_path)}


def summary_rows(summaries: DataFrame, output_format: str = "both", folder: str = "summaries") -> DataFrame:
    """JSON and Markdown documents of ``(episode_id, summary)`` with their paths.

    ``output_format`` is ``json``, ``markdown`` or ``both``; a form that is not wanted is NULL.
    """
    none = F.lit(None).cast("string")
    return summaries.filter("summary IS NOT NULL").select(
        "episode_id",
        *[path.alias(name) for name, path in summary_paths(output_format, folder).items()],
        (fs.document("summary") if output_format in ("json", "both") else none).alias("json_text"),
        (fs.markdown("summary") if output_format in ("markdown", "both") else none).alias("markdown_text"),
    )


def write_texts(rows: DataFrame, key: list[str], text: str, path: str) -> None:
    """Text files in one folder per key value. Meant for selections; whole tables belong in parquet."""
    rows.select(*key, F.col(text).alias("value")).write.mode("errorifexists").partitionBy(*key).text(path)


def write_item_files(rows: DataFrame, path: str, file_name: str = "file_name", text: str = "text") -> int:
    """Every text as a file of its own name, a line end behind it, in one of ``FOLDERS`` folders by the hash of the name; returns their number.

    Names are distinct. Tasks write their rows one by one and put each file in its place when it is whole, so that a repeated task leaves
    the same files. The line end keeps empty texts visible to Spark's file scans, which do not list empty files. The folder is one
    that executors reach by a path or a store of ``pyarrow.fs``.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(path)
        for batch in batches:
            for folder, name, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                place, own = f"{root}/{folder}/{name}", f"{root}/{folder}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(f"{value}\n".encode())
                store.move(own, place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    store, root = store_of(path)
    for i in range(FOLDERS):
        store.create_dir(f"{root}/{i:02d}", recursive=True)
    folder = F.lpad(F.pmod(F.xxhash64(file_name), F.lit(FOLDERS)).cast("string"), 2, "0")
    named = rows.filter(F.col(text).isNotNull()).select(folder.alias("folder"), F.col(file_name).alias("name"), F.col(text).alias("value"))
    return named.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
