"""Transcript and media files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings tried, in this order, when the expected media file is missing.
OTHER_ENDINGS = (".mp3", ".m4a", ".webm", ".opus")


def read_transcript_files(spark: SparkSession, path: str, kind: str = "raw") -> DataFrame:
    """Whole files ``{id}_{kind}.txt`` as rows ``(episode_id, kind, text)``.

    Other names are left out, and so are empty files, which Spark does not list.
    """
    name = F.regexp_extract(F.col("_metadata.file_name"), rf"^([0-9]+)_{kind}\.txt$", 1)
    texts = spark.read.text(path, wholetext=True, pathGlobFilter=f"*_{kind}.txt")
    return texts.select(name.try_cast("bigint").alias("episode_id"), F.lit(kind).alias("kind"), F.col("value").alias("text")) \
        .filter("episode_id IS NOT NULL")


def read_item_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole texts ``(episode_id, kind, text)`` from the folders that ``sinks.documents.write_texts`` makes.

    The line end that the sink puts behind each text is taken off again.
    """
    texts = spark.read.schema("value STRING, kind STRING, episode_id BIGINT").text(path, wholetext=True)
    return texts.select("episode_id", "kind", F.regexp_replace("value", r"\n\z", "").alias("text"))


def media_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of the media files. The content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", "length", "modificationTime")


def located_media(expected: DataFrame, inventory: DataFrame) -> DataFrame:
    """Rows ``(episode_id, file_name)`` with the path and size of their file, NULL where there is none.

    Files are matched on the name without its ending; the expected ending wins, then the others in order.
    """
    ending = F.regexp_extract("file_name", r"(\.[^.]*)$", 1)
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    wanted = expected.select("episode_id", stem.alias("stem"), ending.alias("wanted"))
    present = inventory.select(stem.alias("stem"), ending.alias("ending"), "path", "length")
    present = present.filter(F.col("ending").isNotNull())
    rank = F.when(F.col("ending") == F.col("wanted"), -1)
    for i, other in enumerate(OTHER_ENDINGS):
        rank = rank.when(F.col("ending") == other, i)
    best = F.min_by(F.struct("path", "length"), F.struct(rank.alias("rank"), "path"))
    candidates = wanted.join(present, "stem").filter(rank.isNotNull())
    found = candidates.groupBy("episode_id").agg(best.alias("file"))
    return expected.join(found, "episode_id", "left").select(
        "episode_id", "file_name", F.col("file.path").alias("path"), F.col("file.length").alias("size")
    )
