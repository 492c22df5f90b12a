"""The shared folder for written tables and stream checkpoints."""

from __future__ import annotations

import os
import re
import uuid

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: the session's ``spark.checkpoint.dir``, else a folder in its warehouse.

    On a cluster a warehouse on the driver's own disk is refused, since no executor could read it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediate"
        if folder.startswith(("file:", "/")) and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: cuts the lineage and survives the loss of executors.

    Unlike an RDD checkpoint, the table is read column by column, and its size is known to the joins that use it.
    """
    path = fresh_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Deal the rows out into ``partitions`` by key: for steps that work long on each row of a table that is stored in a few files."""
    return df.repartition(partitions, key)


def store_of(path: str):
    """The file store of a path or address, and the path within it: for code that reads or writes files of its own inside tasks."""
    address = re.sub("^file:/*", "file:///", path if re.match("[a-z0-9]+:/", path) else f"file:{os.path.abspath(path)}")
    return FileSystem.from_uri(address.rstrip("/"))
