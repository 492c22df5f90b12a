"""What several operators share: the white space of words, row numbers, whole rows as one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters between words, as a character class and as plain characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(name: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of other characters than ``SPACES``."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def drop_characters(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def whole_rows(df: DataFrame, *columns: str | Column, keep: list[str] | None = None) -> DataFrame:
    """Each row, or its columns ``keep``, as one column ``row``, with further columns beside it: no name of the input can clash with theirs."""
    return df.select(F.struct(*(keep or ["*"])).alias("row"), *columns)


def with_row(rows: DataFrame, more: str) -> T.StructType:
    """Schema of ``row`` as it is in ``rows``, whatever the names in it, and the fields ``more``."""
    return T.StructType([rows.schema["row"], *T.StructType.fromDDL(more).fields])


def numbered(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The given columns with ``rid``, a number that tells repeated rows apart.

    The number is the place of the row in one scan. It holds within one lineage, also when lost parts are made again, but two scans of a
    table may be cut differently: to meet again across scans, rows need ``content_key``.
    """
    return df.select(F.monotonically_increasing_id().alias("rid"), *columns)


def content_key(key: str, text: Column) -> Column:
    """Id and text digest in one: rows with equal keys are copies of one row, and any scan gives the same key."""
    return F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.hex(F.xxhash64(text)))
