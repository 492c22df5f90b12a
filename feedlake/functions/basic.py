"""Small helpers shared by the other expression modules."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is trimmed.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: str | Column) -> Column:
    """Trim all Unicode white space. ``btrim`` walks in from both ends, so long inner gaps cost nothing."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def non_empty(c: str | Column) -> Column:
    """NULL for an empty string."""
    return F.nullif(col(c), F.lit(""))


def utc(moment: str | datetime | Column) -> Column:
    """A zone-less UTC time from a Python value; a Column is passed through."""
    if isinstance(moment, Column):
        return moment
    return F.lit(str(moment)).cast("timestamp_ntz")


def utc_wall_clock(instant: Column) -> Column:
    """UTC wall-clock time of an instant, whatever the session time zone is."""
    seconds = F.unix_seconds(instant).cast("decimal(18,6)")
    return utc("1970-01-01 00:00:00") + F.make_dt_interval(secs=seconds)


def utc_instant(wall_clock: str | Column) -> Column:
    """Instant of a UTC wall-clock time, whatever the session time zone is."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", utc("1970-01-01 00:00:00"), col(wall_clock)))


def days_before(moment: str | datetime | Column, days: int) -> Column:
    return utc(moment) - F.make_dt_interval(days=F.lit(days))


def escape_xml(c: str | Column) -> Column:
    """Escape ``& < >``."""
    text = F.replace(col(c), F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit(">"), F.lit("&gt;"))


def escape_attribute(c: str | Column) -> Column:
    """Escape text for a double-quoted XML attribute."""
    text = escape_xml(c)
    for raw, escaped in (('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text
