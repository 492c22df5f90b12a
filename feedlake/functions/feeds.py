"""Expressions over feeds and feed items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basic import col, let, non_empty, strip, utc_wall_clock

# Outline types taken as feeds.
FEED_TYPES = ("rss", "link", "")
# Conversion quality by name; any other name counts as 'good'.
QUALITY_LEVELS = {"best": "0", "good": "2", "medium": "5"}
DEFAULT_QUALITY = "2"
# Offsets of zone names in dates. A name that is not listed here, or is used for several zones, counts as UTC.
ZONE_OFFSETS = {
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
    "AKST": "-09:00", "AKDT": "-08:00", "HST": "-10:00", "WEST": "+01:00", "BST": "+01:00", "CET": "+01:00", "CEST": "+02:00",
    "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00", "JST": "+09:00", "KST": "+09:00", "AEST": "+10:00", "AEDT": "+11:00",
    "NZST": "+12:00", "NZDT": "+13:00",
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_MONTH_NUMBERS = {**{name: i for i, name in enumerate(MONTHS, 1)}, **{name[:3]: i for i, name in enumerate(MONTHS, 1)}, "sept": 9}
#: Words of a date that say nothing about it: weekdays, small words, and ordinal endings.
_SILENT = r"\b(?:" + "|".join(WEEKDAYS) + "|(?:" + "|".join(d[:3] for d in WEEKDAYS) + r"|tues|weds|thurs?|at|of|on|t|the))\b|(?<=[0-9])(?:st|nd|rd|th)\b"
#: A time of day with its half and zone. What stands before and behind it is the date.
_CLOCK = (
    r"^(.*?)(?:[ ,]+(?:at +)?|(?<=[0-9])t ?)?(?<![0-9])([0-9]{1,2})(?::([0-9]{2})(?::([0-9]{2}))?(?:[.,][0-9]+)?(?: ?([ap])[.]?m[.]?(?![a-z]))?| ?([ap])[.]?m[.]?(?![a-z]))"
    r" ?((?!" + "|".join(w[:3] for w in (*MONTHS, *WEEKDAYS)) + r")[a-z]{1,5}(?![a-z]))? ?([+-][0-9]{1,2}:?(?:[0-9]{2})?)?(?![0-9:])(.*)$"
)
#: A date and perhaps a time written as digits alone.
_DIGITS = r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:[t ]?([0-9]{2})([0-9]{2})([0-9]{2})?(.*))?$"


def audio_url(enclosures: str | Column, links: str | Column) -> Column:
    """Address of the first audio enclosure; if it has none, of the first audio link; else NULL."""

    def first_audio(items: str | Column) -> Column:
        return F.get(F.filter(col(items), lambda e: F.contains(e["type"], F.lit("audio"))), F.lit(0))["href"]

    return F.coalesce(non_empty(first_audio(enclosures)), non_empty(first_audio(links)))


def duration_seconds(text: str | Column) -> Column:
    """``S``, ``M:S`` or ``H:M:S`` to seconds, without a range check; NULL for anything else."""

    def seconds(parts: Column) -> Column:
        whole = F.forall(parts, lambda p: F.rlike(strip(p), F.lit(r"^[+-]?[0-9]+(_[0-9]+)*$")))
        sixty = F.lit(60).cast("decimal(38,0)")
        total = F.aggregate(F.transform(parts, _to_number), F.lit(0).cast("decimal(38,0)"),
                            lambda sum_, n: F.try_add(F.try_multiply(sum_, sixty), n).try_cast("decimal(38,0)"))
        return F.when(whole & (F.size(parts) <= 3), total).try_cast("int")

    return let(F.split(col(text), ":"), seconds)


def _to_number(part: Column) -> Column:
    """A whole number of any sign and with any leading zeros; what does not fit 38 digits does not fit the column either."""
    return F.replace(strip(part), F.lit("_"), F.lit("")).try_cast("decimal(38,0)")


def published_date(text: str | Column) -> Column:
    """UTC publish time from a feed date in mail style, ISO 8601 or common free text; NULL when none fits.

    One pattern takes the time of day out; what is left is split into words and numbers once. Each token is classed (month, number, silent
    word) and the three that matter are placed: a number above 31 or of more than two digits is the year; of two numbers beside a month name
    the other is the day; of three numbers the first is the month, unless it is above 12. A word that is none of a date's makes it no date.
    """

    def whole(raw: Column) -> Column:
        bare = F.when(F.contains(raw, F.lit("(")), F.regexp_replace(raw, r"\s*\([^()]*\)$", "")).otherwise(raw)
        digits = F.rlike(bare, F.lit("^[0-9]{8}"))
        spelled = F.regexp_replace(F.regexp_replace(bare, _DIGITS, "$1-$2-$3 $4:$5:$6$7"), "( ::$|:(?=$|[^0-9]))", "")
        return F.when(digits, spelled).otherwise(bare)

    def time(written: Column) -> Column:
        # Texts with the separator of the parts are no dates.
        parts = F.split(F.regexp_replace(written, _CLOCK, "$1 $9|$2|$3|$4|$5$6|$7|$8"), "[|]")
        found = let(parts, lambda p: let(_date(F.get(p, F.lit(0))), lambda d: _moment(d, p)))
        return F.coalesce(found, F.when(F.rlike(written, F.lit("^[0-9]{4}-[0-9]{2}")), _iso_time(F.upper(written))))

    return let(let(F.lower(strip(text)), whole), time)


def _date(rest: Column) -> Column:
    """Year, month and day out of what is left beside the time; NULL if they are not there."""
    months = F.create_map(*[F.lit(x) for pair in _MONTH_NUMBERS.items() for x in pair])
    tokens = F.regexp_extract_all(F.regexp_replace(rest, _SILENT, " "), F.lit("[a-z]+|[0-9]+"), F.lit(0))

    def classed(t: Column) -> Column:
        return let(t.try_cast("int"), lambda n: F.struct(
            n.alias("n"), F.when(n.isNull(), F.try_element_at(months, t)).alias("word"), (F.length(t) > 2).alias("long")))

    def placed(s: Column) -> Column:
        """The tokens that matter, in order."""
        first, second, third = (F.get(s, F.lit(i)) for i in range(3))
        year = lambda t: t["long"] | (t["n"] > 31)

        def ymd(y: Column, m: Column, d: Column) -> Column:
            full = F.when(y["long"], y["n"]).otherwise(y["n"] + F.when(y["n"] < 90, 2000).otherwise(1900))
            return F.struct(full.alias("y"), F.coalesce(m["word"], m["n"]).alias("m"), d["n"].alias("d"))

        is_month = lambda t: t["word"].isNotNull()
        named = (
            F.when(is_month(first), F.when(year(second), ymd(second, first, third)).otherwise(ymd(third, first, second)))
            .when(is_month(second), F.when(year(first), ymd(first, second, third)).otherwise(ymd(third, second, first)))
            .when(is_month(third), F.when(year(first), ymd(first, third, second)).otherwise(ymd(second, third, first)))
        )
        numbers = (
            F.when(year(first), ymd(first, second, third)).when(first["n"] > 12, ymd(third, second, first)).otherwise(ymd(third, first, second))
        )
        # Each token is a number or a month, and at most one is a month.
        known = lambda t: t["n"].isNotNull() | is_month(t)
        all_known = known(first) & known(second) & known(third)
        n_months = sum((is_month(t).cast("int") for t in (first, second, third)), F.lit(0))
        return F.when(all_known & (n_months == 1), named).when(all_known & (n_months == 0), numbers)

    return let(tokens, lambda t: F.when(F.size(t) == 3, let(F.transform(t, classed), placed)))


def _moment(date: Column, parts: Column) -> Column:
    """The date with the time of day, half and zone that ``_CLOCK`` found, in UTC."""
    hour, minute, second = (F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0)) for i in (1, 2, 3))
    half, zone, offset = (F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in (4, 5, 6))
    # 12 is the first hour of either half; a half with any other hour above 12 is no time.
    of_day = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    names = F.create_map(*[F.lit(x) for name, o in ZONE_OFFSETS.items() for x in (name.lower(), _minutes(o))])

    def ahead(digits: Column) -> Column:
        """Minutes of an offset written as ``+h``, ``+hh`` or ``+hhmm``."""
        n = digits.try_cast("int")
        return F.when(F.length(digits) > 3, F.floor(F.abs(n) / 100) * 60 + F.abs(n) % 100).otherwise(F.abs(n) * 60) * F.signum(n)

    by_name = F.when(zone == "", F.lit(0)).otherwise(F.coalesce(F.try_element_at(names, zone), F.lit(0)))
    minutes = F.when(offset == "", by_name).otherwise(let(F.replace(offset, F.lit(":"), F.lit("")), ahead)).cast("int")
    local = F.try_make_timestamp_ntz(date["y"], date["m"], date["d"], of_day, minute, second)
    return local - F.make_dt_interval(mins=minutes)


def _minutes(offset: str) -> int:
    sign = -1 if offset[0] == "-" else 1
    return sign * (int(offset[1:3]) * 60 + int(offset[4:6]))


def _iso_time(raw: Column) -> Column:
    """What ISO 8601 allows beyond full dates, by a cast."""
    whole = F.regexp_replace(F.regexp_replace(raw, r" (?=[Zz+-])", ""), r"([T ][0-9]{2}:[0-9]{2})(?=$|[Zz+-])", "$1:00")
    zoned = F.rlike(whole, F.lit(r"[0-9]{2}:[0-9]{2}.*([Zz]|[+-][0-9]{2}:?[0-9]{2})$"))
    instant = F.regexp_replace(whole, r"([0-9][+-][0-9]{2})([0-9]{2})$", "$1:$2").try_cast("timestamp")
    return F.when(zoned, utc_wall_clock(instant)).otherwise(whole.try_cast("timestamp_ntz"))


def feed_name(text: str | Column, title: str | Column) -> Column:
    return F.coalesce(non_empty(text), non_empty(title), F.lit("Unnamed Feed"))


def is_feed(type_: str | Column, url: str | Column) -> Column:
    """Outline type is a feed type, or is missing, or the address mentions rss."""
    known = F.coalesce(col(type_), F.lit("")).isin(*FEED_TYPES)
    return known | F.contains(F.lower(col(url)), F.lit("rss"))


def safe_file_name(episode_id: str | Column, title: str | Column, extension: str = "mp3") -> Column:
    """``{id}_{clean title}_{hash}.{extension}``: the hash keeps equal clean titles apart."""
    kept = F.regexp_replace(F.substring(col(title), 1, 50), r"[^\p{L}\p{N} _-]", "")
    clean = F.replace(F.trim(kept), F.lit(" "), F.lit("_"))
    digest = F.substring(F.md5(F.encode(col(title), "UTF-8")), 1, 8)
    return F.concat(col(episode_id).cast("string"), F.lit("_"), clean, F.lit("_"), digest, F.lit(f".{extension}"))


def quality_level(quality: str | Column) -> Column:
    pairs = [F.lit(x) for pair in QUALITY_LEVELS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(quality)), F.lit(DEFAULT_QUALITY))


def shorten(c: str | Column, limit: int) -> Column:
    """First ``limit`` characters and an ellipsis, if the text is longer."""
    text = col(c)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
