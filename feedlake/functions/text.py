"""Expressions over transcripts: normalising, time codes, chunking, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SEGMENTS, TRANSCRIPT, WORDS
from .basic import col, let, non_empty, strip

# Fillers that can be dropped without looking at the context.
FILLERS = ("um+", "uh+", "ah+", "you know")
CHUNK_SIZE = 15_000


def time_code(seconds: str | Column) -> Column:
    """Seconds as ``HH:MM:SS``, rounded down; hours grow beyond two digits when needed."""
    whole = F.floor(col(seconds)).cast("bigint")
    minutes = F.floor(F.pmod(whole, F.lit(3600)) / 60)
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), minutes, F.pmod(whole, F.lit(60)))


def time_coded_line(start: str | Column, text: str | Column) -> Column:
    return F.concat(F.lit("["), time_code(start), F.lit("] "), col(text))


def recognised(reply: str | Column, with_words: bool = False) -> Column:
    """Decode a recogniser's JSON reply and trim its texts; NULL when it is not JSON."""
    def segment(s: Column) -> Column:
        words = s["words"] if with_words else F.lit(None).cast(WORDS)
        return F.struct(
            s["id"].alias("id"), s["start"].alias("start"), s["end"].alias("end"), strip(s["text"]).alias("text"),
            words.alias("words"),
        )

    def normal(result: Column) -> Column:
        segments = F.coalesce(F.transform(result["segments"], segment), F.array().cast(SEGMENTS))
        fields = F.struct(strip(result["text"]).alias("text"), result["language"].alias("language"), segments.alias("segments"))
        return F.when(result["text"].isNotNull(), fields)

    return let(F.from_json(col(reply), TRANSCRIPT), normal)


def transcript_text(transcript: str | Column, time_codes: bool = True) -> Column:
    """Plain text, or one time-coded line per segment when there are segments."""
    t = col(transcript)
    if not time_codes:
        return t["text"]
    lines = F.transform(t["segments"], lambda s: time_coded_line(s["start"], s["text"]))
    return F.when(F.size(t["segments"]) > 0, F.array_join(lines, "\n")).otherwise(t["text"])


def sentences(text: str | Column) -> Column:
    """Split at full stop and blank, with line ends read as blanks."""
    return F.split(F.replace(col(text), F.lit("\n"), F.lit(" ")), r"\. ")


def _chunk_starts(said: Column, chunk_size: int) -> Column:
    """Index of the first sentence of each chunk. The fold keeps only these, so its state stays small."""
    begin = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("size"), F.array(F.lit(0)).cast("array<int>").alias("starts")
    )

    def step(acc: Column, n: Column) -> Column:
        full = (acc["at"] > 0) & (acc["size"] + n > chunk_size)
        return F.struct(
            (acc["at"] + 1).alias("at"),
            F.when(full, n).otherwise(acc["size"] + n).alias("size"),
            F.when(full, F.array_append(acc["starts"], acc["at"])).otherwise(acc["starts"]).alias("starts"),
        )

    return F.aggregate(F.transform(said, F.length), begin, step, lambda acc: acc["starts"])


def chunks(text: str | Column, chunk_size: int = CHUNK_SIZE) -> Column:
    """Array of chunks: whole sentences, filled greedily up to ``chunk_size`` characters.

    Separators are not counted, a sentence above the size stays whole, closed chunks end with a full stop, and a text within the
    size is one unchanged chunk. The work is linear in the text.
    """

    def joined(said: Column) -> Column:
        def pick(starts: Column) -> Column:
            def chunk(at: Column, i: Column) -> Column:
                following = F.get(starts, i + 1)
                body = F.array_join(F.slice(said, at + 1, F.coalesce(following, F.size(said)) - at), ". ")
                return F.concat(body, F.when(following.isNotNull(), F.lit(".")).otherwise(F.lit("")))

            return F.transform(starts, chunk)

        return let(_chunk_starts(said, chunk_size), pick)

    return F.when(F.length(col(text)) > chunk_size, let(sentences(text), joined)).otherwise(F.array(col(text)))


def explode_chunks(df: DataFrame, text: str, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """One row per chunk: the other columns, ``chunk_no`` from 0, and ``chunk``."""
    kept = [c for c in df.columns if c != text]
    # Every text has a chunk, so the outer form gives the same rows; the inner form would add a filter that chunks a second time.
    return df.select(*kept, F.posexplode_outer(chunks(text, chunk_size)).alias("chunk_no", "chunk"))


def cleaned_or_chunk(cleaned: str | Column, chunk: str | Column) -> Column:
    """The cleaned chunk, or the original one where cleaning gave nothing."""
    return F.coalesce(non_empty(cleaned), col(chunk))


def cleaned_or_raw(cleaned: str | Column, raw: str | Column) -> Column:
    """Blank text is returned as it is; failed cleaning falls back to the raw text."""
    r = col(raw)
    return F.when(F.length(strip(r)) == 0, r).otherwise(F.coalesce(non_empty(cleaned), r))


def drop_fillers(text: str | Column) -> Column:
    """Remove context-free English fillers with a following comma, then collapse blanks."""
    fillers = "|".join(FILLERS)
    kept = F.regexp_replace(col(text), rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{fillers})(?![\p{{L}}\p{{N}}_]),?\s*", "")
    return strip(F.regexp_replace(kept, " {2,}", " "))


def prompt(template: str, text: str | Column) -> Column:
    """Insert the text into a template at ``{transcript}``; other braces of the template stay as they are."""
    return F.replace(F.lit(template), F.lit("{transcript}"), col(text))
