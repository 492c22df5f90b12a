"""The jobs of a feed system. Each takes tables and returns tables; the caller writes them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import summaries as fs
from ..functions import text as ft
from ..functions.basic import non_empty, strip, utc
from ..operators import aggregates as agg
from ..operators import digests, joins, state
from ..operators.inference import Model, apply_model
from ..schemas import COMPLETED, FAILED, LOG_STAGES
from ..sinks import documents
from ..sinks.keyed import KeyedTable
from ..sources import outlines, payloads
from ..storage import materialize

CLEANING_TEMPLATE = (
    "Edit this transcript. Remove filler words and correct obvious recognition errors. Keep everything else, in full length.\n\n"
    "{transcript}"
)
SUMMARY_TEMPLATE = (
    "Summarise this transcript. Answer with one JSON object only:\n"
    '{"host_and_guest": "", "comprehensive_summary": "", "key_topics": [{"topic": "", "description": ""}], '
    '"actionable_quotes": [{"quote": "", "speaker": "", "context": ""}], '
    '"investment_theses": [{"thesis": "", "reasoning": "", "risks": ""}], "noteworthy_observations": [""], '
    '"company_mentions": [{"name": "", "industry": "", "context": "", "details": ""}]}\n\n'
    "{transcript}"
)
# What the status table and the log say about a failed stage, in the order of the stages.
STATUS_ERRORS = ("Audio download failed", "Transcription failed", "Cleaning failed", "Summarization failed")
LOG_ERRORS = ("Download failed", "Transcription failed", "Cleaning failed", "Summarization failed")


@dataclass
class Sync:
    feeds: DataFrame
    episodes: DataFrame
    status: DataFrame
    inserted: DataFrame
    totals: DataFrame


def incoming_items(fetched: DataFrame, feeds: DataFrame, as_of: str | datetime, max_age_days: int | None) -> DataFrame:
    """Recent audio items of the enabled feeds; ``fetched`` is ``(payload_no, url, xml)``."""
    enabled = joins.enabled_feeds(feeds).select(F.col("id").alias("feed_id"), "url")
    documents_ = payloads.parsed(fetched.join(enabled, "url"))
    items = payloads.episode_items(payloads.raw_items(documents_))
    return items.filter(joins.recent_enough("published_date", as_of, max_age_days))


def sync_feeds(
    feeds: DataFrame,
    episodes: DataFrame,
    status: DataFrame,
    fetched: DataFrame,
    as_of: str | datetime,
    max_age_days: int | None = None,
    configured: DataFrame | None = None,
    ids: str = "sequence",
) -> Sync:
    """Take up the new items of all enabled feeds in one job.

    ``fetched`` is ``(payload_no, url, xml)``; the number, unique per payload, settles which of two payloads of a feed comes first.
    ``configured`` is an optional batch of feeds ``(pos, name, url, enabled)`` to add or update first.
    """
    if "payload_no" not in fetched.columns:
        raise ValueError("fetched needs a payload_no: without it, the order of two payloads of one feed is undefined")
    if configured is not None:
        feeds = materialize(state.upsert_feeds(feeds, state.feed_outcomes(feeds, configured), as_of))
    items = incoming_items(fetched, feeds, as_of, max_age_days)
    order = ("feed_id", "payload_no", "pos")
    # Written once, by the numbering or here, so that the results below do not parse the documents again.
    inserted = state.insert_items(episodes, items, None, as_of, order, ids)
    if ids == "hash":
        inserted = materialize(inserted)
    return Sync(
        feeds=state.stamp_checked(feeds, joins.enabled_feeds(feeds), as_of),
        episodes=state.append(episodes, inserted),
        status=state.append(status, state.first_status(inserted, as_of)),
        inserted=inserted,
        totals=agg.sync_totals(inserted),
    )


@dataclass
class Processing:
    """``results`` is written; the tables made of it are worked out when they are asked for, so that a caller pays for those only."""

    results: DataFrame
    old: tuple[DataFrame, DataFrame, DataFrame]  # status, transcripts and summaries before
    as_of: str | datetime
    output_format: str
    models: tuple[str, str, str]

    @cached_property
    def _done(self) -> DataFrame:
        return self.results.filter("failed_at = 4")

    @cached_property
    def status(self) -> DataFrame:
        return state.update_status(self.old[0], _status_updates(self.results, self.as_of))

    @cached_property
    def transcripts(self) -> DataFrame:
        return state.save_transcripts(self.old[1], _transcript_saves(self.results, self.as_of, self.models))

    @cached_property
    def summaries(self) -> DataFrame:
        saved = fs.storable(self._done.select("episode_id", F.lit(self.models[2]).alias("model_used"), "summary"))
        return state.append(self.old[2], state.save_summaries(self.old[2], saved, self.as_of))

    @cached_property
    def documents(self) -> DataFrame:
        return documents.summary_rows(self._done.select("episode_id", "summary"), self.output_format)

    @cached_property
    def logs(self) -> DataFrame:
        return _log_rows(self.results, self.as_of)

    @cached_property
    def outcomes(self) -> DataFrame:
        return agg.outcome_counts(self.results.select(F.when(F.col("failed_at") == 4, "success").otherwise("failed").alias("outcome")))


def clean_texts(
    texts: DataFrame, make_model: Callable[..., Model], template: str = CLEANING_TEMPLATE,
    chunk_size: int = ft.CHUNK_SIZE, partitions: int | None = None, **options,
) -> DataFrame:
    """``(episode_id, raw_text)`` to ``(episode_id, cleaned_text)``: one model call per chunk, spread over all tasks.

    A chunk whose call fails keeps its own text. Blank texts have no row.
    """
    spoken = texts.filter(F.length(strip("raw_text")) > 0).select("episode_id", "raw_text")
    chunks = ft.explode_chunks(spoken, "raw_text", chunk_size)
    # The chunks of one long text leave its task, so that no task has more calls to make than another.
    spread = (partitions, "episode_id", "chunk_no") if partitions else ("episode_id", "chunk_no")
    prompts = chunks.repartition(*spread).withColumn("prompt", ft.prompt(template, "chunk"))
    # Written once: the calls are the dear part, and must not run again for a second use.
    replies = apply_model(prompts, "prompt", make_model, **options)
    cleaned = materialize(replies.select("episode_id", "chunk_no", ft.cleaned_or_chunk(strip("reply"), "chunk").alias("text")))
    piece = F.struct("chunk_no", "text")
    # The chunks of one item come from one row, so they fit one again.
    merged = cleaned.groupBy("episode_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    return merged.select("episode_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "\n\n").alias("cleaned_text"))


def process_items(
    queue: DataFrame,
    media: DataFrame,
    recognised: DataFrame,
    clean_model: Callable[..., Model],
    summary_model: Callable[..., Model],
    as_of: str | datetime,
    status: DataFrame,
    transcripts: DataFrame,
    summaries: DataFrame,
    output_format: str = "both",
    chunk_size: int = ft.CHUNK_SIZE,
    models: tuple[str, str, str] = ("recogniser", "cleaner", "summarizer"),
    partitions: int | None = None,
) -> Processing:
    """Bring queued items from media to summary.

    ``queue`` has ``id``; ``media`` ``(episode_id, audio_path)``; ``recognised`` ``(episode_id, reply)`` with the recogniser's JSON. An
    item without audio, transcript or summary fails alone; failed cleaning goes on with the raw text.
    """
    heard = recognised.select(
        "episode_id", ft.transcript_text(ft.recognised("reply"), time_codes=False).alias("raw_text")
    )
    work = queue.select(F.col("id").alias("episode_id")).join(media, "episode_id", "left").join(heard, "episode_id", "left")
    work = materialize(work.select("episode_id", non_empty("audio_path").alias("audio_path"),
                                   F.when(F.length("audio_path") > 0, non_empty("raw_text")).alias("raw_text")))
    cleaned = clean_texts(work, clean_model, chunk_size=chunk_size, partitions=partitions)
    texts = work.join(cleaned, "episode_id", "left").withColumn("cleaned_text", ft.cleaned_or_raw("cleaned_text", "raw_text"))
    spoken = F.when(F.length(strip("cleaned_text")) > 0, ft.prompt(SUMMARY_TEMPLATE, "cleaned_text"))
    # The texts go past the model in the same rows, which is cheaper than joining its replies back to them.
    replies = apply_model(texts.withColumn("prompt", spoken), "prompt", summary_model, partitions=partitions)
    failed_at = (
        F.when(F.col("audio_path").isNull(), 0).when(F.col("raw_text").isNull(), 1)
        .when(F.col("summary").isNull(), 3).otherwise(4)
    )
    # The error text of a failed call stays in the results.
    decoded = replies.withColumn("summary", fs.decode("reply")).drop("reply")
    results = materialize(
        decoded.withColumn("failed_at", failed_at).withColumn("summary_path", documents.summary_paths(output_format)["summary_path"])
    )
    return Processing(results, (status, transcripts, summaries), as_of, output_format, models)


def keep_processing(
    done: Processing, status: KeyedTable, transcripts: KeyedTable, as_of: str | datetime, order: int,
    models: tuple[str, str, str] = ("recogniser", "cleaner", "summarizer"),
) -> None:
    """Take a batch of processed items into tables that are merged on read, as version ``order`` of both: only the batch is written.

    A job that is repeated after a failure gives the same order again, which does nothing where it was taken.
    """
    state.take_transcripts(transcripts, _transcript_saves(done.results, as_of, models), order)
    state.take_status(status, _status_updates(done.results, as_of), order)
    for table in (transcripts, status):
        table.compact()


def _transcript_saves(results: DataFrame, as_of: str | datetime, models: tuple[str, str, str]) -> DataFrame:
    return results.filter("failed_at > 1").select(
        "episode_id", "raw_text", "cleaned_text", F.lit(models[0]).alias("transcription_model"),
        F.lit(models[1]).alias("cleaning_model"), utc(as_of).alias("at"), F.lit(0).alias("seq"),
    )


def _status_updates(results: DataFrame, as_of: str | datetime) -> DataFrame:
    at = F.col("failed_at")
    error = F.get(F.array(*[F.lit(e) for e in STATUS_ERRORS]), at)
    name = F.concat(F.lit("transcripts/"), F.col("episode_id").cast("string"))
    return results.select(
        "episode_id",
        F.when(at == 4, COMPLETED).otherwise(FAILED).alias("status"),
        error.alias("error_message"),
        "audio_path",
        F.when(at > 1, F.concat(name, F.lit("_raw.txt"))).alias("raw_transcript_path"),
        F.when(at > 1, F.concat(name, F.lit("_cleaned.txt"))).alias("cleaned_transcript_path"),
        F.when(at == 4, F.col("summary_path")).alias("summary_path"),
        utc(as_of).alias("at"),
        F.lit(0).alias("seq"),
    )


def _log_rows(results: DataFrame, as_of: str | datetime) -> DataFrame:
    """Started and finished rows of every stage an item reached."""
    success = (
        F.concat(F.lit("Downloaded to "), "audio_path"),
        F.concat(F.lit("Transcribed "), F.length("raw_text").cast("string"), F.lit(" characters")),
        F.concat(F.lit("Cleaned "), F.length("cleaned_text").cast("string"), F.lit(" characters")),
        F.concat(F.lit("Summary saved to "), "summary_path"),
    )
    events = []
    for i, stage in enumerate(LOG_STAGES[:4]):
        here, ok = F.col("failed_at") >= i, F.col("failed_at") > i
        for seq, state_, message in (
            (2 * i, F.lit("started"), F.lit(None).cast("string")),
            (2 * i + 1, F.when(ok, "success").otherwise("error"), F.when(ok, success[i]).otherwise(F.lit(LOG_ERRORS[i]))),
        ):
            event = F.struct(F.lit(seq).alias("seq"), F.lit(stage).alias("stage"), state_.alias("status"), message.alias("message"))
            events.append(F.when(here, event))
    reached = F.filter(F.array(*events), lambda e: e.isNotNull())
    rows = results.select("episode_id", F.explode(reached).alias("e"))
    return rows.select("episode_id", "e.seq", "e.stage", "e.status", "e.message", utc(as_of).alias("timestamp"))


@dataclass
class Digest:
    base: DataFrame
    html: DataFrame
    text: DataFrame


def weekly_digest(
    episodes: DataFrame, feeds: DataFrame, status: DataFrame, summaries: DataFrame, as_of: str | datetime,
    days: int = 7, full: bool = False,
) -> Digest:
    """HTML and text digest of the items completed in the last ``days``."""
    base = digests.positioned(joins.digest_base(episodes, feeds, status, as_of, days))
    return Digest(base=base, html=digests.html_digest(base, summaries, full), text=digests.text_digest(base, summaries))


@dataclass
class Import:
    feeds: DataFrame
    counts: DataFrame
    confirmed: DataFrame


def import_outlines(feeds: DataFrame, documents_: DataFrame, as_of: str | datetime, enabled: bool = True) -> Import:
    """Add the feeds of outline documents ``(file, content)`` to the feeds table."""
    found = materialize(outlines.valid_feeds(outlines.feeds_of(outlines.outline_rows(documents_))))
    batch = found.select(F.struct("file", "pos").alias("pos"), "name", "url", F.lit(enabled).alias("enabled"))
    outcomes = state.feed_outcomes(feeds, batch)
    new_feeds = state.upsert_feeds(feeds, outcomes, as_of)
    return Import(
        feeds=new_feeds, counts=agg.import_counts(outcomes),
        confirmed=joins.now_enabled(found.select("file", "pos", "name", "url"), new_feeds),
    )


def export_outline(feeds: DataFrame, title: str = "Feeds") -> DataFrame:
    """Outline document of the enabled feeds."""
    return documents.outline_document(joins.enabled_feeds(feeds), title)
