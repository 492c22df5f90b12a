"""Table schemas, keys and rules of the feed model.

Times are UTC wall-clock times without a zone (``TIMESTAMP_NTZ``), so no result depends on the session time zone. Ids are
``BIGINT``.
"""

from __future__ import annotations

TABLES = {
    "feeds": "id BIGINT, name STRING, url STRING, enabled BOOLEAN, last_checked TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ",
    "episodes": (
        "id BIGINT, feed_id BIGINT, title STRING, description STRING, audio_url STRING, published_date TIMESTAMP_NTZ, "
        "duration_seconds INT, guid STRING, created_at TIMESTAMP_NTZ"
    ),
    "processing_status": (
        "episode_id BIGINT, status STRING, audio_path STRING, raw_transcript_path STRING, cleaned_transcript_path STRING, "
        "summary_path STRING, error_message STRING, started_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ, "
        "updated_at TIMESTAMP_NTZ"
    ),
    "transcripts": (
        "id BIGINT, episode_id BIGINT, raw_text STRING, cleaned_text STRING, transcription_model STRING, "
        "cleaning_model STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "summaries": (
        "id BIGINT, episode_id BIGINT, host_and_guest STRING, comprehensive_summary STRING, key_topics STRING, "
        "actionable_quotes STRING, investment_theses STRING, noteworthy_observations STRING, company_mentions STRING, "
        "model_used STRING, created_at TIMESTAMP_NTZ"
    ),
    "processing_logs": (
        "id BIGINT, episode_id BIGINT, stage STRING, status STRING, message STRING, timestamp TIMESTAMP_NTZ"
    ),
    "metadata": "key STRING, value STRING, updated_at TIMESTAMP_NTZ",
}

# Array fields of a summary, in storage order, with their element types.
SUMMARY_ARRAYS = {
    "key_topics": "ARRAY<STRUCT<topic: STRING, description: STRING>>",
    "actionable_quotes": "ARRAY<STRUCT<quote: STRING, speaker: STRING, context: STRING>>",
    "investment_theses": "ARRAY<STRUCT<thesis: STRING, reasoning: STRING, risks: STRING>>",
    "noteworthy_observations": "ARRAY<STRING>",
    "company_mentions": "ARRAY<STRUCT<name: STRING, industry: STRING, context: STRING, details: STRING>>",
}

SUMMARY = "STRUCT<host_and_guest: STRING, comprehensive_summary: STRING, " + ", ".join(
    f"{name}: {type_}" for name, type_ in SUMMARY_ARRAYS.items()
) + ">"

WORDS = "ARRAY<STRUCT<word: STRING, start: DOUBLE, end: DOUBLE, probability: DOUBLE>>"
SEGMENTS = f"ARRAY<STRUCT<id: INT, start: DOUBLE, end: DOUBLE, text: STRING, words: {WORDS}>>"
TRANSCRIPT = f"STRUCT<text: STRING, language: STRING, segments: {SEGMENTS}>"

# The states of one item, in order of progress; 'failed' may follow any of them.
PENDING = "pending"
IN_PROGRESS = ("downloading", "transcribing", "cleaning", "summarizing")
COMPLETED = "completed"
FAILED = "failed"
STATUSES = (PENDING, *IN_PROGRESS, COMPLETED, FAILED)
RETRYABLE = (PENDING, FAILED)

# What the log may hold.
LOG_STAGES = ("download", "transcribe", "clean", "summarize", "process")
LOG_STATUSES = ("started", "success", "error", "warning")

PRIMARY_KEYS = {
    "feeds": "id",
    "episodes": "id",
    "processing_status": "episode_id",
    "transcripts": "id",
    "summaries": "id",
    "processing_logs": "id",
    "metadata": "key",
}
UNIQUE = {"feeds": ["url"], "episodes": ["guid"]}
NOT_NULL = {
    "feeds": ["name", "url"],
    "episodes": ["feed_id", "title", "audio_url"],
    "processing_status": ["status"],
    "transcripts": ["episode_id"],
    "summaries": ["episode_id"],
    "processing_logs": ["stage", "status"],
    "metadata": ["value"],
}
# child table -> (child column, parent table, parent column)
FOREIGN_KEYS = {
    "episodes": ("feed_id", "feeds", "id"),
    "processing_status": ("episode_id", "episodes", "id"),
    "transcripts": ("episode_id", "episodes", "id"),
    "summaries": ("episode_id", "episodes", "id"),
    "processing_logs": ("episode_id", "episodes", "id"),
}
DOMAINS = {
    "processing_status": {"status": STATUSES},
    "processing_logs": {"stage": LOG_STAGES, "status": LOG_STATUSES},
}
