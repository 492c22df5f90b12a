"""Table updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions import summaries as fs
from feedlake.operators import aggregates as agg
from feedlake.operators import state
from feedlake.schemas import TABLES
from feedlake.sinks.keyed import KeyedTable
from feedlake.storage import fresh_dir

from .registry import SQL, query
from .views import AS_OF, Tables, sql

NOW = f"TIMESTAMP '{AS_OF}'"


def single_feeds(t: Tables) -> DataFrame:
    """A batch with one row per address and its own enabled flag: suppliers take over known addresses or get new ones."""
    return t.given("supplier").select(
        F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"),
        F.expr("concat('https://feeds.example.com/', if(s_acctbal >= 5000, cast(s_suppkey AS STRING), concat('s', s_suppkey)))").alias("url"),
        (F.col("s_nationkey") > 5).alias("enabled"),
    )


SINGLE = """SELECT s_suppkey AS pos, s_name AS name, 'https://feeds.example.com/' ||
    CASE WHEN s_acctbal >= 5000 THEN '' || s_suppkey ELSE 's' || s_suppkey END AS url, s_nationkey > 5 AS enabled FROM supplier"""
UPSERT = f"""WITH once AS (SELECT url, min(pos) AS first_pos, last(name ORDER BY pos) AS name, last(enabled ORDER BY pos) AS enabled
        FROM batch WHERE coalesce(url, '') <> '' GROUP BY url),
    added AS (SELECT (SELECT max(id) FROM feeds) + row_number() OVER (ORDER BY first_pos) AS id, name, url, enabled
        FROM once WHERE url NOT IN (SELECT url FROM feeds))
    SELECT f.id, coalesce(o.name, f.name) AS name, f.url, CASE WHEN o.url IS NULL THEN f.enabled ELSE o.enabled END AS enabled,
        f.last_checked, f.created_at FROM feeds f LEFT JOIN once o USING (url)
    UNION ALL SELECT id, name, url, enabled, NULL, {NOW} FROM added"""


def _with_batch(batch: str, body: str) -> str:
    return body.replace("WITH ", f"WITH batch AS ({batch}), ", 1)


@query("u1_upsert_feeds", sql(_with_batch(SINGLE, UPSERT), "feeds"))
def upsert_feeds(t):
    return state.upsert_feeds(t.feeds, state.feed_outcomes(t.feeds, single_feeds(t)), AS_OF)


@query("u2_import_feeds", sql(_with_batch("SELECT * FROM feed_batch", UPSERT), "feeds", "feed_batch"))
def import_feeds(t):
    return state.upsert_feeds(t.feeds, state.feed_outcomes(t.feeds, t.feed_batch), AS_OF)


@query("a4_import_counts", sql("""SELECT count(DISTINCT CASE WHEN url <> '' AND url NOT IN (SELECT url FROM feeds) THEN url END) AS added,
    count(*) - count(DISTINCT CASE WHEN url <> '' AND url NOT IN (SELECT url FROM feeds) THEN url END) AS skipped
    FROM feed_batch""", "feeds", "feed_batch"))
def import_counts(t):
    return agg.import_counts(state.feed_outcomes(t.feeds, t.feed_batch))


FRESH = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY feed_id, pos) AS rn FROM items
    WHERE feed_id IN (SELECT id FROM feeds)) WHERE rn = 1 AND guid NOT IN (SELECT guid FROM known)"""
INSERTED = f"""SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY feed_id, pos) AS id, feed_id, title, description,
    audio_url, published_date, duration_seconds, guid, {NOW} AS created_at FROM ({FRESH})"""


def inserted(t: Tables, ids: str = "sequence") -> DataFrame:
    return state.insert_items(t.known, t.items, t.feeds, AS_OF, ids=ids)


@query("u3_insert_items", sql(INSERTED, "feeds", "known"))
def insert_items(t):
    return inserted(t)


@query("u3_first_status", sql(f"""SELECT id AS episode_id, 'pending' AS status, {NOW} AS started_at, {NOW} AS updated_at
    FROM ({INSERTED})""", "feeds", "known"))
def first_status(t):
    return state.first_status(inserted(t), AS_OF)


@query("u8_hash_ids", sql(f"SELECT feed_id, title, guid, true AS has_id FROM ({FRESH})", "feeds", "known"))
def hash_ids(t):
    # Hash values differ between engines: only that every row has one is compared.
    return inserted(t, "hash").select("feed_id", "title", "guid", F.col("id").isNotNull().alias("has_id"))


@query("u8_unique_hash_ids", sql(f"SELECT count(*) AS n, count(*) AS ids, CAST(0 AS BIGINT) AS shared, true AS stable FROM ({FRESH})", "feeds", "known"))
def unique_hash_ids(t):
    """No two new rows share an id, none has that of a stored row, and a second load gives each row the same id."""
    new, again = inserted(t, "hash").select("id", "guid"), inserted(t, "hash").select(F.col("id").alias("again"), F.col("guid").alias("same"))
    stored = t.known.select(F.col("id").alias("stored"))
    both = new.join(again, F.col("guid") == F.col("same")).join(stored, F.col("id") == F.col("stored"), "left")
    return both.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count("stored").alias("shared"),
                    F.bool_and(F.col("id") == F.col("again")).alias("stable"))


@query("u8_sequence_ids", sql("""SELECT guid, (SELECT max(id) FROM episodes) + row_number() OVER (ORDER BY feed_id, pos) AS id
    FROM items""", "episodes", "items"))
def sequence_ids(t):
    return state.with_new_ids(t.items, state.last_id(t.episodes), "feed_id", "pos").select("guid", "id")


@query("o1_append", sql(f"""SELECT id, guid, duration_seconds FROM known
    UNION ALL SELECT id, guid, duration_seconds FROM ({INSERTED})""", "feeds", "known"))
def append(t):
    return state.append(t.known, inserted(t)).select("id", "guid", "duration_seconds")


@query("a3_sync_totals", sql(f"SELECT feed_id, count(*) AS new_episodes FROM ({FRESH}) GROUP BY ROLLUP (feed_id)", "feeds", "known"))
def sync_totals(t):
    return agg.sync_totals(inserted(t))


@query("u4_stamp_checked", sql(f"""SELECT id, name, url, enabled, CASE WHEN id IN (SELECT feed_id FROM items) THEN {NOW}
    ELSE last_checked END AS last_checked, created_at FROM feeds""", "feeds", "items"))
def stamp_checked(t):
    return state.stamp_checked(t.feeds, t.items.select(F.col("feed_id").alias("id")), AS_OF)


PATHS = ("audio_path", "raw_transcript_path", "cleaned_transcript_path", "summary_path")


@query("u5_update_status", sql(f"""WITH changes AS (SELECT episode_id, last(status ORDER BY "at", seq) AS status, max("at") AS updated_at,
        max("at") FILTER (WHERE status = 'completed') AS completed_at,
        last(error_message ORDER BY "at", seq) FILTER (WHERE error_message <> '') AS error_message,
        {", ".join(f'last({p} ORDER BY "at", seq) FILTER (WHERE {p} IS NOT NULL) AS {p}' for p in PATHS)}
        FROM updates GROUP BY episode_id)
    SELECT s.episode_id, s.started_at, {", ".join(f"coalesce(c.{c}, s.{c}) AS {c}" for c in
        ("status", *PATHS, "error_message", "completed_at", "updated_at"))}
    FROM status_rows s LEFT JOIN changes c USING (episode_id)""", "status_rows", "updates"))
def update_status(t):
    return state.update_status(t.status, t.updates)


SAVES = """SELECT user_id * 10 AS episode_id, CASE event_type WHEN 'view' THEN props WHEN 'error' THEN '' END AS raw_text,
    CASE event_type WHEN 'click' THEN props WHEN 'signup' THEN '' END AS cleaned_text,
    CASE WHEN event_type = 'view' THEN event_type END AS transcription_model,
    CASE WHEN event_type = 'click' THEN event_type END AS cleaning_model, ts AS "at", event_id AS seq FROM events"""


@query("u6_save_transcripts", sql(f"""WITH saves AS ({SAVES}), changes AS (SELECT episode_id, min("at") AS first_at, max("at") AS last_at,
        first(seq ORDER BY "at", seq) AS first_seq,
        {", ".join(f'last({f} ORDER BY "at", seq) FILTER (WHERE {f} IS NOT NULL) AS {f}' for f in state.TRANSCRIPT_FIELDS)}
        FROM saves GROUP BY episode_id),
    added AS (SELECT episode_id, (SELECT max(id) FROM transcripts) + row_number() OVER (ORDER BY first_at, first_seq, episode_id) AS new_id
        FROM changes WHERE episode_id NOT IN (SELECT episode_id FROM transcripts))
    SELECT episode_id, coalesce(o.id, a.new_id) AS id, coalesce(o.created_at, c.first_at) AS created_at,
        coalesce(c.last_at, o.updated_at) AS updated_at, {", ".join(f"coalesce(c.{f}, o.{f}) AS {f}" for f in state.TRANSCRIPT_FIELDS)}
    FROM transcripts o FULL JOIN changes c USING (episode_id) LEFT JOIN added a USING (episode_id)""", "transcripts"))
def save_transcripts(t):
    return state.save_transcripts(t.transcripts, saved_texts(t))


def saved_texts(t: Tables) -> DataFrame:
    """Texts to save, many per item, out of the events."""
    def when(**values: str) -> str:
        return "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"

    return t.given("events").selectExpr(
        "user_id * 10 AS episode_id", when(view="props", error="''") + " AS raw_text", when(click="props", signup="''") + " AS cleaned_text",
        when(view="event_type") + " AS transcription_model", when(click="event_type") + " AS cleaning_model",
        "ts AS at", "event_id AS seq")


@query("u7_save_summaries", f"""WITH old AS (SELECT doc_id * 2 + n AS id, doc_id, CASE n WHEN 0 THEN 'old' ELSE 'new' END AS model_used,
        CASE n WHEN 0 THEN 'outdated' ELSE text END AS overview, CASE n WHEN 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS created_at
        FROM documents, (SELECT unnest([0, 1]) AS n)),
    every AS (SELECT * FROM old UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY doc_id), doc_id, 'again', text, {NOW} FROM documents)
    SELECT id, doc_id AS episode_id, model_used, created_at, source AS host_and_guest, overview AS comprehensive_summary,
        '["seen in ' || source || '","said in ' || lang || '"]' AS noteworthy_observations,
        '[{{"thesis":"a < b & c ' || doc_id || '","reasoning":"' || lang || '","risks":"' || CASE WHEN lang = 'de' THEN 'high' ELSE '' END || '"}}]' AS investment_theses,
        CAST(6 AS BIGINT) AS topics, CAST(4 AS BIGINT) AS quotes, CAST(6 AS BIGINT) AS companies FROM every JOIN documents USING (doc_id)""")
def save_summaries(t):
    saved = fs.storable(t.summary_structs).withColumn("model_used", F.lit("again"))
    both = state.append(t.summaries, state.save_summaries(t.summaries, saved, AS_OF))
    sizes = [F.size(fs.decode_array(c, c)).cast("bigint").alias(n) for c, n in (("key_topics", "topics"), ("actionable_quotes", "quotes"), ("company_mentions", "companies"))]
    return both.select("id", "episode_id", "model_used", "created_at", "host_and_guest", "comprehensive_summary", "noteworthy_observations", "investment_theses", *sizes)


# --- tables that are merged on read -------------------------------------------------------------------------------------------


def in_three(rows: DataFrame, order: str) -> list[DataFrame]:
    """The rows as three batches, one after another by a column."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    bounds = [low + (high - low) * i / 3 for i in (1, 2)] if not isinstance(low, int) else [low + (high - low) * i // 3 for i in (1, 2)]
    first, last = F.col(order) < F.lit(bounds[0]), F.col(order) >= F.lit(bounds[1])
    return [rows.filter(first), rows.filter(~first & ~last), rows.filter(last)]


def keyed(t: Tables, name: str, key: str, rows: DataFrame) -> KeyedTable:
    table = KeyedTable(t.spark, fresh_dir(t.spark, name), TABLES[name], key)
    table.create(rows)
    return table


@query("u1_feed_batches", sql(_with_batch("SELECT * FROM feed_batch", UPSERT), "feeds", "feed_batch"))
def feed_batches(t):
    table = keyed(t, "feeds", "url", t.feeds)
    for order, batch in enumerate(in_three(t.feed_batch, "pos"), 1):
        state.take_feeds(table, batch, order, AS_OF)
    return table.read().select("id", "name", "url", "enabled", "last_checked", "created_at")


@query("u5_status_batches", SQL["u5_update_status"])
def status_batches(t):
    table = keyed(t, "processing_status", "episode_id", t.status)
    for order, batch in enumerate(in_three(t.updates, "at"), 1):
        state.take_status(table, batch, order)
    return table.read()


@query("u6_transcript_batches", SQL["u6_save_transcripts"])
def transcript_batches(t):
    table = keyed(t, "transcripts", "episode_id", t.transcripts)
    for order, batch in enumerate(in_three(saved_texts(t), "at"), 1):
        state.take_transcripts(table, batch, order)
    return table.read()


@query("u6_compacted", SQL["u6_save_transcripts"])
def compacted(t):
    """The same batches, each followed by a compaction; the last one joins all versions, and the replaced files are deleted."""
    table = keyed(t, "transcripts", "episode_id", t.transcripts)
    for order, batch in enumerate(in_three(saved_texts(t), "at"), 1):
        state.take_transcripts(table, batch, order)
        table.compact()
    table.vacuum()
    return table.read()
