"""Filters, joins, aggregates, windows and limits over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions import digest as fd
from feedlake.functions import feeds as ff
from feedlake.operators import aggregates as agg
from feedlake.operators import checks, digests, joins, ordering, state
from feedlake.sources import outlines

from .registry import query
from .views import AS_OF, DAYS, Tables, sql

LOOKED_UP = "SELECT DISTINCT user_id FROM events"


def looked_up(t: Tables) -> DataFrame:
    """Ids to look up: the items that the log mentions."""
    return t.given("events").select(F.col("user_id").alias("episode_id")).distinct()


@query("s6_table_scan", sql("SELECT id, feed_id, title, published_date, duration_seconds, guid FROM episodes", "episodes"))
def table_scan(t):
    return t.episodes.select("id", "feed_id", "title", "published_date", "duration_seconds", "guid")


@query("f1_enabled_feeds", sql("SELECT id, name, url, last_checked FROM feeds WHERE enabled", "feeds"))
def enabled_feeds(t):
    return joins.enabled_feeds(t.feeds)


OUTLINES = """SELECT c_custkey AS id,
    CASE c_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_name END AS text,
    CASE c_nationkey % 2 WHEN 0 THEN c_mktsegment ELSE '' END AS title,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'rss' WHEN 'MACHINERY' THEN 'link' WHEN 'BUILDING' THEN ''
        WHEN 'AUTOMOBILE' THEN 'video' END AS type,
    CASE WHEN c_nationkey % 4 = 0 THEN concat('https://RSS.example.com/', c_custkey)
        ELSE concat('https://feeds.example.com/', c_custkey) END AS url"""


def outline_attributes(t: Tables) -> DataFrame:
    return t.given("customer").selectExpr(*_columns(OUTLINES))


def _columns(select: str) -> list[str]:
    """Select list of a one-level SELECT, split at the commas outside brackets."""
    columns, depth, start = [], 0, 0
    body = select.strip()[len("SELECT"):]
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            columns.append(body[start:i].strip())
            start = i + 1
    return [*columns, body[start:].strip()]


@query("f2_feed_types", f"""SELECT id, type, url FROM ({OUTLINES} FROM customer)
    WHERE coalesce(type, '') IN ('rss', 'link', '') OR contains(lower(url), 'rss')""")
def feed_types(t):
    return outline_attributes(t).filter(ff.is_feed("type", "url")).select("id", "type", "url")


@query("x5_feed_names", f"""SELECT id, coalesce(nullif(text, ''), nullif(title, ''), 'Unnamed Feed') AS name
    FROM ({OUTLINES} FROM customer)""")
def feed_names(t):
    return outline_attributes(t).select("id", ff.feed_name("text", "title").alias("name"))


RAW_FEEDS = """SELECT c_custkey AS id,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN '' WHEN 'MACHINERY' THEN NULL ELSE c_name END AS name,
    CASE c_nationkey % 6 WHEN 0 THEN concat('  https://feeds.example.com/', c_custkey, '  ') WHEN 1 THEN NULL WHEN 2 THEN ''
        WHEN 3 THEN concat('ftp://feeds.example.com/', c_custkey) WHEN 4 THEN concat('httpx://feeds.example.com/', c_custkey)
        ELSE concat('https://feeds.example.com/', c_custkey) END AS url"""


@query("f3_valid_feeds", f"""SELECT id, coalesce(nullif(name, ''), 'Feed from ' || url) AS name, trim(url) AS url
    FROM ({RAW_FEEDS} FROM customer) WHERE coalesce(url, '') <> '' AND starts_with(trim(url), 'http')""")
def valid_feeds(t):
    return outlines.valid_feeds(t.given("customer").selectExpr(*_columns(RAW_FEEDS)))


@query("f4_age_filter", sql(f"""SELECT id, published_date FROM (
        SELECT id, CASE WHEN starts_with(title, '5-LOW') THEN NULL ELSE published_date END AS published_date FROM episodes)
    WHERE published_date IS NULL OR published_date >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY""", "episodes"))
def age_filter(t):
    dated = t.episodes.select("id", F.when(~F.startswith("title", F.lit("5-LOW")), F.col("published_date")).alias("published_date"))
    return dated.filter(joins.recent_enough("published_date", AS_OF, 365))


@query("f5_retryable", sql("SELECT episode_id, status FROM status_rows WHERE status IN ('pending', 'failed')", "status_rows"))
def retryable(t):
    return joins.retryable(t.status).select("episode_id", "status")


@query("f6_status_filter", sql("SELECT episode_id, status, completed_at FROM status_rows WHERE status = 'completed'", "status_rows"))
def status_filter(t):
    return joins.with_status(t.status, "completed").select("episode_id", "status", "completed_at")


@query("f7_episode_lookup", sql(f"SELECT id AS episode_id, title, audio_url FROM episodes WHERE id IN ({LOOKED_UP})", "episodes"))
def episode_lookup(t):
    return joins.episode_info(t.episodes, looked_up(t))


@query("f7_status_lookup", sql(f"""SELECT episode_id, status, audio_path, raw_transcript_path, cleaned_transcript_path, summary_path,
    error_message, started_at, completed_at FROM status_rows WHERE episode_id IN ({LOOKED_UP})""", "status_rows"))
def status_lookup(t):
    return joins.status_of(t.status, looked_up(t))


@query("f7_transcript_lookup", sql(f"""SELECT episode_id, raw_text, cleaned_text, transcription_model, cleaning_model
    FROM transcripts WHERE episode_id IN ({LOOKED_UP})""", "transcripts"))
def transcript_lookup(t):
    return joins.transcript_of(t.transcripts, looked_up(t))


@query("f8_known_guids", sql("SELECT feed_id, guid FROM known", "known"))
def known_guids(t):
    return joins.known_guids(t.known)


@query("f10_shown_feeds", sql("""SELECT id, name, CASE WHEN length(url) > 50 THEN substr(url, 1, 50) || '...' ELSE url END AS url,
    coalesce(strftime(last_checked, '%Y-%m-%d %H:%M:%S'), 'Never') AS last_checked
    FROM (SELECT id, name, url || '/' || name || '/feed' AS url, CASE WHEN enabled THEN created_at END AS last_checked FROM feeds)""",
                              "feeds"))
def shown_feeds(t):
    longer = F.concat("url", F.lit("/"), "name", F.lit("/feed"))
    checked = F.when(F.col("enabled"), F.col("created_at"))
    return joins.shown_feeds(t.feeds.withColumn("url", longer).withColumn("last_checked", checked))


@query("f10_shown_episodes", """SELECT doc_id AS id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS title,
    CASE WHEN lang = 'fr' THEN 'None' ELSE '2024-03-05' END AS published, lang AS status FROM documents""")
def shown_episodes(t):
    date = F.when(F.col("lang") != "fr", F.lit("2024-03-05 10:00:00").cast("timestamp_ntz"))
    return joins.shown_episodes(t.given("documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("title"), date.alias("published_date"), F.col("lang").alias("status")))


# Written from the definition: an item is waiting while every state row of it says so.
QUEUE = """WITH open_states AS (SELECT episode_id AS id, any_value(status) AS status FROM status_rows
        GROUP BY episode_id HAVING bool_and(status = 'failed' OR status = 'pending'))
    SELECT id, feed_id, title, audio_url, published_date, status FROM open_states NATURAL JOIN (SELECT * FROM episodes)
    ORDER BY published_date DESC, id"""


@query("j1_pending_queue", sql(QUEUE, "episodes", "status_rows"))
def pending_queue(t):
    return joins.pending_queue(t.episodes, t.status)


@query("t1_newest_pending", sql(f"{QUEUE} LIMIT 100", "episodes", "status_rows"))
def newest_pending(t):
    return joins.pending_queue(t.episodes, t.status, 100)


@query("t2_run_queue", sql(f"{QUEUE} LIMIT 5", "episodes", "status_rows"))
def run_queue(t):
    return joins.run_queue(t.episodes, t.status, 0)


LISTING = """SELECT e.id, e.title, e.published_date, s.status FROM episodes e JOIN status_rows s ON e.id = s.episode_id"""


@query("j2_listing", sql(f"{LISTING} WHERE s.status = 'completed'", "episodes", "status_rows"))
def listing(t):
    return joins.listing(t.episodes, t.status, "completed", None)


@query("t3_newest_listing", sql(f"{LISTING} ORDER BY e.published_date DESC, e.id LIMIT 10", "episodes", "status_rows"))
def newest_listing(t):
    return joins.listing(t.episodes, t.status)


# Written from the definition: items whose completion is no older than the period, looked up with their feed's name.
DIGEST_BASE = f"""SELECT item.id, item.title, item.published_date, (SELECT name FROM feeds WHERE id = item.feed_id) AS feed_name,
        finished.completed_at, finished.summary_path
    FROM (SELECT * FROM status_rows WHERE date_diff('microsecond', completed_at, TIMESTAMP '{AS_OF}') <= {DAYS} * 86400000000
          AND status = 'completed') finished
    JOIN episodes item ON finished.episode_id = item.id WHERE item.feed_id IN (SELECT id FROM feeds)"""


def digest_base_of(t: Tables) -> DataFrame:
    return joins.digest_base(t.episodes, t.feeds, t.status, AS_OF, DAYS)


@query("j3_digest_base", sql(DIGEST_BASE, "episodes", "feeds", "status_rows"))
def digest_base(t):
    return digest_base_of(t)


@query("t4_digest_order", sql(f"""SELECT id, completed_at, row_number() OVER (ORDER BY completed_at DESC, id) - 1 AS position
    FROM ({DIGEST_BASE})""", "episodes", "feeds", "status_rows"))
def digest_order(t):
    # The order made visible as a number, so that it can be compared.
    return digests.positioned(digest_base_of(t)).select("id", "completed_at", "position")


@query("w3_positions", sql("""SELECT id, completed_at, row_number() OVER (ORDER BY completed_at DESC, id) AS position
    FROM (SELECT episode_id AS id, completed_at FROM status_rows WHERE status = 'completed')""", "status_rows"))
def positions(t):
    done = joins.with_status(t.status, "completed").select(F.col("episode_id").alias("id"), "completed_at")
    return ordering.with_position(done, F.col("completed_at").desc(), "id")


@query("j4_new_items", sql("SELECT feed_id, pos, guid FROM items WHERE guid NOT IN (SELECT guid FROM known)", "known"))
def new_items(t):
    return joins.new_items(t.items, t.known).select("feed_id", "pos", "guid")


@query("j5_existing", sql("""SELECT DISTINCT guid, guid IN (SELECT guid FROM known) AS episode_exists FROM items""", "known"))
def existing(t):
    return joins.existing(t.items, t.known)


@query("j6_now_enabled", sql("""SELECT pos, name, url FROM feed_batch
    WHERE url IN (SELECT url FROM feeds WHERE enabled)""", "feed_batch", "feeds"))
def now_enabled(t):
    return joins.now_enabled(t.feed_batch.select("pos", "name", "url"), t.feeds)


@query("j7_digest_summaries", sql(f"""SELECT b.id, b.feed_name, d.source AS host_and_guest, d.text AS comprehensive_summary
    FROM ({DIGEST_BASE}) b LEFT JOIN documents d ON b.id = d.doc_id""", "episodes", "feeds", "status_rows"))
def digest_summaries(t):
    joined = digests.with_summary(digest_base_of(t), t.summaries)
    return joined.select("id", "feed_name", "summary.host_and_guest", "summary.comprehensive_summary")


@query("j8_orphans", sql("""SELECT episode_id, status FROM status_rows WHERE episode_id NOT IN (SELECT id FROM known)""",
                         "status_rows", "known"))
def orphans(t):
    return checks.orphans(t.status.select("episode_id", "status"), "episode_id", t.known, "id")


@query("a1_processing_stats", sql("""WITH by_state AS (SELECT status, count(*) AS n FROM status_rows GROUP BY status)
    SELECT CAST(sum(n) AS BIGINT) AS total_episodes, CAST(coalesce(sum(n) FILTER (status = 'completed'), 0) AS BIGINT) AS completed,
        CAST(coalesce(sum(n) FILTER (status = 'failed'), 0) AS BIGINT) AS failed, CAST(coalesce(sum(n) FILTER (status = 'pending'), 0) AS BIGINT) AS pending,
        CAST(coalesce(sum(n) FILTER (status NOT IN ('completed', 'failed', 'pending')), 0) AS BIGINT) AS in_progress FROM by_state""", "status_rows"))
def processing_stats(t):
    return agg.processing_stats(t.status)


@query("a2_count", sql("SELECT count(*) AS n FROM known WHERE guid = md5('no such text') OR feed_id = 3", "known"))
def count(t):
    absent = F.md5(F.lit("no such text"))
    return agg.count_where(t.known, (F.col("guid") == absent) | (F.col("feed_id") == 3))


@query("a5_outcomes", sql("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN status = 'completed' THEN 'success' ELSE 'failed' END
    AS outcome FROM status_rows WHERE status IN ('completed', 'failed')) GROUP BY outcome""", "status_rows"))
def outcomes(t):
    ended = t.status.filter(F.col("status").isin("completed", "failed"))
    return agg.outcome_counts(ended.select(F.when(F.col("status") == "completed", "success").otherwise("failed").alias("outcome")))


@query("a6_date_range", sql("""SELECT count(*) AS n, CASE WHEN CAST(min(completed_at) AS DATE) = CAST(max(completed_at) AS DATE)
    THEN strftime(min(completed_at), '%B %d, %Y')
    ELSE strftime(min(completed_at), '%B %d') || ' - ' || strftime(max(completed_at), '%B %d, %Y') END AS date_range
    FROM status_rows WHERE status = 'completed'""", "status_rows"))
def date_range(t):
    return agg.digest_heading(joins.with_status(t.status, "completed")).select("n", "date_range")


@query("a7_counted", """SELECT o_custkey AS feed_id, count(*) || CASE WHEN count(*) = 1 THEN ' episode' ELSE ' episodes' END
    || ' processed this week' AS counted FROM orders GROUP BY o_custkey""")
def counted(t):
    per_feed = t.episodes.groupBy("feed_id").agg(F.count("*").alias("n"))
    return per_feed.select("feed_id", fd.counted("n").alias("counted"))


@query("a8_time_coded_parts", sql("""SELECT episode_id, id // 4 AS part_no, string_agg(printf('[%02d:%02d:%02d] ',
    CAST(floor(start / 3600) AS BIGINT), CAST(floor(start / 60) AS BIGINT) % 60, CAST(floor(start) AS BIGINT) % 60) || text,
    chr(10) ORDER BY id) AS text FROM segments GROUP BY episode_id, id // 4""", "segments"))
def time_coded_parts(t):
    return agg.time_coded_parts(t.segments, lines_per_part=4)


@query("a9_text_lengths", sql("""SELECT transcription_model, count(*) AS n, CAST(sum(length(raw_text)) AS BIGINT) AS raw_chars,
    CAST(sum(length(cleaned_text)) AS BIGINT) AS cleaned_chars, avg(length(raw_text)) AS avg_raw_chars
    FROM transcripts GROUP BY transcription_model""", "transcripts"))
def text_lengths(t):
    return agg.text_lengths(t.transcripts, "transcription_model")


@query("a10_repeated_keys", sql("SELECT guid, count(*) AS n FROM items WHERE guid IS NOT NULL GROUP BY guid HAVING count(*) > 1", "items"))
def repeated_keys(t):
    return checks.repeated_keys(t.items, "guid")


@query("u9_violations", sql("""WITH rules AS (
    SELECT 'feeds' AS table_name, 'id is set' AS rule, count(*) FILTER (WHERE id IS NULL) AS violations FROM feeds
    UNION ALL SELECT 'feeds', 'name is set', count(*) FILTER (WHERE name IS NULL) FROM feeds
    UNION ALL SELECT 'feeds', 'url is set', count(*) FILTER (WHERE url IS NULL) FROM feeds
    UNION ALL SELECT 'feeds', 'id is unique', count(*) FROM (SELECT id FROM feeds GROUP BY id HAVING count(*) > 1)
    UNION ALL SELECT 'feeds', 'url is unique', count(*) FROM (SELECT url FROM feeds GROUP BY url HAVING count(*) > 1)
    UNION ALL SELECT 'episodes', 'id is set', count(*) FILTER (WHERE id IS NULL) FROM known
    UNION ALL SELECT 'episodes', 'feed_id is set', count(*) FILTER (WHERE feed_id IS NULL) FROM known
    UNION ALL SELECT 'episodes', 'title is set', count(*) FILTER (WHERE title IS NULL) FROM known
    UNION ALL SELECT 'episodes', 'audio_url is set', count(*) FILTER (WHERE audio_url IS NULL) FROM known
    UNION ALL SELECT 'episodes', 'id is unique', count(*) FROM (SELECT id FROM known GROUP BY id HAVING count(*) > 1)
    UNION ALL SELECT 'episodes', 'guid is unique', count(*) FROM (SELECT guid FROM known GROUP BY guid HAVING count(*) > 1)
    UNION ALL SELECT 'episodes', 'feed_id is in feeds', count(*) FROM known WHERE feed_id NOT IN (SELECT id FROM feeds)
    UNION ALL SELECT 'processing_logs', 'id is set', count(*) FILTER (WHERE id IS NULL) FROM logs
    UNION ALL SELECT 'processing_logs', 'stage is set', count(*) FILTER (WHERE stage IS NULL) FROM logs
    UNION ALL SELECT 'processing_logs', 'status is set', count(*) FILTER (WHERE status IS NULL) FROM logs
    UNION ALL SELECT 'processing_logs', 'stage in domain', count(*) FILTER (WHERE stage NOT IN
        ('download', 'transcribe', 'clean', 'summarize', 'process')) FROM logs
    UNION ALL SELECT 'processing_logs', 'status in domain', count(*) FILTER (WHERE status NOT IN
        ('started', 'success', 'error', 'warning')) FROM logs
    UNION ALL SELECT 'processing_logs', 'id is unique', count(*) FROM (SELECT id FROM logs GROUP BY id HAVING count(*) > 1)
    UNION ALL SELECT 'processing_logs', 'episode_id is in episodes', count(*) FROM logs WHERE episode_id NOT IN (SELECT id FROM known))
    SELECT * FROM rules""", "feeds", "known", "logs"))
def violations(t):
    return checks.violations({"feeds": t.feeds, "episodes": t.known, "processing_logs": t.logs})


@query("w1_first_per_guid", sql("""SELECT feed_id, pos, guid FROM (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY feed_id, pos) AS rn
    FROM items) WHERE rn = 1""", "items"))
def first_per_guid(t):
    return state.first_per_key(t.items, "guid", "feed_id", "pos").select("feed_id", "pos", "guid")


@query("w2_latest_summaries", """SELECT doc_id * 2 + 1 AS id, doc_id AS episode_id, text AS comprehensive_summary, 'new' AS model_used
    FROM documents""")
def latest_summaries(t):
    return state.latest_summaries(t.summaries).select("id", "episode_id", "comprehensive_summary", "model_used")


@query("w2_latest_transcripts", """SELECT doc_id AS episode_id, CASE WHEN lang = 'en' THEN 'second' ELSE text END AS raw_text FROM documents""")
def latest_transcripts(t):
    # English transcripts have a second row with a smaller id, but a later time.
    later = F.lit("2024-01-02").cast("timestamp_ntz")
    again = t.transcripts.filter("transcription_model = 'en'").withColumn("id", -F.col("id")).withColumn("raw_text", F.lit("second"))
    both = t.transcripts.unionByName(again.withColumn("updated_at", later))
    return state.latest_transcripts(both).select("episode_id", "raw_text")


@query("w4_first_and_last", sql("""SELECT url, min(pos) AS first_pos, first(name ORDER BY pos) AS first_name,
    last(name ORDER BY pos) AS last_name, count(*) AS n_rows FROM feed_batch GROUP BY url""", "feed_batch"))
def first_and_last(t):
    return state.first_and_last(t.feed_batch, "url", "pos", "name")


RUNS = """SELECT id, episode_id, stage, started_at, CASE WHEN ended THEN nxt END AS result, CASE WHEN ended THEN nxt_ts END AS finished_at,
    CASE WHEN ended THEN (epoch_us(nxt_ts) - epoch_us(started_at)) // 1000000 END AS seconds
    FROM (SELECT id, episode_id, stage, status, "timestamp" AS started_at, lead(status) OVER w AS nxt, lead("timestamp") OVER w AS nxt_ts,
        coalesce(lead(status) OVER w IN ('success', 'error'), false) AS ended FROM logs
        WINDOW w AS (PARTITION BY episode_id, stage ORDER BY "timestamp", id)) WHERE status = 'started'"""


@query("w5_stage_runs", sql(RUNS, "logs"))
def stage_runs(t):
    return agg.stage_runs(t.logs)


@query("w5_stage_runs_sliced", sql(RUNS, "logs"))
def stage_runs_sliced(t):
    # The same plan: the log is always cut into slices, however long the log of one item is.
    return agg.stage_runs(t.logs)


@query("w5_stage_report", sql(f"""SELECT stage, count(*) AS attempts, count(*) FILTER (WHERE result = 'success') AS succeeded,
    count(*) FILTER (WHERE result = 'error') AS failed, CAST(sum(seconds) AS BIGINT) AS seconds FROM ({RUNS}) GROUP BY stage""", "logs"))
def stage_report(t):
    return agg.stage_report(agg.stage_runs(t.logs))
