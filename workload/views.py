"""The given tables in the roles of the feed model, once for Spark and once as SQL.

Both forms of a view must give the same rows. All views are row-by-row projections, so they grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions import summaries as fs
from feedlake.schemas import SUMMARY
from feedlake.storage import spread

AS_OF = "2001-08-01 00:00:00"
DAYS = 200


class Tables:
    """Given tables and views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        """Documents for steps that work long on each text."""
        return spread(self.given("documents"), "doc_id", self.partitions)

    @property
    def partitions(self) -> int:
        """The given tables are single files; steps that are long per row are dealt out over this many tasks."""
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def stream(self, name: str) -> DataFrame:
        # The bracket makes the path a pattern, which the file stream needs when the table is a single file.
        return self.spark.readStream.schema(self.given(name).schema).parquet(f"{self.folder}/{name[:-1]}[{name[-1]}].parquet")

    @property
    def feeds(self) -> DataFrame:
        return self.given("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
            F.concat(F.lit("https://feeds.example.com/"), F.col("c_custkey").cast("string")).alias("url"),
            (F.col("c_acctbal") >= 0).alias("enabled"),
            F.lit(None).cast("timestamp_ntz").alias("last_checked"),
            F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"),
        )

    @property
    def episodes(self) -> DataFrame:
        key = F.col("o_orderkey").cast("string")
        return self.given("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("feed_id"),
            F.concat("o_orderpriority", F.lit(" "), key).alias("title"),
            F.lit("").alias("description"),
            F.concat(F.lit("https://media.example.com/"), key, F.lit(".mp3")).alias("audio_url"),
            F.col("o_orderdate").alias("published_date"),
            F.floor("o_totalprice").cast("int").alias("duration_seconds"),
            F.concat(F.lit("guid-"), key).alias("guid"),
            F.col("o_orderdate").alias("created_at"),
        )

    @property
    def status(self) -> DataFrame:
        return status_of_orders(self.given("orders"))

    @property
    def logs(self) -> DataFrame:
        return logs_of_events(self.given("events"))

    @property
    def updates(self) -> DataFrame:
        """Status changes, many per item, out of the log events."""
        return self.logs.select(
            "episode_id",
            F.expr("CASE stage WHEN 'download' THEN 'downloading' WHEN 'transcribe' THEN 'transcribing' "
                   "WHEN 'clean' THEN 'cleaning' WHEN 'summarize' THEN 'completed' ELSE 'failed' END").alias("status"),
            F.expr("CASE stage WHEN 'process' THEN message WHEN 'clean' THEN '' END").alias("error_message"),
            F.expr("CASE WHEN stage = 'download' AND status <> 'error' THEN concat('audio/', id) END").alias("audio_path"),
            F.expr("CASE WHEN stage = 'transcribe' AND status <> 'error' THEN concat('raw/', id) END").alias("raw_transcript_path"),
            F.expr("CASE WHEN stage = 'clean' AND status <> 'error' THEN concat('clean/', id) END").alias("cleaned_transcript_path"),
            F.expr("CASE WHEN stage = 'summarize' AND status <> 'error' THEN concat('summary/', id) END").alias("summary_path"),
            F.col("timestamp").alias("at"), F.col("id").alias("seq"),
        )

    @property
    def transcripts(self) -> DataFrame:
        stamp = F.lit("2024-01-01").cast("timestamp_ntz")
        return self.given("documents").select(
            F.col("doc_id").alias("id"), F.col("doc_id").alias("episode_id"), F.col("text").alias("raw_text"),
            F.when(F.col("lang") == "en", F.col("text")).alias("cleaned_text"),
            F.col("lang").alias("transcription_model"), F.col("source").alias("cleaning_model"),
            stamp.alias("created_at"), stamp.alias("updated_at"),
        )

    @property
    def items(self) -> DataFrame:
        """Feed items whose guids repeat, within a feed and across feeds."""
        key = F.col("doc_id").cast("string")
        return self.given("documents").select(
            F.expr("cast(substring(source, 4) AS BIGINT)").alias("feed_id"), F.col("doc_id").alias("pos"),
            F.concat(F.lit("Item "), key).alias("title"), F.lit("").alias("description"),
            F.concat(F.lit("https://media.example.com/"), key, F.lit(".mp3")).alias("audio_url"),
            F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, n_chars % 400)").alias("published_date"),
            F.col("n_chars").cast("int").alias("duration_seconds"),
            F.md5(F.encode("text", "UTF-8")).alias("guid"),
        )

    @property
    def known(self) -> DataFrame:
        """Stored episodes with the guids of the documents that carry a good label."""
        good = self.given("labels").filter("quality = 1").select(F.col("doc_id").alias("pos"))
        first = F.lit("2024-01-01").cast("timestamp_ntz")
        return self.items.join(good, "pos", "left_semi").select(
            F.col("pos").alias("id"), "feed_id", "title", "description", "audio_url", "published_date", "duration_seconds",
            "guid", first.alias("created_at"),
        )

    @property
    def segments(self) -> DataFrame:
        return self.given("conversations").select(
            F.col("conv_id").alias("episode_id"), F.col("turn").alias("id"), (F.col("turn") * 37.5).alias("start"), "text",
            F.col("role").alias("speaker"),
        )

    @property
    def summary_structs(self) -> DataFrame:
        """A summary per document with every field filled from its columns; some speakers, risks and details are missing."""
        fields = """named_struct(
          'host_and_guest', source,
          'comprehensive_summary', text,
          'key_topics', transform(sequence(1, 6), k -> named_struct('topic', concat(lang, k), 'description', source)),
          'actionable_quotes', transform(sequence(1, 4), k -> named_struct(
              'quote', concat(k, ' ', text), 'speaker', if(lang = 'en', source, null), 'context', lang)),
          'investment_theses', array(named_struct(
              'thesis', concat('a < b & c ', doc_id), 'reasoning', lang, 'risks', if(lang = 'de', 'high', ''))),
          'noteworthy_observations', array(concat('seen in ', source), concat('said in ', lang)),
          'company_mentions', transform(sequence(1, 6), k -> named_struct('name', concat('Firm ', k), 'industry',
              if(lang = 'fr', null, lang), 'context', source, 'details', if(lang = 'es', 'listed', null))))"""
        return self.documents.select(F.col("doc_id").alias("episode_id"), F.expr(f"cast({fields} AS {SUMMARY})").alias("summary"))

    @property
    def summaries(self) -> DataFrame:
        """Stored summaries: an older row without an overview, then the current one."""
        stored = fs.storable(self.summary_structs)
        old = stored.select(
            (F.col("episode_id") * 2).alias("id"), "*", F.lit("old").alias("model_used"),
            F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"),
        ).withColumn("comprehensive_summary", F.lit("outdated"))
        new = stored.select(
            (F.col("episode_id") * 2 + 1).alias("id"), "*", F.lit("new").alias("model_used"),
            F.lit("2024-01-02").cast("timestamp_ntz").alias("created_at"),
        )
        return old.unionByName(new)

    @property
    def feed_batch(self) -> DataFrame:
        """Feeds to import: known and new addresses, many repeats, some without an address."""
        return self.given("orders").select(
            F.col("o_orderkey").alias("pos"), F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")).alias("name"),
            F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderpriority = '2-HIGH' THEN NULL "
                   "ELSE concat('https://feeds.example.com/', o_custkey * 2) END").alias("url"),
            F.lit(True).alias("enabled"),
        )


def status_of_orders(orders: DataFrame) -> DataFrame:
    text = "string"
    return orders.select(
        F.col("o_orderkey").alias("episode_id"),
        F.expr("CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'failed' ELSE 'completed' END").alias("status"),
        F.concat(F.lit("audio/"), F.col("o_orderkey").cast(text)).alias("audio_path"),
        F.lit(None).cast(text).alias("raw_transcript_path"), F.lit(None).cast(text).alias("cleaned_transcript_path"),
        F.expr("CASE WHEN o_orderstatus = 'O' THEN concat('summaries/', o_orderkey, '_summary.md') END").alias("summary_path"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN 'Transcription failed' END").alias("error_message"),
        F.col("o_orderdate").alias("started_at"),
        F.expr("CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 1 DAY END").alias("completed_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def logs_of_events(events: DataFrame) -> DataFrame:
    k = "cast(get_json_object(props, '$.k') AS BIGINT)"
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("episode_id"),
        F.expr("CASE event_type WHEN 'signup' THEN 'download' WHEN 'view' THEN 'transcribe' WHEN 'click' THEN 'clean' "
               "WHEN 'purchase' THEN 'summarize' ELSE 'process' END").alias("stage"),
        F.expr(f"CASE {k} % 3 WHEN 0 THEN 'started' WHEN 1 THEN 'success' ELSE 'error' END").alias("status"),
        F.col("props").alias("message"), F.col("ts").alias("timestamp"),
    )


SQL_VIEWS = {
    "feeds": """SELECT c_custkey AS id, c_name AS name, 'https://feeds.example.com/' || c_custkey AS url, c_acctbal >= 0 AS enabled,
        CAST(NULL AS TIMESTAMP) AS last_checked, TIMESTAMP '2024-01-01' AS created_at FROM customer""",
    "episodes": """SELECT o_orderkey AS id, o_custkey AS feed_id, o_orderpriority || ' ' || o_orderkey AS title, '' AS description,
        'https://media.example.com/' || o_orderkey || '.mp3' AS audio_url, o_orderdate AS published_date,
        CAST(floor(o_totalprice) AS INTEGER) AS duration_seconds, 'guid-' || o_orderkey AS guid, o_orderdate AS created_at
        FROM orders""",
    "status_rows": """SELECT o_orderkey AS episode_id,
        CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'failed' ELSE 'completed' END AS status,
        'audio/' || o_orderkey AS audio_path, CAST(NULL AS VARCHAR) AS raw_transcript_path,
        CAST(NULL AS VARCHAR) AS cleaned_transcript_path,
        CASE WHEN o_orderstatus = 'O' THEN 'summaries/' || o_orderkey || '_summary.md' END AS summary_path,
        CASE WHEN o_orderstatus = 'F' THEN 'Transcription failed' END AS error_message, o_orderdate AS started_at,
        CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 1 DAY END AS completed_at, o_orderdate AS updated_at
        FROM orders""",
    "logs": """SELECT event_id AS id, user_id AS episode_id,
        CASE event_type WHEN 'signup' THEN 'download' WHEN 'view' THEN 'transcribe' WHEN 'click' THEN 'clean'
            WHEN 'purchase' THEN 'summarize' ELSE 'process' END AS stage,
        CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 WHEN 0 THEN 'started' WHEN 1 THEN 'success' ELSE 'error' END AS status,
        props AS message, ts AS "timestamp" FROM events""",
    "updates": """SELECT episode_id,
        CASE stage WHEN 'download' THEN 'downloading' WHEN 'transcribe' THEN 'transcribing' WHEN 'clean' THEN 'cleaning'
            WHEN 'summarize' THEN 'completed' ELSE 'failed' END AS status,
        CASE stage WHEN 'process' THEN message WHEN 'clean' THEN '' END AS error_message,
        CASE WHEN stage = 'download' AND status <> 'error' THEN 'audio/' || id END AS audio_path,
        CASE WHEN stage = 'transcribe' AND status <> 'error' THEN 'raw/' || id END AS raw_transcript_path,
        CASE WHEN stage = 'clean' AND status <> 'error' THEN 'clean/' || id END AS cleaned_transcript_path,
        CASE WHEN stage = 'summarize' AND status <> 'error' THEN 'summary/' || id END AS summary_path,
        "timestamp" AS "at", id AS seq FROM logs""",
    "transcripts": """SELECT doc_id AS id, doc_id AS episode_id, text AS raw_text, CASE WHEN lang = 'en' THEN text END AS cleaned_text,
        lang AS transcription_model, source AS cleaning_model, TIMESTAMP '2024-01-01' AS created_at,
        TIMESTAMP '2024-01-01' AS updated_at FROM documents""",
    "items": """SELECT CAST(substr(source, 4) AS BIGINT) AS feed_id, doc_id AS pos, 'Item ' || doc_id AS title, '' AS description,
        'https://media.example.com/' || doc_id || '.mp3' AS audio_url,
        TIMESTAMP '2024-01-01' + to_days(CAST(n_chars % 400 AS INTEGER)) AS published_date,
        CAST(n_chars AS INTEGER) AS duration_seconds, md5(text) AS guid FROM documents""",
    "known": """SELECT pos AS id, feed_id, title, description, audio_url, published_date, duration_seconds, guid,
        TIMESTAMP '2024-01-01' AS created_at FROM items WHERE pos IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "segments": """SELECT conv_id AS episode_id, turn AS id, turn * 37.5 AS start, text, role AS speaker FROM conversations""",
    "feed_batch": """SELECT o_orderkey AS pos, o_orderpriority || ' ' || o_orderkey AS name,
        CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderpriority = '2-HIGH' THEN NULL
            ELSE 'https://feeds.example.com/' || (o_custkey * 2) END AS url, true AS enabled FROM orders""",
}
# views that read another view
_READS = {"updates": ("logs",), "known": ("items",)}


def sql(body: str, *views: str) -> str:
    """``body`` with the named views in front of it."""
    wanted: list[str] = []
    for view in views:
        for needed in (*_READS.get(view, ()), view):
            if needed not in wanted:
                wanted.append(needed)
    head = ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in wanted)
    if not head:
        return body
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body.lstrip()[len('WITH RECURSIVE'):]}"
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {head},\n{body.lstrip()[len('WITH'):]}"
    return f"WITH {head}\n{body}"
