"""Feed-item rules, transcripts, models and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions import digest as fd
from feedlake.functions import feeds as ff
from feedlake.functions import summaries as fs
from feedlake.functions import text as ft
from feedlake.functions.basic import strip
from feedlake.operators import mentions
from feedlake.operators.inference import apply_model, apply_stored, reply_store
from feedlake.plans.jobs import clean_texts
from feedlake.storage import fresh_dir, materialize, spread
from feedlake.schemas import SUMMARY_ARRAYS
from feedlake.sinks import documents

from .registry import query
from .views import Tables, sql

CHUNK = 2000  # small enough that many documents need several chunks

# Attachments of an order, by its priority.
ENCLOSURES = """CASE o_orderpriority
    WHEN '1-URGENT' THEN array(named_struct('type', 'image/jpeg', 'href', 'image'), named_struct('type', 'audio/mpeg', 'href', concat('a', o_orderkey)))
    WHEN '2-HIGH' THEN array(named_struct('type', 'audio/mpeg', 'href', ''))
    WHEN '4-NOT SPECIFIED' THEN array(named_struct('type', 'image/jpeg', 'href', 'image'))
    ELSE cast(array() AS ARRAY<STRUCT<type: STRING, href: STRING>>) END"""
LINKS = """CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM')
    THEN array(named_struct('type', cast(null AS STRING), 'href', 'page'), named_struct('type', 'audio/x', 'href', concat('l', o_orderkey)))
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN array(named_struct('type', 'text/html', 'href', 'page')) END"""
AUDIO = """CASE WHEN o_orderpriority = '1-URGENT' THEN 'a' || o_orderkey
    WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'l' || o_orderkey END"""


def attachments(t: Tables) -> DataFrame:
    return t.given("orders").select(
        F.col("o_orderkey").alias("id"), F.expr(ENCLOSURES).alias("enclosures"), F.expr(LINKS).alias("links"))


@query("x1_audio_url", f"SELECT o_orderkey AS id, {AUDIO} AS audio_url FROM orders")
def audio_url(t):
    return attachments(t).select("id", ff.audio_url("enclosures", "links").alias("audio_url"))


@query("f9_audio_items", f"SELECT o_orderkey AS id, {AUDIO} AS audio_url FROM orders WHERE {AUDIO} IS NOT NULL")
def audio_items(t):
    found = attachments(t).select("id", ff.audio_url("enclosures", "links").alias("audio_url"))
    return found.filter(F.col("audio_url").isNotNull() & (F.col("audio_url") != ""))


# Ways to write a date: before, pattern, after, and what it adds to the day (None: no date).
WRITTEN = [
    ("Tue, ", "dd MMM yyyy", " 10:00:00 +0200", "8 HOUR"), ("", "yyyy-MM-dd", "T10:30:00Z", "630 MINUTE"), ("", "MMMM d, yyyy", "", "0 HOUR"),
    ("Sat, ", "dd MMM yyyy", " 10:00:00 EST", "15 HOUR"), ("some time after ", "yyyy-MM-dd", "", None), ("", "MMMM d, yyyy", " 3:30 PM", "930 MINUTE"),
    ("", "d MMM yyyy", " 10:00:00.5 GMT", "10 HOUR"), ("tue, ", "dd MMM yyyy", " 10:00:00 GMT+0200", "8 HOUR"), ("", "d'th' MMMM yyyy", "", "0 HOUR"),
    ("", "yyyyMMdd", "T090500Z", "545 MINUTE"), ("", "yyyy-MM-dd", " 09:05:00 EST", "845 MINUTE"), ("", "dd MMM yyyy", " 09:05:00 -0500 (EST)", "845 MINUTE"),
    ("", "yyyy/MM/dd", " 9:05 am CET", "485 MINUTE"), ("", "yyyy-MM-dd", "T23:59:59+00:00", "86399 SECOND"), ("Friday, ", "MMM dd, yyyy", " 12:15 AM XYZ", "15 MINUTE"),
    ("Tue,", "dd MMM yyyy", " 10:00:00 GMT", "10 HOUR"), ("", "yyyy-M-d", "", "0 HOUR"), ("", "M/d/yy", "", "0 HOUR"), ("Tue ", "MMM d '10:00:00 UTC' yyyy", "", "10 HOUR"),
    ("", "M.d.yyyy", "", "0 HOUR"), ("10:00 GMT ", "MMMM d, yyyy", "", "10 HOUR"), ("", "dd/MMM/yyyy", ":10:00:00 +0530", "270 MINUTE"), ("", "d-MMM-yy", " at 3pm", "15 HOUR"),
    ("Sunny day ", "d MMM yyyy", "", None),
]
SLASHED = "CASE WHEN day(o_orderdate) > 12 THEN o_orderdate ELSE CAST(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) AS TIMESTAMP) END"


@query("x2_published_date", f"""SELECT o_orderkey AS id, CASE o_orderkey % {len(WRITTEN) + 1} {" ".join(
    f"WHEN {i} THEN " + (f"o_orderdate + INTERVAL {gap}" if gap else "NULL") for i, (*_, gap) in enumerate(WRITTEN))}
    ELSE {SLASHED} END AS published_date FROM orders""")
def published_date(t):
    text = F
    for i, (front, pattern, back, _) in enumerate(WRITTEN):
        text = text.when(F.col("o_orderkey") % (len(WRITTEN) + 1) == i, F.concat(F.lit(front), F.date_format("o_orderdate", pattern), F.lit(back)))
    text = text.otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    orders = spread(t.given("orders").select("o_orderkey", "o_orderdate"), "o_orderkey", t.partitions)
    return orders.select(F.col("o_orderkey").alias("id"), ff.published_date(text).alias("published_date"))


@query("x3_duration", """SELECT o_orderkey AS id, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN o_custkey WHEN '2-HIGH' THEN o_custkey * 60 + 75
    WHEN '3-MEDIUM' THEN o_custkey * 3600 + 62 ELSE CASE o_orderkey % 5 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey * 60 + 2
    WHEN 2 THEN -o_custkey * 60 + 2 END END AS INTEGER) AS duration_seconds FROM orders""")
def duration(t):
    text = F.expr("""CASE o_orderpriority WHEN '1-URGENT' THEN concat(' ', o_custkey) WHEN '2-HIGH' THEN concat(o_custkey, ':75')
        WHEN '3-MEDIUM' THEN concat(o_custkey, ':01:02') ELSE CASE o_orderkey % 5 WHEN 0 THEN concat('+', lpad(string(o_custkey), 40, '0'))
        WHEN 1 THEN concat(lpad(string(o_custkey), 14, '0'), ':02') WHEN 2 THEN concat('-000', o_custkey, ':+0000000000002')
        WHEN 3 THEN concat(o_custkey, ':1:2:3') ELSE concat(o_custkey, '.5') END END""")
    return t.given("orders").select(F.col("o_orderkey").alias("id"), ff.duration_seconds(text).alias("duration_seconds"))


@query("x6_file_name", """SELECT doc_id AS id, doc_id || '_' ||
    replace(trim(regexp_replace(substr(text, 1, 50), '[^\\p{L}\\p{N} _-]', '', 'g')), ' ', '_') || '_' || substr(md5(text), 1, 8) || '.mp3'
    AS file_name FROM documents""")
def file_name(t):
    return t.given("documents").select(F.col("doc_id").alias("id"), ff.safe_file_name("doc_id", "text").alias("file_name"))


@query("x7_quality", """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN '0' WHEN '3-MEDIUM' THEN '5' ELSE '2' END AS level
    FROM orders""")
def quality(t):
    asked = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'best' WHEN '2-HIGH' THEN 'good' WHEN '3-MEDIUM' THEN 'medium' "
                   "WHEN '5-LOW' THEN 'other' END")
    return t.given("orders").select(F.col("o_orderkey").alias("id"), ff.quality_level(asked).alias("level"))


@query("x8_time_code", """SELECT event_id AS id, printf('%02d:%02d:%02d', CAST(floor(value * 1000 / 3600) AS BIGINT),
    CAST(floor(value * 1000) AS BIGINT) % 3600 // 60, CAST(floor(value * 1000) AS BIGINT) % 60) AS code FROM events""")
def time_code(t):
    return t.given("events").select(F.col("event_id").alias("id"), ft.time_code(F.col("value") * 1000).alias("code"))


def replies(t: Tables) -> DataFrame:
    """A recogniser's JSON per document: one segment per sentence, padded texts; French ones have no segments, and one in twenty is no JSON."""
    said = ft.sentences("text")
    segments = F.transform(said, lambda s, i: F.struct(
        i.alias("id"), (i * 37.5).alias("start"), ((i + 1) * 37.5).alias("end"), F.concat(F.lit(" "), s, F.lit("\n")).alias("text")))
    segments = F.when(F.col("lang") != "fr", segments)
    body = F.struct(F.concat(F.lit("\n "), "text", F.lit(" ")).alias("text"), F.col("lang").alias("language"), segments.alias("segments"))
    reply = F.when(F.col("doc_id") % 20 == 3, F.lit("not json")).otherwise(F.to_json(body))
    return t.documents.select(F.col("doc_id").alias("episode_id"), reply.alias("reply"))


SPLIT = "string_split(replace(text, chr(10), ' '), '. ')"


@query("x9_time_coded_text", f"""SELECT doc_id AS episode_id, CASE WHEN doc_id % 20 = 3 THEN NULL WHEN lang = 'fr' THEN trim(text, chr(10) || ' ') ELSE (
        SELECT string_agg(printf('[%02d:%02d:%02d] ', CAST(floor(i * 37.5) AS BIGINT) // 3600, CAST(floor(i * 37.5) AS BIGINT) % 3600 // 60,
            CAST(floor(i * 37.5) AS BIGINT) % 60) || trim(s, chr(10) || ' '), chr(10) ORDER BY i)
        FROM (SELECT unnest({SPLIT}) AS s, generate_subscripts({SPLIT}, 1) - 1 AS i)) END AS text FROM documents""")
def time_coded_text(t):
    heard = replies(t).select("episode_id", ft.recognised("reply").alias("heard"))
    return heard.select("episode_id", ft.transcript_text("heard").alias("text"))


@query("x10_recognised", f"""SELECT doc_id AS episode_id, lang AS language, trim(text, chr(10) || ' ') AS text,
    CASE WHEN lang = 'fr' THEN 0 ELSE len({SPLIT}) END AS segments,
    CASE WHEN lang <> 'fr' THEN trim(list_extract({SPLIT}, -1), chr(10) || ' ') END AS last_text,
    CASE WHEN lang <> 'fr' THEN CAST(len({SPLIT}) * 37.5 AS DOUBLE) END AS last_end FROM documents WHERE doc_id % 20 <> 3""")
def recognised(t):
    heard = replies(t).select("episode_id", ft.recognised("reply").alias("h")).filter("h IS NOT NULL")
    last = F.try_element_at(F.col("h.segments"), F.lit(-1))
    return heard.select("episode_id", "h.language", "h.text", F.size("h.segments").cast("bigint").alias("segments"),
                        last["text"].alias("last_text"), last["end"].alias("last_end"))


CHUNKS = f"""WITH RECURSIVE said AS (SELECT doc_id, unnest({SPLIT}) AS s, generate_subscripts({SPLIT}, 1) AS i FROM documents
        WHERE length(text) > {CHUNK}),
    placed AS (SELECT doc_id, i, s, length(s) AS size, 0 AS chunk_no FROM said WHERE i = 1
        UNION ALL SELECT n.doc_id, n.i, n.s, CASE WHEN p.size + length(n.s) > {CHUNK} THEN length(n.s) ELSE p.size + length(n.s) END,
            CASE WHEN p.size + length(n.s) > {CHUNK} THEN p.chunk_no + 1 ELSE p.chunk_no END
        FROM placed p JOIN said n ON n.doc_id = p.doc_id AND n.i = p.i + 1),
    joined AS (SELECT doc_id, chunk_no, string_agg(s, '. ' ORDER BY i) AS chunk,
        max(chunk_no) OVER (PARTITION BY doc_id) + 1 AS n_chunks FROM placed GROUP BY doc_id, chunk_no),
    chunks AS (SELECT doc_id AS episode_id, CAST(chunk_no AS BIGINT) AS chunk_no,
        CASE WHEN chunk_no + 1 < n_chunks THEN chunk || '.' ELSE chunk END AS chunk FROM joined
        UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= {CHUNK})
    """


def chunks_of(t: Tables) -> DataFrame:
    texts = t.documents.select(F.col("doc_id").alias("episode_id"), "text")
    rows = ft.explode_chunks(texts, "text", CHUNK)
    return rows.withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


@query("x12_chunks", CHUNKS + "SELECT * FROM chunks")
def chunks(t):
    return chunks_of(t)


class Shout:
    """A model that answers in capitals and fails on tables."""

    def __init__(self, mark: str = ""):
        self.mark = mark

    def __call__(self, prompt: str) -> str:
        if "|" in prompt:
            raise ValueError("a table")
        return self.mark + prompt.replace("e", "E").replace("a", "A")


@query("m1_apply_model", """SELECT doc_id AS episode_id, CASE WHEN NOT contains(text, '|') THEN '> ' || replace(replace(text, 'e', 'E'), 'a', 'A') END
    AS reply, CASE WHEN contains(text, '|') THEN 'ValueError: a table' END AS error FROM documents""")
def model(t):
    texts = t.documents.select(F.col("doc_id").alias("episode_id"), "text")
    return apply_model(texts, "text", Shout, mark="> ")


def counting_model():
    """Takes a batch of prompts; its reply to one with a percent sign is a number, not a text."""
    return lambda prompts: [len(p) if "%" in p else f"< {p}" for p in prompts]


@query("m1_batches", """SELECT doc_id AS episode_id, CASE WHEN NOT contains(text, '%') THEN '< ' || text END AS reply,
    CASE WHEN contains(text, '%') THEN 'TypeError: the reply is int, not str' END AS error FROM documents""")
def model_in_batches(t):
    texts = t.documents.select(F.col("doc_id").alias("episode_id"), "text")
    return apply_model(texts, "text", counting_model, batch_size=16)


class Silent:
    """A model that must not be asked but for tables."""

    def __call__(self, prompt: str) -> str:
        if "|" not in prompt:
            raise RuntimeError("asked again")
        return f"2 {prompt}"


@query("m1_stored_replies", """SELECT doc_id AS episode_id, CASE WHEN NOT contains(text, '|') THEN replace(replace(text, 'e', 'E'), 'a', 'A') ELSE '2 ' || text END AS reply,
    CAST(NULL AS VARCHAR) AS error FROM documents""")
def stored_replies(t):
    """Two runs over the same prompts: the second asks only what failed in the first, and another model answers."""
    # Two runs read the prompts several times, so they are dealt out once.
    texts = materialize(t.documents.select(F.col("doc_id").alias("episode_id"), "text"))
    store = reply_store(t.spark, fresh_dir(t.spark, "replies"))
    apply_stored(texts, "text", Shout, store, "shout")
    return apply_stored(texts, "text", Silent, store, "shout", calls={"workers": 4, "attempts": 2, "wait": 0.01})


@query("m2_prompt", """SELECT doc_id AS episode_id, 'Answer as {"summary": "text"}. Here it is: ' || text AS prompt FROM documents""")
def prompt(t):
    template = 'Answer as {"summary": "text"}. Here it is: {transcript}'
    return t.given("documents").select(F.col("doc_id").alias("episode_id"), ft.prompt(template, "text").alias("prompt"))


SPOKEN = "replace(replace(text, ' the ', ' um, the  uhh you know, '), ' of ', ' Ah of umbrella ')"


@query("m3_drop_fillers", f"""SELECT doc_id AS episode_id, trim(regexp_replace(regexp_replace({SPOKEN},
    '(?i)\\b(um+|uh+|ah+|you know)\\b,?\\s*', '', 'g'), ' {{2,}}', ' ', 'g'), ' ' || chr(9) || chr(10)) AS text FROM documents WHERE lang = 'en'""")
def fillers(t):
    english = t.documents.filter("lang = 'en'")
    return english.select(F.col("doc_id").alias("episode_id"), ft.drop_fillers(F.expr(SPOKEN)).alias("text"))


COMPANIES = [("The", "article"), ("Tion", "suffix"), ("Nicht", "word"), ("Leréaux", "name"), ("And The", "pair"), ("555", "number"), ("--", "no word")]
NAMED = ", ".join(f"CASE WHEN contains(max(' ' || array_to_string(regexp_split_to_array(lower(d.text), '[^\\p{{L}}\\p{{N}}]+'), ' ') || ' '), ' {n.lower()} ') THEN '{n} ({i})' END"
                  for n, i in sorted(COMPANIES) if n != "--")


@query("m4_rule_summary", f"""WITH said AS (SELECT doc_id, trim(s, ' ' || chr(9)) AS s, i FROM (SELECT doc_id, unnest({SPLIT}) AS s,
        generate_subscripts({SPLIT}, 1) AS i FROM documents) WHERE trim(s, ' ' || chr(9)) <> ''),
    numbered AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n,
        row_number() OVER (PARTITION BY doc_id ORDER BY length(s) DESC, i) AS by_length,
        CASE WHEN regexp_matches(s, '[0-9]') THEN row_number() OVER (PARTITION BY doc_id, regexp_matches(s, '[0-9]') ORDER BY i) END AS by_digit
        FROM said),
    words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS w FROM documents),
    counts AS (SELECT doc_id, w, count(*) AS c FROM words WHERE length(w) >= 4 GROUP BY doc_id, w),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, w) AS r FROM counts),
    topics AS (SELECT doc_id, string_agg(w || ': Mentioned ' || c || ' times', '; ' ORDER BY r) AS topics FROM ranked WHERE r <= 5 GROUP BY doc_id)
    SELECT n.doc_id AS episode_id, string_agg(s, '. ' ORDER BY n) FILTER (WHERE n <= 3) AS overview,
        string_agg(s || ' [Sentence ' || n || ']', chr(10) ORDER BY by_length) FILTER (WHERE by_length <= 3) AS quotes,
        coalesce(string_agg(s, chr(10) ORDER BY n) FILTER (WHERE by_digit <= 3), '') AS observations,
        coalesce(max(topics), '') AS topics,
        concat_ws(', ', {NAMED}) AS companies
    FROM numbered n LEFT JOIN topics USING (doc_id) JOIN documents d USING (doc_id) GROUP BY n.doc_id""")
def rule_summary(t):
    # Blank texts have no summary; asking the text is cheaper than asking the summary, which would be made twice.
    spoken = t.documents.filter(F.length(strip("text")) > 0)
    made = spoken.select(F.col("doc_id").alias("episode_id"), fs.rule_summary("text").alias("summary"))
    names = t.spark.createDataFrame(COMPANIES, "name string, industry string")
    made = mentions.with_mentions(made, mentions.company_mentions(spoken, names, "doc_id").withColumnRenamed("doc_id", "episode_id"))
    s = F.col("summary")

    def lines(array, render, between="\n"):
        return F.array_join(F.transform(array, render), between)

    return made.select(
        "episode_id", s["comprehensive_summary"].alias("overview"),
        lines(s["actionable_quotes"], lambda q: F.concat(q["quote"], F.lit(" ["), q["context"], F.lit("]"))).alias("quotes"),
        F.array_join(s["noteworthy_observations"], "\n").alias("observations"),
        lines(s["key_topics"], lambda k: F.concat(k["topic"], F.lit(": "), k["description"]), "; ").alias("topics"),
        lines(s["company_mentions"], lambda c: F.concat(c["name"], F.lit(" ("), c["industry"], F.lit(")")), ", ").alias("companies"),
    )


@query("x15_merged_chunks", CHUNKS + """SELECT episode_id, string_agg(CASE WHEN contains(chunk, '|') THEN chunk
        ELSE '> ' || replace(replace('Clean: ' || chunk, 'e', 'E'), 'a', 'A') END, chr(10) || chr(10) ORDER BY chunk_no) AS cleaned_text
    FROM chunks GROUP BY episode_id""")
def merged_chunks(t):
    texts = t.documents.select(F.col("doc_id").alias("episode_id"), F.col("text").alias("raw_text"))
    return clean_texts(texts, Shout, template="Clean: {transcript}", chunk_size=CHUNK, mark="> ")


@query("x16_fallback", """SELECT doc_id AS episode_id, CASE WHEN doc_id % 20 = 3 THEN '  ' WHEN lang IN ('en', 'es') THEN 'clean ' || text ELSE text END AS text
    FROM documents""")
def fallback(t):
    raw = F.when(F.col("doc_id") % 20 == 3, F.lit("  ")).otherwise(F.col("text"))
    cleaned = F.expr("CASE WHEN lang IN ('en', 'es') THEN concat('clean ', text) WHEN lang = 'de' THEN '' END")
    return t.given("documents").select(F.col("doc_id").alias("episode_id"), ft.cleaned_or_raw(cleaned, raw).alias("text"))


@query("x17_unfence", """SELECT doc_id AS episode_id, CASE lang WHEN 'en' THEN text WHEN 'fr' THEN '```' || chr(10) || rtrim(replace(text, chr(10), ' '))
    ELSE trim(text, ' ' || chr(9) || chr(10)) END AS text FROM documents""")
def unfence(t):
    reply = (
        F.when(F.col("lang") == "en", F.concat(F.lit(" ```json\n"), "text", F.lit("\n```\n")))
        .when(F.col("lang") == "fr", F.concat(F.lit("```\n"), F.replace("text", F.lit("\n"), F.lit(" ")))).otherwise(F.col("text"))
    )
    return t.given("documents").select(F.col("doc_id").alias("episode_id"), fs.unfence(reply).alias("text"))


@query("x18_decode", """SELECT doc_id AS episode_id, source AS host_and_guest, text AS comprehensive_summary,
    '4 ' || text AS last_quote, CAST(CASE WHEN doc_id % 20 = 11 THEN 8 ELSE 6 END AS BIGINT) AS n_topics,
    CASE WHEN doc_id % 20 = 11 THEN 'loose' ELSE lang || '1' END AS first_topic, 'said in ' || lang AS last_observation FROM documents WHERE doc_id % 20 NOT IN (3, 7)""")
def decode(t):
    """Fenced replies; some cut off, some with text behind the object, some with elements that are no objects."""
    made = t.summary_structs.select("episode_id", "summary.host_and_guest", fs.document("summary").alias("json"))
    fenced = F.concat(F.lit("```json\n"), "json", F.lit("\n```"))
    loose = F.regexp_replace("json", '("key_topics"\\s*:\\s*\\[)', '$1 "loose", 7,')
    case = F.col("episode_id") % 20
    reply = F.when(case == 3, F.substring("json", 1, 40)).when(case == 7, F.concat("json", F.lit("\nThat is all."))).when(case == 11, loose).otherwise(fenced)
    decoded = made.select("episode_id", fs.decode(reply).alias("s")).filter("s IS NOT NULL")
    return decoded.select(
        "episode_id", "s.host_and_guest", "s.comprehensive_summary",
        F.element_at("s.actionable_quotes", -1)["quote"].alias("last_quote"), F.size("s.key_topics").cast("bigint").alias("n_topics"),
        F.get("s.key_topics", F.lit(0))["topic"].alias("first_topic"),
        F.element_at("s.noteworthy_observations", -1).alias("last_observation"))


@query("x18_stored_arrays", """SELECT doc_id AS episode_id, CAST(CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 0 ELSE 2 END AS BIGINT) AS n
, source AS odd FROM documents""")
def stored_arrays(t):
    text = F.expr("""CASE lang WHEN 'en' THEN '' WHEN 'fr' THEN NULL ELSE concat('["', source, '", "x"]') END""")
    array = fs.decode_array("noteworthy_observations", text)
    mixed = fs.decode_array("company_mentions", F.concat(F.lit('[{"name": "A", "details": "d"}, null, "'), "source", F.lit('"]')))
    return t.given("documents").select(F.col("doc_id").alias("episode_id"), F.size(array).cast("bigint").alias("n"), F.element_at(mixed, -1)["name"].alias("odd"))


@query("x19_encode", """SELECT doc_id AS episode_id, '["seen in ' || source || '","said in ' || lang || '"]' AS noteworthy_observations,
    '[{"thesis":"a < b & c ' || doc_id || '","reasoning":"' || lang || '","risks":"' || CASE WHEN lang = 'de' THEN 'high' ELSE '' END || '"}]'
    AS investment_theses, '[]' AS missing FROM documents""")
def encode(t):
    return fs.storable(t.summary_structs).select(
        "episode_id", "noteworthy_observations", "investment_theses",
        fs.encode_array(F.lit(None).cast(SUMMARY_ARRAYS["key_topics"])).alias("missing"))


@query("x20_display_date", """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Unknown date' WHEN '2-HIGH' THEN 'soon'
    WHEN '5-LOW' THEN CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m') END
    ELSE strftime(o_orderdate, '%B %d, %Y') END AS shown FROM orders""")
def display_date(t):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None).cast("string")).when(F.col("o_orderpriority") == "2-HIGH", F.lit("soon"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(iso, F.lit("Z")))
        .when(F.col("o_orderpriority") == "5-LOW", F.when(F.col("o_orderkey") % 2 == 0, F.substring(iso, 1, 4)).otherwise(F.substring(iso, 1, 7))).otherwise(iso)
    )
    return t.given("orders").select(F.col("o_orderkey").alias("id"), fd.display_date(text).alias("shown"))


@query("t5_slices", """SELECT doc_id AS episode_id, '3 ' || text AS last_quote, lang || '5' AS last_topic, 'Firm 5' AS last_company FROM documents""")
def slices(t):
    def last(field: str, n: int):
        return F.element_at(F.slice(F.col(f"summary.{field}"), 1, n), -1)

    return t.summary_structs.select(
        "episode_id", last("actionable_quotes", 3)["quote"].alias("last_quote"), last("key_topics", 5)["topic"].alias("last_topic"),
        last("company_mentions", 5)["name"].alias("last_company"))


MARKDOWN = """SELECT doc_id AS episode_id, '# Podcast Summary

## Host and Guest

' || source || '

## Comprehensive Summary

' || text || '

## Key Topics and Themes
' || (SELECT string_agg('
### ' || lang || k || '

' || source || '
', '' ORDER BY k) FROM range(1, 7) r(k)) || '
## Actionable Quotes
' || (SELECT string_agg('
### Quote ' || k || '

> "' || k || ' ' || text || '"

**— ' || CASE WHEN lang = 'en' THEN source ELSE 'Unknown' END || '**

*Context: ' || lang || '*
', '' ORDER BY k) FROM range(1, 5) r(k)) || '
## Investment Theses

### Thesis 1: a < b & c ' || doc_id || '

**Reasoning:** ' || lang || '
' || CASE WHEN lang = 'de' THEN '
**Risks/Caveats:** high
' ELSE '' END || '
## Noteworthy Observations

- seen in ' || source || '

- said in ' || lang || '

## Company Mentions
' || (SELECT string_agg('
### Firm ' || k || '

**Industry:** ' || CASE WHEN lang = 'fr' THEN 'N/A' ELSE lang END || '

**Context:** ' || source || '
' || CASE WHEN lang = 'es' THEN '
**Details:** listed
' ELSE '' END, '' ORDER BY k) FROM range(1, 7) r(k)) AS markdown FROM documents"""


@query("x11_markdown", MARKDOWN)
def markdown(t):
    return t.summary_structs.select("episode_id", fs.markdown("summary").alias("markdown"))


@query("k4_markdown_sink", f"""SELECT episode_id, 'summaries/' || episode_id || '_summary.md' AS summary_path, CAST(NULL AS VARCHAR) AS json_path,
    markdown AS markdown_text FROM ({MARKDOWN})""")
def markdown_sink(t):
    return _written(documents.summary_rows(t.summary_structs, "markdown").select("episode_id", "summary_path", "json_path", "markdown_text"))


def _written(rows):
    """Written as a table and read back: the form for whole tables, without a file per item."""
    folder = fresh_dir(rows.sparkSession, "sink")
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


@query("k3_json_sink", """SELECT doc_id AS episode_id, 'summaries/' || doc_id || '_summary.json' AS summary_path, source AS host_and_guest,
    text AS comprehensive_summary, (SELECT string_agg(lang || k || '=' || source, ';' ORDER BY k) FROM range(1, 7) r(k)) AS topics,
    (SELECT string_agg(k || ' ' || text || '=' || CASE WHEN lang = 'en' THEN source ELSE '-' END || '=' || lang, ';' ORDER BY k) FROM range(1, 5) r(k)) AS quotes,
    'a < b & c ' || doc_id || '=' || lang || '=' || CASE WHEN lang = 'de' THEN 'high' ELSE '' END AS theses, 'seen in ' || source || ';said in ' || lang AS observations,
    (SELECT string_agg('Firm ' || k || '=' || CASE WHEN lang = 'fr' THEN '-' ELSE lang END || '=' || source || '=' || CASE WHEN lang = 'es' THEN 'listed' ELSE '-' END, ';' ORDER BY k)
        FROM range(1, 7) r(k)) AS companies FROM documents""")
def json_sink(t):
    # The JSON text is read back, since its blanks and line ends carry no meaning.
    rows = _written(documents.summary_rows(t.summary_structs, "json")).select("episode_id", "summary_path", fs.decode("json_text").alias("s"))

    def listed(array, *fields):
        return F.array_join(F.transform(array, lambda x: F.concat_ws("=", *[F.coalesce(x[f], F.lit("-")) for f in fields])), ";")

    return rows.select(
        "episode_id", "summary_path", "s.host_and_guest", "s.comprehensive_summary", listed(F.col("s.key_topics"), "topic", "description").alias("topics"),
        listed(F.col("s.actionable_quotes"), "quote", "speaker", "context").alias("quotes"),
        listed(F.col("s.investment_theses"), "thesis", "reasoning", "risks").alias("theses"),
        F.array_join("s.noteworthy_observations", ";").alias("observations"),
        listed(F.col("s.company_mentions"), "name", "industry", "context", "details").alias("companies"))


@query("k2_transcript_sink", sql("""SELECT episode_id, 'raw' AS kind, episode_id || '_raw.txt' AS file_name, raw_text AS text FROM transcripts
    UNION ALL SELECT episode_id, 'cleaned', episode_id || '_cleaned.txt', cleaned_text FROM transcripts WHERE cleaned_text IS NOT NULL""",
                                 "transcripts"))
def transcript_sink(t):
    return _written(documents.transcript_rows(t.transcripts))


@query("x4_trimmed_text", "SELECT doc_id AS episode_id, text FROM documents")
def trimmed(t):
    padded = F.concat(F.lit("\t\n  "), "text", F.lit(" \r\n　"))
    return t.given("documents").select(F.col("doc_id").alias("episode_id"), strip(padded).alias("text"))
