"""Transcripts, models and summaries."""

from __future__ import annotations

import json
import os
import pathlib
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedlake import storage
from feedlake.functions import summaries as fs
from feedlake.functions import text as ft
from feedlake.functions.basic import WHITESPACE, strip
from feedlake.operators.aggregates import time_coded_parts
from feedlake.operators import inference, mentions
from feedlake.operators.inference import apply_model
from feedlake.plans import jobs
from feedlake.schemas import SUMMARY, TABLES
from feedlake.sinks import documents
from workload import pipelines
from workload.views import Tables


def column(spark, values, name="text"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def first(spark, value, make):
    return column(spark, [value]).select(make("text")).first()[0]


@pytest.mark.parametrize("text, size, expected", [
    ("aaaa. bbbb. cccc. dddd.", 8, ["aaaa. bbbb.", "cccc.", "dddd."]),
    ("aaaa. bbbb", 10, ["aaaa. bbbb"]),
    ("a\nb. c", 10, ["a\nb. c"]),
    ("a\nb. cccc", 5, ["a b.", "cccc"]),
    ("x" * 20 + ". y", 5, ["x" * 20 + ".", "y"]),
    ("x" * 20, 5, ["x" * 20]),
    ("ab. cd. ", 4, ["ab. cd. "]),
    ("", 4, [""]),
    (None, 4, [None]),
])
def test_chunks(spark, text, size, expected):
    assert first(spark, text, lambda c: ft.chunks(c, size)) == expected


def greedy(text, size):
    """The chunk rule, step by step."""
    if len(text) <= size:
        return [text]
    groups, length = [[]], 0
    for sentence in text.replace("\n", " ").split(". "):
        if groups[-1] and length + len(sentence) > size:
            groups.append([])
            length = 0
        groups[-1].append(sentence)
        length += len(sentence)
    return [". ".join(g) + ("." if g is not groups[-1] else "") for g in groups]


def test_chunks_against_the_rule(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "bé", "😀", ". ", ".", " ", "\n", "word "]) for _ in range(rng.randrange(0, 200))) for _ in range(300)]
    rows = column(spark, texts).select("text", ft.chunks("text", 40).alias("chunks")).collect()
    assert all(r.chunks == greedy(r.text, 40) for r in rows)
    exploded = ft.explode_chunks(column(spark, texts).withColumn("id", F.monotonically_increasing_id()), "text", 40)
    assert exploded.count() == sum(len(greedy(t, 40)) for t in texts)


def test_long_text(spark):
    text = ". ".join(f"sentence {i}" for i in range(60_000))
    assert first(spark, text, lambda c: ft.chunks(c, 1000)) == greedy(text, 1000)


def test_time_codes(spark):
    cases = {0.0: "00:00:00", 3725.9: "01:02:05", 59.999: "00:00:59", 360000.0: "100:00:00"}
    df = spark.createDataFrame([(k,) for k in cases], "s double")
    assert {r[0]: r[1] for r in df.select("s", ft.time_code("s")).collect()} == cases


def test_time_coded_parts_make_the_whole(spark):
    rows = [(1, i, i * 2.0, f"line {i}") for i in range(25)] + [(2, 0, 0.0, "Hi"), (2, 1, 3725.9, "Bye")]
    random.Random(1).shuffle(rows)
    parts = time_coded_parts(spark.createDataFrame(rows, "episode_id int, id int, start double, text string"), 10)
    found = {(r.episode_id, r.part_no): r.text for r in parts.collect()}
    assert found[(2, 0)] == "[00:00:00] Hi\n[01:02:05] Bye"
    assert "\n".join(found[(1, p)] for p in range(3)).split("\n") == [f"[00:00:{2 * i:02d}] line {i}" for i in range(25)]


def test_recogniser_replies(spark):
    reply = json.dumps({"text": " Hi. Bye ", "language": "en", "segments": [
        {"id": 0, "start": 0, "end": 1.5, "text": " Hi ", "words": [{"word": "Hi", "start": 0, "end": 1, "probability": 0.5}]}]})
    bare = json.dumps({"text": " x ", "language": "de"})
    df = column(spark, [reply, bare, "no json", None], "reply")
    rows = df.select(ft.recognised("reply").alias("h"), ft.transcript_text(ft.recognised("reply")).alias("t"),
                     ft.recognised("reply", with_words=True)["segments"].alias("s")).collect()
    assert rows[0].h.text == "Hi. Bye" and rows[0].h.segments[0].text == "Hi" and rows[0].h.segments[0].words is None
    assert rows[0].s[0].words[0].word == "Hi"
    assert [r.t for r in rows] == ["[00:00:00] Hi", "x", None, None]


def test_strip_is_unicode(spark):
    values = [c + "a b" + c for c in WHITESPACE] + ["  ", ""]
    assert [r[0] for r in column(spark, values).select(strip("text")).collect()] == [v.strip() for v in values]


def test_fillers(spark):
    cases = {"So, um, I think uh we, you know, go.": "So, I think we, go.", "Umbrella album, hum": "Umbrella album, hum",
             "UMM yes ahh": "yes", "éah éum": "éah éum", "a  b": "a b", "you knowing": "you knowing"}
    assert {r[0]: r[1] for r in column(spark, cases).select("text", ft.drop_fillers("text")).collect()} == cases


def test_unfence(spark):
    cases = {"```json\n{}\n```": "{}", " ```\na\nb\n```\n": "a\nb", "```x```": "```x```", "```\nx": "```\nx", " x ": "x", "```\n\n```": ""}
    assert {r[0]: r[1] for r in column(spark, cases).select("text", fs.unfence("text")).collect()} == cases


def test_decode(spark):
    replies = ['{"host_and_guest": "h"}', '```json\n{"key_topics": [{"topic": "t"}]}\n```', "nope", "", None, '{"other": 1}', "[1, 2]"]
    rows = [r[0] for r in column(spark, replies).select(fs.decode("text")).collect()]
    assert rows[0].host_and_guest == "h" and rows[1].key_topics[0].topic == "t" and rows[2:] == [None] * 5


FULL = {
    "host_and_guest": "H", "comprehensive_summary": "C", "key_topics": [{"topic": "T", "description": "D"}, {"topic": None, "description": None}],
    "actionable_quotes": [{"quote": "Q", "speaker": None, "context": "X"}],
    "investment_theses": [{"thesis": "I", "reasoning": "R", "risks": "K"}, {"thesis": None, "reasoning": "S", "risks": ""}],
    "noteworthy_observations": ["O", "P"], "company_mentions": [{"name": "N", "industry": None, "context": "Y", "details": "Z"}],
}


def summary(spark, value):
    return spark.createDataFrame([(1, json.dumps(value))], "episode_id bigint, j string").select("episode_id", F.from_json("j", SUMMARY).alias("summary"))


def test_markdown(spark):
    expected = """# Podcast Summary

## Host and Guest

H

## Comprehensive Summary

C

## Key Topics and Themes

### T

D

### Unknown Topic



## Actionable Quotes

### Quote 1

> "Q"

**— Unknown**

*Context: X*

## Investment Theses

### Thesis 1: I

**Reasoning:** R

**Risks/Caveats:** K

### Thesis 2: N/A

**Reasoning:** S

## Noteworthy Observations

- O

- P

## Company Mentions

### N

**Industry:** N/A

**Context:** Y

**Details:** Z
"""
    assert summary(spark, FULL).select(fs.markdown("summary")).first()[0] == expected
    empty = summary(spark, {}).select(fs.markdown("summary")).first()[0]
    assert empty.startswith("# Podcast Summary\n\n## Host and Guest\n\nN/A\n") and empty.endswith("\n## Company Mentions\n")


def test_summary_round_trip_through_the_table(spark):
    made = summary(spark, FULL)
    stored = fs.storable(made.withColumn("id", F.lit(1)).withColumn("model_used", F.lit("m")).withColumn("created_at", F.lit(None).cast("timestamp_ntz")))
    assert fs.stored(stored).select("summary").first() == made.select("summary").first()


@pytest.mark.parametrize("form, json_path, markdown_path", [
    ("json", "d/1_summary.json", None), ("markdown", None, "d/1_summary.md"), ("both", "d/1_summary.json", "d/1_summary.md")])
def test_summary_files(spark, form, json_path, markdown_path):
    row = documents.summary_rows(summary(spark, FULL), form, "d").first()
    assert (row.json_path, row.markdown_path, row.summary_path) == (json_path, markdown_path, markdown_path or json_path)
    assert (json.loads(row.json_text) == FULL) if json_path else row.json_text is None


def test_rule_summary(spark):
    text = "Alpha beta alpha gamma. Acme sells 3 gammas to BETA\nand alpha. Short. One more sentence that is the longest of all"
    made = column(spark, [text, "", " \n", None]).select(fs.rule_summary("text")).collect()
    s = made[0][0]
    words = Counter(w for w in text.lower().replace(".", " ").split() if len(w) >= 4)
    top = sorted(words.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
    assert [(t.topic, t.description) for t in s.key_topics] == [(w, f"Mentioned {n} times") for w, n in top]
    assert s.comprehensive_summary == "Alpha beta alpha gamma. Acme sells 3 gammas to BETA and alpha. Short"
    assert [q.context for q in s.actionable_quotes] == ["Sentence 4", "Sentence 2", "Sentence 1"]
    assert s.noteworthy_observations == ["Acme sells 3 gammas to BETA and alpha"]
    assert s.company_mentions == []
    assert [r[0] for r in made[1:]] == [None] * 3


def test_companies_by_name(spark):
    texts = spark.createDataFrame([(1, "Shares of 3M, Morgan Stanley and Apple.\nMorgan  stanley again"), (2, "Morgan fell; Stanley rose; pineapple"), (3, ""), (4, None)], "episode_id int, text string")
    names = spark.createDataFrame([("Morgan Stanley", "bank"), ("Apple", "phones"), ("3M", None), ("Apple", "phones"), ("!!", "x"), (None, "y")], "name string, industry string")
    found = {r.episode_id: [(c.name, c.industry) for c in r.company_mentions] for r in mentions.company_mentions(texts, names).collect()}
    assert found == {1: [("3M", ""), ("Apple", "phones"), ("Morgan Stanley", "bank")]}
    made = texts.select("episode_id", fs.rule_summary("text").alias("summary"))
    rows = {r.episode_id: r.summary for r in mentions.with_mentions(made, mentions.company_mentions(texts, names)).collect()}
    assert len(rows[1].company_mentions) == 3 and rows[2].company_mentions == [] and rows[3] is None and rows[4] is None
    assert mentions.company_mentions(texts, names.limit(0)).count() == 0


class Half:
    """Fails on texts with an x; counts nothing, keeps nothing."""

    def __init__(self, suffix):
        self.suffix = suffix

    def __call__(self, prompt):
        if "x" in prompt:
            raise RuntimeError("no x")
        return prompt + self.suffix


def broken(**options):
    raise OSError("no such model")


def test_models_fail_alone(spark):
    df = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "id int, text string")
    rows = {r.id: (r.reply, r.error) for r in apply_model(df, "text", Half, partitions=3, suffix="!").collect()}
    assert rows == {1: ("a!", None), 2: (None, "RuntimeError: no x"), 3: (None, None)}
    with pytest.raises(Exception, match="no such model"):
        apply_model(df, "text", broken).collect()


def odd_replies(**options):
    return lambda prompt: {"a": {"no": "text"}, "b": ["x"], "c": 3}.get(prompt, prompt)


class Falsy:
    """A model that counts as false; it must still be made once per task."""

    made = 0

    def __init__(self):
        Falsy.made += 1
        self.number = Falsy.made

    def __bool__(self):
        return False

    def __call__(self, prompt):
        return str(self.number)


def in_batches(**options):
    def model(prompts):
        if "x" in prompts:
            raise RuntimeError("no x")
        return [f"{len(prompts)}:{p}" if p != "c" else 7 for p in prompts]

    return model


def test_replies_that_are_no_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id int, text string")
    rows = {r.id: (r.reply, (r.error or "")[:9]) for r in apply_model(df, "text", odd_replies).collect()}
    assert rows == {1: (None, "TypeError"), 2: (None, "TypeError"), 3: (None, "TypeError"), 4: ("d", "")}
    assert {r.reply for r in apply_model(df.coalesce(1), "text", Falsy).collect()} == {"1"}


def test_prompts_in_batches(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c"), (5, "x"), (6, "d")], "id int, text string").coalesce(1)
    rows = {r.id: (r.reply, (r.error or "")[:9]) for r in apply_model(df, "text", in_batches, batch_size=2).collect()}
    assert rows == {1: ("2:a", ""), 2: ("2:b", ""), 3: (None, ""), 4: (None, "RuntimeEr"), 5: (None, "RuntimeEr"), 6: ("1:d", "")}


def test_prompt_keeps_braces_and_dollars(spark):
    assert first(spark, r"$1 \ {a}", lambda c: ft.prompt('{"k": 1} {transcript}', c)) == r'{"k": 1} $1 \ {a}'


class Cleaner:
    def __call__(self, prompt):
        text = prompt.split("\n\n", 1)[1]
        if "bad" in text:
            raise RuntimeError("bad")
        return f" {text.upper()} "


class Summarizer:
    def __call__(self, prompt):
        text = prompt.split("\n\n", 1)[1]
        return "?" if "NOSUM" in text else json.dumps({"comprehensive_summary": text})


def test_processing(spark):
    raw = {1: "one. two", 2: "bad one", 3: "nosum", 4: "  ", 5: "", 6: "unheard"}
    recognised = spark.createDataFrame([(k, json.dumps({"text": v, "language": "en"})) for k, v in raw.items() if k != 6], "episode_id bigint, reply string")
    media = spark.createDataFrame([(k, f"audio/{k}") for k in (1, 2, 3, 4, 5, 6)] + [(7, "")], "episode_id bigint, audio_path string")
    queue = spark.createDataFrame([(k,) for k in range(1, 9)], "id bigint")
    status = spark.createDataFrame([(k, "pending") + (None,) * 8 for k in range(1, 9)], TABLES["processing_status"])
    done = jobs.process_items(queue, media, recognised, Cleaner, Summarizer, "2024-01-01", status, spark.createDataFrame([], TABLES["transcripts"]),
                              spark.createDataFrame([], TABLES["summaries"]), chunk_size=4)
    rows = {r.episode_id: (r.status, r.error_message) for r in done.status.collect()}
    assert rows == {1: ("completed", None), 2: ("completed", None), 3: ("failed", "Summarization failed"), 4: ("failed", "Transcription failed"),
                    5: ("failed", "Transcription failed"), 6: ("failed", "Transcription failed"), 7: ("failed", "Audio download failed"),
                    8: ("failed", "Audio download failed")}
    assert {r.episode_id: r.cleaned_text for r in done.transcripts.collect()} == {1: "ONE.\n\nTWO", 2: "bad one", 3: "NOSUM"}
    assert {r.episode_id for r in done.summaries.collect()} == {1, 2}
    assert {(r.outcome, r.n) for r in done.outcomes.collect()} == {("success", 2), ("failed", 6)}
    logs = [(r.stage, r.status, r.message) for r in done.logs.filter("episode_id = 3").orderBy("seq").collect()]
    assert logs == [("download", "started", None), ("download", "success", "Downloaded to audio/3"), ("transcribe", "started", None),
                    ("transcribe", "success", "Transcribed 5 characters"), ("clean", "started", None), ("clean", "success", "Cleaned 5 characters"),
                    ("summarize", "started", None), ("summarize", "error", "Summarization failed")]
    assert done.logs.filter("episode_id = 8").count() == 2


def test_replies_are_read_strictly_and_element_by_element(spark):
    """One whole JSON object or nothing; an odd element costs no other."""
    good = {'{"host_and_guest":"h"}': "h", ' \n{"host_and_guest":"h"} \n ': "h", '{"host_and_guest":{"a":1}}': '{"a":1}', '{"host_and_guest":7}': "7"}
    bad = ['{"host_and_guest":"h"} trailing', '{"host_and_guest":"h"}{}', '{"host_and_guest":"h"},"whole":true} x', '{"host_and_guest":"h"', '["host_and_guest"]', '"x"', "{}", '{"a":1}',
           '{"host_and_guest":null}', "", None]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "d string")
    found = {r.d: r.s and r.s.host_and_guest for r in df.select("d", fs.decode("d").alias("s")).collect()}
    assert {k: found[k] for k in good} == good and not any(found[k] for k in bad if k != bad[2])
    arrays = {'[{"name":"A","x":1},"B",null,3,{"x":1},["q"]]': ["A", "B", None, "3", None, '["q"]'], "[]": [], "x": [], '{"name":"A"}': [], None: [], "": [], "[1] 2": []}
    df = spark.createDataFrame([(x,) for x in arrays], "d string")
    found = {r.d: [e and e.name for e in r.a] for r in df.select("d", fs.decode_array("company_mentions", "d").alias("a")).collect()}
    assert found == arrays
    df = spark.createDataFrame([('["a",1,null,{"b":2},[3]]',)], "d string")
    assert df.select(fs.decode_array("noteworthy_observations", "d")).first()[0] == ["a", "1", None, '{"b":2}', "[3]"]


class Flaky:
    """Fails on its first calls with a prompt, then answers; notes every call in a folder."""

    def __init__(self, folder: str, failures: int):
        self.folder, self.failures = pathlib.Path(folder), failures

    def __call__(self, prompt: str) -> str:
        (self.folder / f"{prompt}-{uuid.uuid4().hex}").touch()
        if len(list(self.folder.glob(f"{prompt}-*"))) <= self.failures:
            raise ConnectionError("try later")
        return prompt.upper()


def test_replies_are_stored_and_failed_calls_tried_again(spark, tmp_path):
    store = inference.reply_store(spark, str(tmp_path / "store"))
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, text string").repartition(3)

    def run(folder, failures, **calls):
        (tmp_path / folder).mkdir(exist_ok=True)
        rows = inference.apply_stored(prompts, "text", Flaky, store, "flaky", calls=calls, folder=str(tmp_path / "calls"), failures=failures).collect()
        return {r.id: (r.reply, r.error) for r in rows}

    wrong = "ConnectionError: try later"
    (tmp_path / "calls").mkdir()
    assert run("x", 2) == {1: (None, wrong), 2: (None, wrong), 3: (None, wrong), 4: (None, None)}
    assert len(list((tmp_path / "calls").iterdir())) == 2  # equal prompts are asked once
    answered = {1: ("A", None), 2: ("B", None), 3: ("A", None), 4: (None, None)}
    assert run("x", 2, attempts=3, wait=0.01, workers=2) == answered
    made = len(list((tmp_path / "calls").iterdir()))
    assert made == 6
    assert run("x", 2) == answered and len(list((tmp_path / "calls").iterdir())) == made
    # Other options are another question.
    assert run("x", 99)[1] == (None, wrong)


def _written(spark):
    folder = storage.shared_dir(spark).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.startswith("table-")} if os.path.isdir(folder) else set()


def test_only_tables_that_are_asked_for_are_worked_out(spark):
    """The numbering of summaries sorts and writes their texts, which no caller pays for who wants the status."""
    t = Tables(spark, "/root/testdata/sf0.001")
    before = _written(spark)
    done = pipelines.processed(t)
    assert len(_written(spark) - before) == 3  # the work, the cleaned chunks, the results
    assert done.status.count() == t.given("documents").count() and len(_written(spark) - before) == 3
    assert done.summaries.count() > 0 and len(_written(spark) - before) > 3


def test_a_task_holds_a_piece_of_a_batch(spark):
    """A batch of many long texts is turned into Python strings piece by piece, which pandas would do with all of it at once."""
    texts = spark.range(3000, numPartitions=1).select("id", F.repeat(F.lit("long "), 800).alias("text"))
    asked = apply_model(texts, "text", Sizes, batch_size=16)
    assert "MapInArrow" in asked._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.reply, r.error) for r in asked.collect()) == [(i, "4000", None) for i in range(3000)]


class Sizes:
    def __call__(self, prompts):
        return [str(len(p)) for p in prompts]


def test_stored_replies_read_the_prompts_twice_at_most(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    prompts = spark.range(40, numPartitions=2).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("text"))
    store = inference.reply_store(spark, str(tmp_path / "store"))
    rows = inference.apply_stored(prompts.mapInArrow(counted, prompts.schema), "text", Mirror, store, "mirror").collect()
    assert sorted((r.id, r.reply) for r in rows) == [(i, f"p{i}"[::-1]) for i in range(40)]
    assert seen.value <= 80


class Mirror:
    def __call__(self, prompt):
        return prompt[::-1]
