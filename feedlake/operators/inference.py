"""Run a caller's model over a column of texts."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sinks.keyed import KeyedTable
from ..storage import materialize

Model = Callable[[str], str]
BatchModel = Callable[[list[str]], list[str | None]]

#: Bytes of the rows that a task turns into Python strings at a time, unless the workers need more rows.
PIECE_BYTES = 1 << 20


def _text_or_error(answer) -> tuple[str | None, str | None]:
    if answer is None or isinstance(answer, str):
        return answer, None
    return None, f"TypeError: the reply is {type(answer).__name__}, not str"


def apply_model(
    df: DataFrame,
    text: str,
    make_model: Callable[..., Model | BatchModel],
    reply: str = "reply",
    error: str = "error",
    partitions: int | None = None,
    batch_size: int | None = None,
    attempts: int = 1,
    wait: float = 1.0,
    workers: int = 1,
    **options,
) -> DataFrame:
    """Replace the column ``text`` by the model's ``reply`` and an ``error`` text.

    ``make_model(**options)`` is called once per task and returns a function from prompt to reply, for example a client of a hosted
    model with ``temperature`` and ``max_tokens``; if it fails, the task fails, since no row could be answered. With ``batch_size`` the
    function takes a list of at most so many prompts, which it may send at once, and returns a list of as many replies. A row that
    fails, or whose reply is no string, gets a NULL reply and its error; the job goes on. So does each row of a batch that fails.
    A call that fails is tried ``attempts`` times in all, ``wait`` seconds after the first failure and twice as long after each further
    one. With ``workers`` above 1 a task has so many calls under way at once; the model must allow that.
    ``partitions`` spreads the rows and so sets how many tasks call the model at a time. Write the result before using it twice: a
    second action would call the model again.
    """
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(reply, T.StringType()), T.StructField(error, T.StringType())])
    names = [f.name for f in kept]
    rows = df.repartition(partitions) if partitions else df

    def ask(model, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        for attempt in range(attempts):
            if attempt:
                time.sleep(wait * 2 ** (attempt - 1))
            try:
                answers = list(model(prompts)) if batch_size else [model(prompts[0])]
                if len(answers) != len(prompts):
                    raise ValueError(f"{len(answers)} replies to {len(prompts)} prompts")
                return [_text_or_error(a) for a in answers]
            except Exception as e:  # bad rows must not end the job
                failure = f"{type(e).__name__}: {e}"
        return [(None, failure)] * len(prompts)

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # A batch may hold thousands of long texts. Their Python strings, prompts and replies are held for one piece of it at a time.
        rows = max(8 * workers * (batch_size or 1), 1 + batch.num_rows * PIECE_BYTES // max(batch.nbytes, 1))
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pool = None, ThreadPoolExecutor(workers) if workers > 1 else None
        call = lambda some: ask(model, [value for _, value in some])
        for batch in (p for whole in batches for p in pieces(whole)):
            found: list[tuple[str | None, str | None]] = [(None, None)] * batch.num_rows
            asked = [(i, value) for i, value in enumerate(batch.column(text).to_pylist()) if value is not None]
            if asked and model is None:
                model = make_model(**options)
            groups = [asked[lo : lo + (batch_size or 1)] for lo in range(0, len(asked), batch_size or 1)]
            for some, answers in zip(groups, (pool.map if pool else map)(call, groups)):
                for (i, _), answer in zip(some, answers):
                    found[i] = answer
            given = [pa.array([f[at] for f in found], pa.string()) for at in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *given], names=[*names, reply, error])

    return rows.mapInArrow(run, schema)


def reply_store(spark: SparkSession, path: str) -> KeyedTable:
    """Replies by the digest of prompt, model and options."""
    return KeyedTable(spark, path, "digest STRING, reply STRING", "digest")


def apply_stored(
    df: DataFrame, text: str, make_model: Callable[..., Model | BatchModel], store: KeyedTable, model: str, reply: str = "reply", error: str = "error",
    calls: dict | None = None, **options,
) -> DataFrame:
    """``apply_model`` that asks no question twice, in this job or a later one.

    A reply is kept under the digest of its prompt, the name ``model`` and the ``options``. Prompts with a stored reply make no call, equal prompts
    make one; what fails is not stored, so that the next run tries it again. ``calls`` are the arguments of ``apply_model`` that do not
    change a reply: ``partitions``, ``batch_size``, ``attempts``, ``wait``, ``workers``. The replies of a run are stored as a whole when all its
    calls are done; a large queue is better given in several runs.
    """
    named = F.lit(json.dumps([model, options], sort_keys=True, default=str))
    asked = df.withColumn("_digest", F.when(F.col(text).isNotNull(), F.sha2(F.concat(named, F.lit("\n"), F.col(text)), 256)))
    # Written without the prompts: what is known is settled on digests, and prompts are moved for the questions that are left only.
    rows = materialize(asked.drop(text))
    digests = rows.select(F.col("_digest").alias("digest")).filter("digest IS NOT NULL")
    unknown = materialize(digests.distinct().join(store.known(digests), "digest", "left_anti"))
    questions = asked.select(F.col("_digest").alias("digest"), F.col(text).alias("prompt")).join(unknown, "digest", "left_semi").dropDuplicates(["digest"])
    answers = materialize(apply_model(questions, "prompt", make_model, "reply", "error", **(calls or {}), **options))
    store.add(answers.filter("reply IS NOT NULL").select("digest", "reply"), 1 + max([v.order for v in store.versions(live=False)], default=0))
    store.compact()
    replies = store.read(digests).select(F.col("digest").alias("_digest"), F.col("reply").alias(reply))
    failed = answers.filter("reply IS NULL").select(F.col("digest").alias("_digest"), F.col("error").alias(error))
    kept = [c for c in df.columns if c != text]
    return rows.join(replies, "_digest", "left").join(failed, "_digest", "left").select(*kept, reply, error)
