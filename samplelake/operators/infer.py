"""Batch inference: one call per distinct prompt, replies kept in a table.

Replies are not deterministic, so they are always written before anything reads them; a
plan that parses replies starts from files. Turn ``spark.speculation`` off for this stage,
or prompts may be sent twice.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplelake.functions.replies import is_object, parse_lenient
from samplelake.functions.reply_text import read_reply
from samplelake.functions.text import WordCounter, word_count
from samplelake.operators.summary import Summary
from samplelake.session import new_table_path

TASK_PROMPTS, RUN_PROMPTS = 100, 100_000
#: Files of prompts that a run reads, or a few more.
RUN_FILES = 10

Responder = Callable[[str], str]
Validator = Callable[[dict], bool]

REPLY = "prompt_key string, attempt int, text string, error string, n_tokens_in bigint, n_tokens_out bigint"
COLUMNS = [f.split()[0] for f in REPLY.split(", ")]


@dataclass(frozen=True)
class _Caller:
    """Asks for one reply; tries again as long as it is not valid."""

    responder: Responder
    validator: Validator | None
    retries: int
    error_marker: str | None
    check: bool

    def __call__(self, prompt: str) -> tuple[int, str | None, str | None]:
        text, problem = None, None
        for attempt in range(1, self.retries + 1):
            try:
                text = self.responder(prompt)
            except Exception as error:  # the caller's function may raise anything
                return attempt, None, f"{type(error).__name__}: {error}"
            if not isinstance(text, str):
                return attempt, None, f"the reply is a {type(text).__name__}, not text"
            if self.error_marker and self.error_marker in text:
                return attempt, text, f"the reply says {self.error_marker}"
            if not self.check:
                return attempt, text, None
            try:
                value = read_reply(text)
                if self.validator is None or self.validator(value):
                    return attempt, text, None
                problem = "the reply was not accepted"
            except ValueError as error:
                problem = f"unreadable reply: {error}"
        return self.retries, text, problem


def in_order(call: Callable, items: Iterable, most: int) -> Iterator:
    """``call`` of each item, in their order, up to ``most`` of them at a time; none is begun before
    there is room for it."""
    if most == 1:
        yield from map(call, items)
        return
    with ThreadPoolExecutor(most) as pool:
        waiting: deque = deque()
        for item in items:
            if len(waiting) == most:
                yield waiting.popleft().result()
            waiting.append(pool.submit(call, item))
        while waiting:
            yield waiting.popleft().result()


def read_replies(spark: SparkSession, store: str) -> DataFrame | None:
    """The reply table, or None if there is none yet. Each run has a folder of its own in it,
    whose files appear when the run's job is committed."""
    try:
        return spark.read.schema(REPLY).parquet(store).select(*COLUMNS)
    except AnalysisException:
        return None


def cached(replies: DataFrame) -> DataFrame:
    """One good reply per prompt; of several the smallest text, so that runs agree."""
    rest = [c for c in COLUMNS if c != "prompt_key"]
    smallest = F.min(F.struct("text", *[c for c in rest if c != "text"])).alias("r")
    good = replies.filter(F.col("error").isNull()).groupBy("prompt_key").agg(smallest)
    return good.select("prompt_key", *[F.col(f"r.{c}").alias(c) for c in rest])


def _runs(stored: DataFrame, path: str) -> list[tuple[int, DataFrame]]:
    """Runs of about ``RUN_PROMPTS`` of the prompts stored in ``path`` and how many each has, whole files to a run.
    The driver has the names of the files."""
    spark = stored.sparkSession
    sizes = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n")).orderBy("file").collect()
    total = sum(r["n"] for r in sizes)
    runs = total // RUN_PROMPTS
    if runs < 2:
        return [(total, stored)]
    names, numbers, before = [[] for _ in range(runs)], [0] * runs, 0
    for r in sizes:
        run = before * runs // total
        names[run].append(f"{path}/{r['file']}")
        numbers[run] += r["n"]
        before += r["n"]
    return [(n, spark.read.schema(stored.schema).parquet(*own)) for n, own in zip(numbers, names, strict=True)]


def infer(
    prompts: DataFrame,
    responder: Responder,
    validator: Validator | None = None,
    store: str | None = None,
    retries: int = 3,
    *,
    parallel: int | None = None,
    in_flight: int = 1,
    check: bool = True,
    error_marker: str | None = None,
    token_count: WordCounter = word_count,
    summary: Summary | None = None,
) -> DataFrame:
    """Replies for ``prompts(prompt_key, prompt)``, one row per distinct key.

    A key with a good reply in ``store`` is not asked again; new replies are added to it. A
    prompt that stays without a valid reply after ``retries`` tries has its ``error`` set and
    is asked again in the next run. Replies are written in runs of about ``RUN_PROMPTS`` prompts,
    so a job that fails keeps those of the runs before. ``parallel`` bounds the number of tasks;
    without it there is a task per ``TASK_PROMPTS`` prompts. A task waits for up to ``in_flight``
    replies at a time, in threads, so ``responder`` must bear that if it is over 1.
    ``check=False`` takes any text for valid. ``summary`` is told of prompts, hits, replies, errors
    and tokens as they are written.
    """
    if in_flight < 1:
        raise ValueError("in_flight is 1 or more")
    spark, summary = prompts.sparkSession, summary or Summary()
    wanted = prompts.select("prompt_key", "prompt").dropDuplicates(["prompt_key"])
    before = read_replies(spark, store) if store else None
    hits = None
    missing = wanted
    if before is not None:
        hits = cached(before.join(prompts.select("prompt_key").distinct(), "prompt_key", "left_semi"))
        hits = summary.stored(hits, "stored replies")
        known = before.filter(F.col("error").isNull()).select("prompt_key")
        missing = wanted.join(known, "prompt_key", "left_anti")
    # Stored in files of a part of a run, so a run is some of them and no prompt is dealt again.
    path = new_table_path(spark, "prompts")
    summary.watch(missing, "prompts").write.option("maxRecordsPerFile", max(1, RUN_PROMPTS // RUN_FILES)).parquet(path)
    dealt = _runs(spark.read.schema(missing.schema).parquet(path), path)
    caller = _Caller(responder, validator, retries, error_marker, check)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TASK_PROMPTS):
                some = batch.iloc[at : at + TASK_PROMPTS]
                replies = in_order(caller, some["prompt"], in_flight)
                rows = [(k, p, *r) for k, p, r in zip(some["prompt_key"], some["prompt"], replies, strict=True)]
                yield pd.DataFrame(rows, columns=["prompt_key", "prompt", "attempt", "text", "error"])

    paths = []
    for n, run in dealt:
        # Tasks by the number of prompts, whatever their size.
        own = run.repartition(parallel or max(1, -(-n // TASK_PROMPTS)), "prompt_key")
        asked = own.mapInPandas(ask, "prompt_key string, prompt string, attempt int, text string, error string")
        paths.append(f"{store}/run={uuid.uuid4().hex}" if store else new_table_path(spark, "replies"))
        told = asked.select(
            "prompt_key",
            "attempt",
            "text",
            "error",
            token_count(F.col("prompt")).cast("bigint").alias("n_tokens_in"),
            F.coalesce(token_count(F.col("text")), F.lit(0)).cast("bigint").alias("n_tokens_out"),
        )
        summary.watch(
            told, "replies", errors=F.count("error"), calls=F.sum("attempt"), tokens_in=F.sum("n_tokens_in"), tokens_out=F.sum("n_tokens_out")
        ).write.parquet(paths[-1])
    fresh = spark.read.schema(REPLY).parquet(*paths)
    return fresh if hits is None else hits.unionByName(fresh)


def parse_replies(replies: DataFrame) -> DataFrame:
    """``prompt_key, valid, value``: the reply's JSON object as VARIANT; ``valid`` is false for
    an error or anything but an object, and ``value`` null."""
    value = F.when(F.col("error").isNull(), parse_lenient(F.col("text")))
    parsed = replies.select("prompt_key", value.alias("value"))
    return parsed.select(
        "prompt_key",
        is_object(F.col("value")).alias("valid"),
        F.when(is_object(F.col("value")), F.col("value")).alias("value"),
    )


def reply_errors(replies: DataFrame) -> DataFrame:
    """``stage, prompt_key, message`` for the prompts that stayed without a good reply."""
    unread = F.when(~is_object(parse_lenient(F.col("text"))), F.lit("the reply is no readable JSON object"))
    message = F.coalesce(F.col("error"), unread)
    return replies.select(F.lit("infer").alias("stage"), "prompt_key", message.alias("message")).filter("message IS NOT NULL")
