"""Ordered task scan: where in a document does each task of a workflow occur?

The tasks are taken in visit order with a cursor over the document's chunks. A task is
looked for from the cursor on; a hit leaves the cursor on the hit's chunk, a miss leaves it
where it was. Documents are independent, so both forms work row by row without a shuffle.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplelake.functions.reply_text import read_reply
from samplelake.functions.text import let
from samplelake.session import new_table_path

# The fields of a tool, with the type named in a prompt.
TOOL_FIELDS = (("tool_name", "str"), ("version", "str"), ("description", "str"), ("parameters", "dict"))
CELL_TYPE_FIELDS = (*TOOL_FIELDS, ("analyzed_cell_types", "list[str]"))
FIELDS_BY_TYPE = {"process": TOOL_FIELDS, "cell_type_process": CELL_TYPE_FIELDS}

TOOL_TYPE = (
    "struct<tool_name:string,version:string,description:string,parameters:string,"
    "analyzed_cell_types:array<string>>"
)


@dataclass(frozen=True)
class ScanTask:
    """One task of a workflow, with what a prompt says about it."""

    task_id: int
    task_name: str
    type: str = "process"
    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    keyword: str | None = None


def scan_keywords(
    docs: DataFrame, tasks: Sequence[ScanTask], *, key: str = "doc_id", chunks: str = "chunks"
) -> DataFrame:
    """Scan with each task's ``keyword`` (any case) as the test: built-in columns only.

    One fold per document over its chunk array; the task list is a workflow's own, a few
    dozen entries that become literals of the plan.
    """
    missing = [t.task_id for t in tasks if not t.keyword]
    if missing:
        raise ValueError(f"tasks without a keyword: {missing}")
    plan = F.array(
        *[
            F.struct(
                F.lit(t.task_id).cast("bigint").alias("task_id"),
                F.lit(t.task_name).alias("task_name"),
                F.lit(t.keyword.lower()).alias("keyword"),
            )
            for t in tasks
        ]
    )
    found = "array<struct<task_id:bigint,task_name:string,chunk_no:int,tool_name:string>>"
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast(found).alias("found"))

    def fold(texts: Column) -> Column:
        def step(state: Column, task: Column) -> Column:
            hits = F.transform(
                texts, lambda text, i: F.when((i >= state["cursor"]) & F.contains(text, task["keyword"]), i)
            )
            return let(F.array_min(hits), lambda at: F.when(at.isNull(), state).otherwise(moved(state, task, at)))

        def moved(state: Column, task: Column, at: Column) -> Column:
            row = F.struct(
                task["task_id"].alias("task_id"),
                task["task_name"].alias("task_name"),
                at.alias("chunk_no"),
                task["keyword"].alias("tool_name"),
            )
            return F.struct(at.alias("cursor"), F.concat(state["found"], F.array(row)).alias("found"))

        return F.aggregate(plan, start, step, lambda s: s["found"])

    lowered = F.transform(chunks, lambda c: F.lower(c["text"]))
    scanned = docs.select(key, let(lowered, fold).alias("__found"))
    # outer: see pack_chunks
    rows = scanned.select(key, F.explode_outer("__found").alias("__f")).filter("__f IS NOT NULL")
    return rows.select(key, "__f.task_id", "__f.task_name", "__f.chunk_no", "__f.tool_name")


def task_prompt(chunk: str, task: ScanTask, tools: Sequence[dict]) -> str:
    """What a model is asked about one chunk and one task."""
    fields = ",\n".join(f'    "{name}": {kind} or null' for name, kind in FIELDS_BY_TYPE[task.type])
    lines = [
        "Below is part of a paper, taken from a PDF. Say whether it describes the task named here, "
        "and with which software.",
        f"Task: {task.task_name}",
        "It follows: " + ("; ".join(task.before) or "nothing"),
        "It leads to: " + ("; ".join(task.after) or "nothing"),
    ]
    if tools:
        lines.append("Tools known so far:")
        lines.extend(json.dumps(tool, ensure_ascii=False) for tool in tools)
    lines += [
        "Text:",
        chunk,
        "Answer with one fenced json block of this form; tool_info is null if the task is not described:",
        f'```json\n{{\n  "task_exists": bool,\n  "task_name": str,\n  "tool_info": {{\n{fields}\n  }}\n}}\n```',
    ]
    return "\n".join(lines)


def _is_text(value) -> bool:
    return value is None or isinstance(value, str)


def valid_task_reply(reply: dict, task_type: str) -> bool:
    """``task_exists`` and ``task_name`` are there; if the task exists, all tool fields are, with
    their types (null allowed)."""
    if "task_exists" not in reply or "task_name" not in reply:
        return False
    if not reply["task_exists"]:
        return True
    tool = reply.get("tool_info")
    if not isinstance(tool, dict) or any(name not in tool for name, _ in FIELDS_BY_TYPE[task_type]):
        return False
    cell_types = tool.get("analyzed_cell_types")
    return (
        all(_is_text(tool[n]) for n in ("tool_name", "version", "description"))
        and isinstance(tool["parameters"], (dict, type(None)))
        and (cell_types is None or (isinstance(cell_types, list) and all(map(_is_text, cell_types))))
    )


@dataclass
class _Scan:
    """State of one document: the cursor, the tools so far, and the rows to hand on."""

    ask: Callable[[str], str]
    retries: int
    cursor: int = 0
    tools: list[dict] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)

    def reply(self, chunk: str, task: ScanTask) -> dict | None:
        prompt, problem = task_prompt(chunk, task, self.tools), "no attempt made"
        for _ in range(self.retries):
            try:
                answer = read_reply(self.ask(prompt))
            except ValueError as error:
                problem = f"unreadable reply: {error}"
                continue
            except Exception as error:  # the caller's function may raise anything
                problem = f"{type(error).__name__}: {error}"
                break
            if valid_task_reply(answer, task.type):
                return answer
            problem = "reply lacks a field or has a wrong type"
        raise ValueError(problem)

    def look_for(self, task: ScanTask, chunks: Sequence[str]) -> None:
        for at in range(self.cursor, len(chunks)):
            answer = self.reply(chunks[at], task)
            if answer["task_exists"] and answer["task_name"] == task.task_name:
                tool = {name: answer["tool_info"].get(name) for name, _ in FIELDS_BY_TYPE[task.type]}
                self.tools.append({"task_name": task.task_name, **tool})
                parameters = tool["parameters"]
                text = None if parameters is None else json.dumps(parameters, ensure_ascii=False)
                self.rows.append((task.task_id, task.task_name, at, {**tool, "parameters": text}, None))
                self.cursor = at
                return


def scan_tasks(
    docs: DataFrame,
    tasks: Sequence[ScanTask],
    responder: Callable[[str], str],
    *,
    key: str = "doc_id",
    chunks: str = "chunks",
    retries: int = 3,
    parallel: int | None = None,
    store: str | None = None,
) -> DataFrame:
    """Scan with a model as the test: ``key, task_id, task_name, chunk_no, tool, error``.

    ``responder`` is asked per (task, chunk) up to the first hit and again on an unreadable
    reply, ``retries`` times in all; then the task has a row with ``error`` alone, and the
    scan goes on with the next task where the last hit was. Replies may differ from call to
    call, so the rows are written once to the shared folder and read back, never computed
    twice. With a ``store``, a document whose text was scanned before for the same tasks, without
    an error, is not scanned again.
    """
    unknown = [(t.task_id, t.type) for t in tasks if t.type not in FIELDS_BY_TYPE]
    if unknown:
        raise ValueError(f"tasks of a type that has no tool: {unknown}")
    plan = tuple(tasks)
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, task_id bigint, task_name string, chunk_no int, tool {TOOL_TYPE}, error string"
    stored_schema = f"{schema}, __mark string, __done boolean"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, mark, texts in zip(batch[key], batch["__mark"], batch["__texts"]):
                state, failed = _Scan(responder, retries), False
                for task in plan:
                    try:
                        state.look_for(task, texts)
                    except ValueError as error:
                        failed = True
                        state.rows.append((task.task_id, task.task_name, None, None, str(error)))
                rows.extend((name, *row, mark, False) for row in state.rows)
                if not failed:
                    rows.append((name, None, None, None, None, None, mark, True))
            names = [key, "task_id", "task_name", "chunk_no", "tool", "error", "__mark", "__done"]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"task_id": "Int64", "chunk_no": "Int32", "__done": "boolean"})

    texts = docs.select(key, F.transform(chunks, lambda c: c["text"]).alias("__texts"))
    # The document, its text and the tasks.
    whole = F.to_json(F.struct(F.lit(repr(plan)).alias("plan"), F.col(key).alias("key"), F.col("__texts").alias("texts")))
    texts = texts.withColumn("__mark", F.sha2(whole, 256))
    spark, kept = docs.sparkSession, None
    before = _stored(spark, store, stored_schema) if store else None
    if before is not None:
        done = before.filter("__done").select("__mark").distinct()
        known = done.join(texts.select("__mark"), "__mark", "left_semi")
        kept = before.filter("NOT __done").join(known, "__mark", "left_semi")
        texts = texts.join(done, "__mark", "left_anti")
    if parallel:
        texts = texts.repartition(parallel)
    path = f"{store}/run={uuid.uuid4().hex}" if store else new_table_path(spark, "task-results")
    texts.select(key, "__mark", "__texts").mapInPandas(scan, stored_schema).write.parquet(path)
    fresh = spark.read.schema(stored_schema).parquet(path).filter("NOT __done")
    every = fresh if kept is None else kept.select(fresh.columns).unionByName(fresh)
    return every.drop("__mark", "__done")


def _stored(spark: SparkSession, store: str, schema: str) -> DataFrame | None:
    """What earlier runs left in the store; none if there was no run."""
    try:
        return spark.read.schema(schema).parquet(f"{store}/run=*").select(*[f"`{n}`" for n in _names(schema)])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _names(schema: str) -> list[str]:
    return T.StructType.fromDDL(schema).names
