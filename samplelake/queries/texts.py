"""Chunks, peeks, scans."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplelake.functions.text import let, peek_lines, text_lines
from samplelake.operators.chunks import pack_chunks, with_chunks
from samplelake.operators.scan import ScanTask, scan_keywords, scan_tasks
from samplelake.queries.registry import query, table
from samplelake.session import spread

LIMIT = 60

# A workflow of ours whose tasks are found by words of the documents' languages, in visit order.
TASKS = tuple(
    ScanTask(i, name, kind, keyword=word)
    for i, (name, kind, word) in enumerate(
        (
            ("English articles", "process", "the "),
            ("German verbs", "process", "und "),
            ("French links", "process", " que"),
            ("Endings", "cell_type_process", "ing"),
            ("Numbers", "process", "1"),
            ("Rare letters", "cell_type_process", "ß"),
            ("Accents", "process", "è"),
            ("Reduced endings", "process", "ion."),
        ),
        start=1,
    )
)

PARTS_SQL = r"""
lines AS (
  SELECT doc_id, u.pos, trim(u.line, E' \t\n\r\f\v') AS line
  FROM documents, UNNEST(string_split(text, E'\n')) WITH ORDINALITY AS u(line, pos)
),
parts AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '\S+')) AS w,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
  FROM lines WHERE line <> ''
)
"""
CHUNKS_SQL = PARTS_SQL + rf""",
fold AS (
  SELECT doc_id, i, w AS n, 0 AS chunk_no FROM parts WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN f.n > {LIMIT} THEN p.w ELSE f.n + p.w END,
         CASE WHEN f.n > {LIMIT} THEN f.chunk_no + 1 ELSE f.chunk_no END
  FROM fold f JOIN parts p ON p.doc_id = f.doc_id AND p.i = f.i + 1
),
chunks AS (
  SELECT f.doc_id, f.chunk_no, string_agg(p.line, E'\n\n' ORDER BY p.i) AS text, CAST(sum(p.w) AS BIGINT) AS n_words
  FROM fold f JOIN parts p ON p.doc_id = f.doc_id AND p.i = f.i
  GROUP BY f.doc_id, f.chunk_no
)
"""


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


@query(f"WITH RECURSIVE {CHUNKS_SQL} SELECT doc_id, chunk_no, text, n_words FROM chunks")
def chunk_packing(spark: SparkSession, folder: str) -> DataFrame:
    chunks = pack_chunks(_documents(spark, folder), min_words=LIMIT, sep="\n")
    return chunks.withColumn("n_words", F.col("n_words").cast("bigint"))


@query(
    r"""
    WITH lines AS (
      SELECT doc_id, string_split(regexp_replace(text, '\r?\n$', ''), E'\n') AS l FROM documents
    ), peeks AS (
      SELECT doc_id, l, len(l) AS total, u.pos, u.line
      FROM lines, UNNEST(l) WITH ORDINALITY AS u(line, pos)
    )
    SELECT doc_id, any_value(total) AS total,
           string_agg(CASE WHEN length(line) > 100
                           THEN substr(line, 1, 100) || '... [' || (length(line) - 100) || ' characters truncated]'
                           ELSE line END, E'\n' ORDER BY pos) AS peek
    FROM peeks WHERE pos <= 10 AND l <> [''] GROUP BY doc_id
    UNION ALL SELECT doc_id, 0, '' FROM lines WHERE l = ['']
    """
)
def document_peeks(spark: SparkSession, folder: str) -> DataFrame:
    def columns(lines):
        return F.struct(
            F.when(F.col("text") == "", 0).otherwise(F.size(lines)).cast("bigint").alias("total"),
            F.array_join(peek_lines(lines), "\n").alias("peek"),
        )

    docs = table(spark, folder, "documents")
    return docs.select("doc_id", let(text_lines(F.col("text")), columns).alias("p")).select("doc_id", "p.*")


def _scan_sql() -> str:
    values = ", ".join(
        f"({t.task_id}, '{t.task_name}', '{t.keyword.lower()}', {i})" for i, t in enumerate(TASKS, start=1)
    )
    return f"""
    WITH RECURSIVE {CHUNKS_SQL},
    tasks(task_id, task_name, word, step) AS (VALUES {values}),
    hits AS (
      SELECT c.doc_id, t.step, c.chunk_no FROM chunks c JOIN tasks t ON contains(lower(c.text), t.word)
    ),
    lists AS (
      SELECT doc_id, step, list(chunk_no ORDER BY chunk_no) AS at FROM hits GROUP BY doc_id, step
    ),
    scan AS (
      SELECT d.doc_id, 0 AS step, 0 AS cur, CAST(NULL AS INTEGER) AS hit FROM (SELECT DISTINCT doc_id FROM chunks) d
      UNION ALL
      SELECT s.doc_id, s.step + 1,
             coalesce(list_min(list_filter(l.at, lambda h: h >= s.cur)), s.cur),
             list_min(list_filter(l.at, lambda h: h >= s.cur))
      FROM scan s LEFT JOIN lists l ON l.doc_id = s.doc_id AND l.step = s.step + 1
      WHERE s.step < {len(TASKS)}
    )
    SELECT s.doc_id, t.task_id, t.task_name, s.hit AS chunk_no
    FROM scan s JOIN tasks t ON t.step = s.step WHERE s.hit IS NOT NULL
    """


@query(_scan_sql())
def task_scan_keywords(spark: SparkSession, folder: str) -> DataFrame:
    chunked = with_chunks(_documents(spark, folder), min_words=LIMIT, sep="\n")
    return scan_keywords(chunked, TASKS).drop("tool_name")


_WORDS = {t.task_name: t.keyword.lower() for t in TASKS}


def keyword_model(prompt: str) -> str:
    """A stand-in for a chat model: the task is there if its word is in the text."""
    name = re.search(r"^Task: (.*)$", prompt, re.MULTILINE).group(1)
    text = prompt.split("\nText:\n", 1)[1].rsplit("\nAnswer with one fenced json block", 1)[0]
    found = _WORDS[name] in text.lower()
    tool = {"tool_name": _WORDS[name], "version": None, "description": None, "parameters": {"n": 1}}
    if "analyzed_cell_types" in prompt:
        tool["analyzed_cell_types"] = ["all"]
    reply = {"task_exists": found, "task_name": name, "tool_info": tool if found else None}
    return f"As asked:\n```json\n{json.dumps(reply)}\n```"


@query(_scan_sql())
def task_scan_replies(spark: SparkSession, folder: str) -> DataFrame:
    chunked = with_chunks(_documents(spark, folder), min_words=LIMIT, sep="\n")
    found = scan_tasks(chunked, TASKS, keyword_model)
    return found.filter(F.col("error").isNull()).select("doc_id", "task_id", "task_name", "chunk_no")


@query(
    f"""
    WITH found AS ({_scan_sql()})
    SELECT d.source, f.task_name, count(*) AS n_documents, min(f.chunk_no) AS first_chunk
    FROM found f JOIN documents d USING (doc_id) GROUP BY d.source, f.task_name
    """
)
def task_hits_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: in how many documents of each source is each task described?"""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "source"))
    chunked = with_chunks(docs, min_words=LIMIT, sep="\n")
    keyed = chunked.withColumn("doc", F.struct("doc_id", "source"))
    hits = scan_keywords(keyed, TASKS, key="doc")
    return hits.groupBy("doc.source", "task_name").agg(
        F.count("*").alias("n_documents"), F.min("chunk_no").alias("first_chunk")
    )
