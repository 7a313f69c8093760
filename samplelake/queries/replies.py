"""Reply parsing and stored replies."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplelake.functions.replies import clean_json, extract_fenced, field, has_fields, parse_lenient
from samplelake.functions.text import let
from samplelake.operators.infer import infer
from samplelake.operators.summary import Summary
from samplelake.queries.registry import query, table
from samplelake.session import new_table_path, spread

# Replies of four forms made from the events: fenced with comments and Python literals,
# unfenced, cut off, and with a wrong type.
REPLIES_SQL = r"""
replies AS (
  SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type,
    CASE CAST(json_extract(props, '$.k') AS INTEGER) % 4
      WHEN 0 THEN E'Reasons.\n```JSON\n{"task_exists": True, // seen\n "task_name": "' || event_type || E'", "url": "http://x/' || event_id || E'"}\n```\nBye'
      WHEN 1 THEN E' {"task_exists": False, "task_name": "' || event_type || E'", "url": null} '
      WHEN 2 THEN E'```json\n{"task_exists": true, "task_name": \n```'
      ELSE E'```json\n{"task_exists": ' || event_id || E', "url": "' || event_type || E'"}\n```'
    END AS text
  FROM events
)
"""


def _replies(spark: SparkSession, folder: str) -> DataFrame:
    events = spread(table(spark, folder, "events").select("event_id", "event_type", "props"))
    k = F.get_json_object("props", "$.k").cast("int")
    number = F.col("event_id").cast("string")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit('Reasons.\n```JSON\n{"task_exists": True, // seen\n "task_name": "'), F.col("event_type"),
                                    F.lit('", "url": "http://x/'), number, F.lit('"}\n```\nBye')))
        .when(k % 4 == 1, F.concat(F.lit(' {"task_exists": False, "task_name": "'), F.col("event_type"), F.lit('", "url": null} ')))
        .when(k % 4 == 2, F.lit('```json\n{"task_exists": true, "task_name": \n```'))
        .otherwise(F.concat(F.lit('```json\n{"task_exists": '), number, F.lit(', "url": "'), F.col("event_type"), F.lit('"}\n```')))
    )
    return events.select("event_id", text.alias("text"))


@query(
    rf"""
    WITH {REPLIES_SQL},
    bodies AS (
      SELECT event_id, text,
             trim(CASE WHEN regexp_matches(text, '```json\b(.*?)```', 'si') THEN regexp_extract(text, '```json\b(.*?)```', 1, 'si') ELSE text END, E' \n') AS body
      FROM replies
    )
    SELECT event_id, body,
           replace(replace(regexp_replace(body, ' // seen', ' ', 'g'), ': True', ': true'), ': False', ': false') AS json
    FROM bodies
    """
)
def clean_replies(spark: SparkSession, folder: str) -> DataFrame:
    rows = _replies(spark, folder)
    return rows.select(
        "event_id", extract_fenced(F.col("text"), "json").alias("body"), clean_json(F.col("text")).alias("json")
    )


@query(
    f"""
    WITH {REPLIES_SQL}
    SELECT event_id, k % 4 <> 2 AS is_json, k % 4 IN (0, 1) AS valid,
           CASE k % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 3 THEN event_id::VARCHAR END AS task_exists,
           CASE WHEN k % 4 IN (0, 1) THEN event_type END AS task_name,
           CASE k % 4 WHEN 0 THEN 'http://x/' || event_id WHEN 3 THEN event_type END AS url
    FROM replies
    """
)
def parsed_replies(spark: SparkSession, folder: str) -> DataFrame:
    def columns(value):
        return F.struct(
            value.isNotNull().alias("is_json"),
            has_fields(value, {"task_exists": "boolean", "task_name": "string"}).alias("valid"),
            field(value, "task_exists").alias("task_exists"),
            field(value, "task_name").alias("task_name"),
            field(value, "url").alias("url"),
        )

    rows = _replies(spark, folder)
    return rows.select("event_id", let(parse_lenient(F.col("text")), columns).alias("r")).select("event_id", "r.*")


def counting_model(prompt: str) -> str:
    """A stand-in for a chat model: the number of words."""
    return json.dumps({"words": len(prompt.split())})


@query(
    r"""
    WITH first AS (SELECT DISTINCT text FROM documents JOIN labels USING (doc_id)),
    whole AS (SELECT DISTINCT text FROM documents)
    SELECT sha256(w.text) AS prompt_key, len(regexp_extract_all(w.text, '\S+')) AS n_tokens_in, 2 AS n_tokens_out,
           '{"words": ' || len(regexp_extract_all(w.text, '\S+')) || '}' AS text, f.text IS NOT NULL AS stored
    FROM whole w LEFT JOIN first f ON f.text = w.text
    """
)
def stored_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents are asked about first; a second run asks about the others only."""
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("prompt_key"), F.col("text").alias("prompt"))
    labelled = docs.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    cores = spark.sparkContext.defaultParallelism
    store = new_table_path(spark, "store")
    early = infer(labelled, counting_model, store=store, parallel=cores).select("prompt_key", F.lit(True).alias("early"))
    replies = infer(docs, counting_model, store=store, parallel=cores)
    marked = replies.join(early, "prompt_key", "left")
    return marked.select(
        "prompt_key", "n_tokens_in", "n_tokens_out", "text", F.coalesce("early", F.lit(False)).alias("stored")
    )


def unsteady_model(prompt: str) -> str:
    """A stand-in that answers prompts with an odd number of words only."""
    return counting_model(prompt) if len(prompt.split()) % 2 else "none"


@query(
    r"""
    WITH asked AS (SELECT text, len(regexp_extract_all(text, '\S+')) AS words FROM (SELECT DISTINCT text FROM documents)),
    sums AS (
      SELECT count(*) AS n, count(*) FILTER (words % 2 = 0) AS failed, sum(words)::BIGINT AS tokens FROM asked
    )
    SELECT unnest(['prompts', 'replies', 'replies', 'replies', 'replies', 'replies']) AS item,
           unnest(['rows', 'rows', 'errors', 'calls', 'tokens_in', 'tokens_out']) AS metric,
           unnest([n, n, failed, n + 2 * failed, tokens, 2 * n - failed]) AS n FROM sums
    """
)
def reply_summary(spark: SparkSession, folder: str) -> DataFrame:
    """What was asked and paid for: a prompt without a valid reply is tried three times. Several calls
    are made at a time in each task."""
    docs = table(spark, folder, "documents").select(F.sha2("text", 256).alias("prompt_key"), F.col("text").alias("prompt"))
    summary = Summary()
    infer(docs, unsteady_model, retries=3, parallel=spark.sparkContext.defaultParallelism, in_flight=4, summary=summary)
    return summary.table(spark)
