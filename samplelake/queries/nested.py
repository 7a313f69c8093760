"""Flattening, unique names, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplelake.operators.flatten import flatten_nested, typed_json
from samplelake.operators.ordered import make_unique
from samplelake.queries.registry import query, table
from samplelake.session import new_table_path
from samplelake.sinks.tables import CSV_READ, write_table


@query(
    """
    SELECT l.l_orderkey AS "head.order", l.l_suppkey AS "head.supplier.key", l.l_linenumber, f.flag AS flags,
           m.name AS "measures.name", m.value AS "measures.value"
    FROM lineitem l
    CROSS JOIN LATERAL (SELECT l.l_returnflag AS flag UNION ALL SELECT l.l_linestatus) f
    LEFT JOIN LATERAL (
      SELECT 'quantity' AS name, l.l_quantity AS value WHERE l.l_discount > 0
      UNION ALL SELECT 'tax', l.l_tax WHERE l.l_discount > 0
    ) m ON true
    """
)
def flat_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Two arrays per row, one of structs and sometimes empty, and a struct in a struct."""
    lines = table(spark, folder, "lineitem")
    measures = F.array(
        F.struct(F.lit("quantity").alias("name"), F.col("l_quantity").alias("value")),
        F.struct(F.lit("tax").alias("name"), F.col("l_tax").alias("value")),
    )
    nested = lines.select(
        F.struct(F.col("l_orderkey").alias("order"), F.struct(F.col("l_suppkey").alias("key")).alias("supplier")).alias("head"),
        "l_linenumber",
        F.when(F.col("l_discount") > 0, measures).alias("measures"),
        F.array("l_returnflag", "l_linestatus").alias("flags"),
    )
    return flatten_nested(nested)


@query("""SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events""")
def flat_event_props(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "event_type", "props")
    return flatten_nested(typed_json(events, "props"))


@query(
    """
    SELECT p_partkey, p_name || CASE WHEN k > 0 THEN '-' || k ELSE '' END AS p_name FROM (
      SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part
    )
    """
)
def unique_part_names(spark: SparkSession, folder: str) -> DataFrame:
    return make_unique(table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query(
    """
    SELECT l_orderkey, l_suppkey, n, l_linestatus || CASE WHEN k > 0 THEN '-' || k ELSE '' END AS name FROM (
      SELECT l_orderkey, l_suppkey, l_linestatus, count(*) AS n,
             row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey, l_suppkey) - 1 AS k
      FROM lineitem GROUP BY l_orderkey, l_suppkey, l_linestatus
    )
    """
)
def unique_status_names(spark: SparkSession, folder: str) -> DataFrame:
    """Two names over all rows: every group is hot."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_suppkey", "l_linestatus").agg(F.count("*").alias("n"))
    return make_unique(lines.withColumnRenamed("l_linestatus", "name"), "name", ["l_orderkey", "l_suppkey"])


@query("SELECT doc_id, text, lang FROM documents")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    path = new_table_path(spark, "csv")
    write_table(docs, path, "csv")
    return spark.read.options(**CSV_READ).schema(docs.schema).csv(path)


@query("SELECT doc_id, text, quality::VARCHAR AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = docs.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    path = new_table_path(spark, "json")
    write_table(rows, path, "json")
    back = spark.read.schema(rows.schema).json(path)
    return back.withColumn("quality", F.col("quality").cast("string"))
