"""Registration of queries, and the views of the tables they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplelake.functions.text import strip
from samplelake.session import spread

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its name."""

    def add(run: Run) -> Run:
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines_of(text: str):
    """The non-empty lines of a text, trimmed."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def document_attr(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as samples and their sources as series, in the form of an attribute table."""
    docs = spread(table(spark, folder, "documents"))
    labels = table(spark, folder, "labels")
    columns = ["kind", "accession", "key", "key_ord", "pos", "value"]

    def fixed(df: DataFrame, kind: str, accession, key: str, at: int, value) -> DataFrame:
        return df.select(
            F.lit(kind).alias("kind"), accession.alias("accession"), F.lit(key).alias("key"),
            F.lit(at).cast("bigint").alias("key_ord"), F.lit(0).cast("bigint").alias("pos"), value.alias("value"),
        )

    doc = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    entries = F.array(
        F.struct(F.lit("series_id").alias("key"), F.lit(2).alias("at"), F.array("source").alias("vs")),
        F.struct(F.lit("type").alias("key"), F.lit(3).alias("at"), F.array("lang").alias("vs")),
        F.struct(F.lit("description").alias("key"), F.lit(4).alias("at"), lines_of("text").alias("vs")),
    )
    rows = docs.select(doc.alias("accession"), F.explode(entries).alias("e")).select(
        "accession", "e.key", F.col("e.at").cast("bigint").alias("key_ord"), F.posexplode("e.vs").alias("pos", "value")
    )
    samples = rows.select(
        F.lit("SAMPLE").alias("kind"), "accession", "key", "key_ord", F.col("pos").cast("bigint").alias("pos"), "value"
    )
    quality = F.concat(F.lit("Q"), F.col("quality").cast("string"))
    marks = fixed(labels, "SAMPLE", doc, "platform_id", 5, quality)
    series = table(spark, folder, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("lang") == "es", F.col("doc_id"))).alias("es")
    )
    design = F.concat(F.col("n").cast("string"), F.lit(" documents"))
    heads = (
        fixed(series, "SERIES", F.col("source"), "title", 1, F.concat(F.lit("Source "), F.col("source")))
        .unionByName(fixed(series, "SERIES", F.col("source"), "overall_design", 2, design))
        .unionByName(
            fixed(series.filter("es IS NOT NULL"), "SERIES", F.col("source"), "pubmed_id", 3, F.col("es").cast("string"))
        )
    )
    parts = samples.unionByName(marks).unionByName(heads)
    return parts.select(F.lit("documents").alias("file"), *columns)


def document_entities(spark: SparkSession, folder: str) -> DataFrame:
    """One file per source: its series record and then its documents by id."""
    docs = table(spark, folder, "documents")
    samples = docs.select(
        F.col("source").alias("file"), F.lit("SAMPLE").alias("kind"),
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("accession"),
        (F.col("doc_id") + 1).alias("ord"),
    )
    series = docs.select("source").distinct().select(
        F.col("source").alias("file"), F.lit("SERIES").alias("kind"), F.col("source").alias("accession"),
        F.lit(0).cast("bigint").alias("ord"),
    )
    return series.unionByName(samples)


def document_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``file, sample, series, series_file`` of ``document_attr``."""
    return table(spark, folder, "documents").select(
        F.lit("documents").alias("file"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("sample"),
        F.col("source").alias("series"), F.lit("documents").alias("series_file"),
    )


# The same attribute table in SQL.
ATTR_SQL = r"""
doc_lines AS (
  SELECT doc_id, u.pos - 1 AS raw_pos, trim(u.line, E' \t\n\r\f\v') AS line
  FROM documents, UNNEST(string_split(text, E'\n')) WITH ORDINALITY AS u(line, pos)
),
doc_values AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY raw_pos) - 1 AS pos
  FROM doc_lines WHERE line <> ''
),
series AS (
  SELECT source, count(*) AS n, max(CASE WHEN lang = 'es' THEN doc_id END) AS es FROM documents GROUP BY source
),
attr AS (
  SELECT 'SAMPLE' AS kind, 'D' || doc_id AS accession, 'series_id' AS key, 2 AS key_ord, 0 AS pos, source AS value FROM documents
  UNION ALL SELECT 'SAMPLE', 'D' || doc_id, 'type', 3, 0, lang FROM documents
  UNION ALL SELECT 'SAMPLE', 'D' || doc_id, 'description', 4, pos, line FROM doc_values
  UNION ALL SELECT 'SAMPLE', 'D' || doc_id, 'platform_id', 5, 0, 'Q' || quality FROM labels
  UNION ALL SELECT 'SERIES', source, 'title', 1, 0, 'Source ' || source FROM series
  UNION ALL SELECT 'SERIES', source, 'overall_design', 2, 0, n || ' documents' FROM series
  UNION ALL SELECT 'SERIES', source, 'pubmed_id', 3, 0, es::VARCHAR FROM series WHERE es IS NOT NULL
)
"""

