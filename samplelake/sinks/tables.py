"""Tables, matrices and workflow results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplelake.operators.graph import attach_tools, edges, topo_layers
from samplelake.operators.joins import join_dim
from samplelake.sources.matrices import Matrix

# The options a reader needs to get back what ``write_table`` wrote as CSV.
CSV_OPTIONS = {"header": "true", "quoteAll": "true", "escape": '"', "encoding": "UTF-8"}
CSV_READ = {"header": "true", "multiLine": "true", "escape": '"', "encoding": "UTF-8"}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a frame as csv, json or parquet, one part per task. CSV quotes every value, since
    raw metadata holds line breaks; JSON keeps letters of any script and nulls."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", "false").json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}: csv, json or parquet")


def write_matrix(matrix: Matrix, path: str, mode: str = "errorifexists") -> None:
    """Parquet folders ``entries``, ``cells`` and ``genes``, in parts by sample. The entries of
    one sample are spread by cell, so a large sample is many files of many tasks."""
    entries = matrix.entries.repartition("sample", F.floor(F.col("cell_ix") / 10_000))
    for name, table in (("entries", entries), ("cells", matrix.cells), ("genes", matrix.genes)):
        table.write.mode(mode).partitionBy("sample").parquet(f"{path}/{name}")


def write_workflow(tasks: DataFrame, results: DataFrame, documents: DataFrame, path: str, fmt: str = "parquet") -> None:
    """``nodes``: the tasks of each of ``documents(doc_id)`` with layer, tool and
    ``has_tool_info``; ``edges``."""
    links = edges(tasks)
    layers = topo_layers(links, tasks.select(F.col("id").cast("bigint").alias("id")))
    nodes = join_dim(attach_tools(tasks, results, documents), layers, "id")
    write_table(nodes, f"{path}/nodes", fmt)
    write_table(links, f"{path}/edges", fmt)
