"""Parts that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samplelake.session import materialise

BLOCK_ROWS = 50_000
#: Rows that a Python worker unpacks at once.
SLICE_ROWS = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that the operators need, so that no other column can clash."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, Sequence]], schema: str) -> DataFrame:
    """Row-local Python work on Arrow batches; ``work`` returns the columns of ``schema``, in
    its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield pa.RecordBatch.from_pydict(work(batch.slice(at, SLICE_ROWS)))

    return df.mapInArrow(run, schema)


def number_rows(
    stored: DataFrame, group: Sequence[str], key: Sequence[str], name: str, *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Gapless numbers from 0 within each group, for groups of any size.

    Rows are dealt into blocks by a hash of ``key``, numbered inside their block, and moved by
    the sizes of the group's earlier blocks, so no task sees a whole group. ``stored`` must be a
    stored table, as it is read twice; rows with equal keys are numbered in any order.
    """
    blocks = max(1, stored.count() // block_rows)
    dealt = stored.withColumn("__block", F.pmod(F.xxhash64(*key), F.lit(blocks)))
    places = [*group, "__block"]
    counts = dealt.groupBy(*places).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(
        counts.select(*places, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")), "block-offsets"
    )
    inside = F.row_number().over(Window.partitionBy(*places).orderBy(*key)) - 1
    numbered = dealt.withColumn("__inside", inside.cast("bigint"))
    same = [numbered[c].eqNullSafe(offsets[c]) for c in places]
    joined = numbered.join(offsets, [*same], "inner")
    return joined.select(*[numbered[c] for c in stored.columns], (F.col("__inside") + F.col("__before")).alias(name))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores before it if the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def packed(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text``: all columns but the text as one, so that no name inside it can
    clash with those of an operator; the id as a number and the text as a string."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(
        F.struct(*rest).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` from ``row`` and ``text``."""
    kinds = dict(like.dtypes)
    return df.select(*[
        (F.col("text") if c == "text" else F.col("row").getField(c)).cast(kinds[c]).alias(c) for c in like.columns
    ])
