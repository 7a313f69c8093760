"""A corpus from raw documents to packed sequences, in stages.

Every stage is written as Parquet and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplelake.llm import decontam, langid, lines, packing, simhash
from samplelake.llm.common import table, unpacked
from samplelake.llm.queries import QUERIES, query
from samplelake.session import materialise, ship_package

__all__ = ["ORACLE_SQL", "QUERIES", "STAGES", "run"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Below this score a text is taken for no language; a clean text of a few words is above it.
LEAST_SCORE = 0.1
#: No stage but line dedup can be said in SQL.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of their labels; texts without letters go."""
    return langid.without_unknown(docs, langid.learn(docs), LEAST_SCORE)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier runs; those that consist of them go."""
    done = lines.edited(docs)
    some = unpacked(done.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))), docs)
    if "n_chars" in docs.columns:
        some = some.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return some


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles are linked by
    distances of two bits or less, the one with the smallest id."""
    return simhash.without_near_copies(docs, words=3)


def no_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in sequences of tokens."""
    return packing.pack(docs)


def _shipped(stage: Stage) -> Stage:
    """The stage, with this package at hand for the workers of any session."""

    def start(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return start


STAGES = [
    ("language_id", _shipped(known_language)),
    ("line_dedup", _shipped(own_lines)),
    ("simhash_near_dedup", _shipped(no_near_copies)),
    ("decontamination", _shipped(no_test_items)),
    ("best_fit_packing", _shipped(sequences)),
]


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
