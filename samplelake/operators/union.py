"""Rows of differing columns in one frame, and the counts of a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ragged_union(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, columns aligned by name, a column that a frame lacks being null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def run_summary(counted: Mapping[str, DataFrame]) -> DataFrame:
    """``item, n`` for the tables of a run (inputs, samples, prompts, hits, errors)."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n") for name, df in counted.items()]
    return reduce(DataFrame.unionByName, parts)
