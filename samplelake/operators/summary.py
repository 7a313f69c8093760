"""Counts and sums of a run, taken while its tables are written."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from samplelake.session import materialise


class Summary:
    """``item, metric, n`` of the tables of a run. Metrics are observed by the job that writes a table
    (``DataFrame.observe``), so no table is read for them."""

    def __init__(self) -> None:
        self._written: list[tuple[str, Observation]] = []
        self._names = itertools.count()

    def watch(self, df: DataFrame, item: str, **metrics: Column) -> DataFrame:
        """``df``, whose next action counts its rows and takes ``metrics``, which are aggregates. That
        action has to come before ``table``."""
        seen = Observation(f"{item}-{next(self._names)}")
        self._written.append((item, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in metrics.items()])

    def stored(self, df: DataFrame, label: str, **metrics: Column) -> DataFrame:
        """A stored table (``materialise``) that is watched as it is written."""
        return materialise(self.watch(df, label, **metrics), label)

    def table(self, spark: SparkSession) -> DataFrame:
        """Items in the order of their names; of an item written in parts the sums."""
        rows = [(item, name, int(n or 0)) for item, seen in self._written for name, n in seen.get.items()]
        told = spark.createDataFrame(rows, "item string, metric string, n bigint")
        return told.groupBy("item", "metric").agg(F.sum("n").alias("n")).orderBy("item", "metric")
