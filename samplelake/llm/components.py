"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplelake.session import materialise


def _least(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` with the least ``b`` of each ``a``; sums up before it shuffles."""
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("least")), "a")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    tied = _least(edges)
    ends = tied.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return ends.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges(a, b)``, of one ordered type; the root is the
    least node that can be reached.

    Stars are merged by turns until nothing changes, which takes about as many rounds as the
    logarithm of the number of nodes. Each round is a stored table; only its count and a hash
    sum of its rows reach the driver.
    """
    directed = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, before = materialise(directed, "edges"), None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        current = materialise(_small_star(_large_star(current)), "edges")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
