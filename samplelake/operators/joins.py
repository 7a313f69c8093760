"""Joins of a large table with a dimension table whose size is checked first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from samplelake.session import materialise

BROADCAST_BYTES = 32 << 20
SALTS = 64
#: A key is hot if it has more than one of so many parts of the rows, or more rows than a task should.
HOT_SHARE, HOT_ROWS = 1000, 1 << 22


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows as text, from one distributed aggregation."""
    size = F.octet_length(F.to_json(F.struct("*"))).cast("bigint")
    return df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]


def hot_keys(df: DataFrame, on: Sequence[str], share: int = HOT_SHARE) -> DataFrame:
    """The keys that hold more than one ``share``-th of the rows or more than ``HOT_ROWS``; so there are
    fewer than ``share``, or than the rows over ``HOT_ROWS``. Counted with map-side sums."""
    seen = Observation()
    counted = df.groupBy(*on).agg(F.count("*").alias("__n")).observe(seen, F.coalesce(F.sum("__n"), F.lit(0)).alias("t"))
    # Where every key is its own row there is nothing to keep.
    counts = materialise(counted.filter("__n > 1"), "key-counts")
    return counts.filter(F.col("__n") > min(seen.get["t"] // share, HOT_ROWS)).select(*on)


def join_dim(
    big: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    *,
    stored: bool = False,
    limit: int | None = None,
    salts: int = SALTS,
    share: int = HOT_SHARE,
) -> DataFrame:
    """Join ``big`` with ``dim`` on equal keys, no matter how skewed the keys of ``big`` are.

    The dimension is written to the shared folder (unless it is ``stored`` already), so that
    measuring and joining it computes it once. If it measures no more than ``limit`` bytes it
    is broadcast and ``big`` is not shuffled. Beyond that both sides are shuffled, with the hot
    keys of ``big`` (``hot_keys``) and its null keys spread over ``salts`` tasks each; only the
    dimension's rows for hot keys are repeated. ``how`` must keep the left side's rows whole
    (inner, left, left_semi, left_anti).
    """
    on = [on] if isinstance(on, str) else list(on)
    if not stored:
        dim = materialise(dim, "dimension")
    if measured_bytes(dim) <= (BROADCAST_BYTES if limit is None else limit):
        return big.join(F.broadcast(dim), on, how)
    # At most ``share`` keys, or a 4-millionth of the rows: small by its definition.
    hot = F.broadcast(hot_keys(big, on, share).withColumn("__hot", F.lit(True)))
    some_null = F.lit(False)
    for c in on:
        some_null = some_null | F.col(c).isNull()
    # By row, as a hot key may sit in one partition; by value, so that a task that runs again
    # deals its rows as before.
    hashable = [F.col(f"`{f.name}`") for f in big.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    spot = F.pmod(F.xxhash64(*hashable), F.lit(salts))
    salted = big.join(hot, on, "left").withColumn(
        "__salt", F.when(F.col("__hot") | some_null, spot).otherwise(F.lit(0))
    )
    repeated = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = dim.join(hot, on, "left").withColumn("__salt", F.explode(repeated)).drop("__hot")
    return salted.drop("__hot").join(copies, [*on, "__salt"], how).drop("__salt")
