"""Keyword search over stored records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_count(text: Column, term: str) -> Column:
    """How often ``term`` occurs in ``text``, in any case, without overlaps."""
    lowered = F.lower(text)
    gone = F.length(F.replace(lowered, F.lit(term), F.lit("")))
    return ((F.length(lowered) - gone) / len(term)).cast("bigint")


def search(
    records: DataFrame, query: str, k: int = 10, *, columns: Sequence[str] = ("title", "summary"), key: str = "url"
) -> DataFrame:
    """The ``k`` records that hold every term of ``query`` and hold them most often; ties go to
    the smaller ``key``. Adds ``hits``. Each task keeps its own ``k`` best, so only those move.
    """
    terms = sorted(set(query.lower().split()))
    if not terms:
        raise ValueError("the query has no terms")
    text = F.concat_ws("\n", *columns)
    counts = [hit_count(text, t) for t in terms]
    total = counts[0]
    everywhere = counts[0] > 0
    for count in counts[1:]:
        total, everywhere = total + count, everywhere & (count > 0)
    return records.filter(everywhere).withColumn("hits", total).orderBy(F.desc("hits"), key).limit(k)
