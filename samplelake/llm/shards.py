"""Shards of near equal sizes that keep copies of a text together.

Groups of equal texts are put in the order of a hash of their text. The smallest capacity is
searched for at which a greedy pass over the group sizes, cutting whenever the next group does
not fit, needs no more shards than there are; the cuts of that pass are the shards.

The driver never holds all groups. It first searches over ranges of the hash: taking ranges as
whole gives a capacity that suffices, taking them as divisible one below which nothing does.
Only ranges in which a cut may lie are split further, down to single groups, until the two
capacities meet. A group as large as an even share of what is left gets a shard of its own first,
as it would otherwise set the capacity of all the others.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplelake.llm.common import id_and_text, number_rows
from samplelake.session import materialise

SHARDS, LAW, EXTRA_BYTES = 40, "bytes", 16
#: Ranges that the driver holds at once.
RANGES = 1 << 14
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Range:
    """Groups with hashes from ``low`` to ``high``, both included."""

    low: int
    high: int
    size: int
    groups: int

    @property
    def whole(self) -> bool:
        return self.groups <= 1


def _greedy(ranges: Sequence[Range], starts: Sequence[int], capacity: int, shards: int, divisible: bool) -> list[int]:
    """Positions in bytes at which each shard ends. Ranges of several groups may be cut
    anywhere if ``divisible``, else nowhere."""
    total, at, cuts = starts[-1], 0, []
    for _ in range(shards):
        end = at + capacity
        if end >= total:
            cuts.append(total)
            break
        i = bisect_right(starts, end) - 1
        at = end if divisible and not ranges[i].whole else starts[i]
        cuts.append(at)
    return cuts


def _smallest(ranges: Sequence[Range], starts: Sequence[int], shards: int, divisible: bool) -> int:
    """The smallest capacity at which the greedy pass reaches the end."""
    total = starts[-1]
    low, high = -(-total // shards), total
    while low < high:
        middle = (low + high) // 2
        if _greedy(ranges, starts, middle, shards, divisible)[-1] == total:
            high = middle
        else:
            low = middle + 1
    return low


def _starts(ranges: Sequence[Range]) -> list[int]:
    starts = [0]
    for r in ranges:
        starts.append(starts[-1] + r.size)
    return starts


def minimax_cuts(
    ranges: list[Range], shards: int, refine: Callable[[list[Range]], list[Range]]
) -> tuple[int, list[int]]:
    """The smallest capacity, and the last hash of each shard but the last.

    ``ranges`` are in order and cover all groups; ``refine`` splits some of them.
    """
    while True:
        starts = _starts(ranges)
        enough, least = _smallest(ranges, starts, shards, False), _smallest(ranges, starts, shards, True)
        unsure: set[int] = set()
        if enough > least or any(not r.whole for r in ranges):
            early = _greedy(ranges, starts, least, shards, False)
            late = _greedy(ranges, starts, enough, shards, True)
            late += [starts[-1]] * (len(early) - len(late))
            for a, b in zip(early, late, strict=False):
                span = range(max(0, bisect_right(starts, a) - 1), min(len(ranges), bisect_left(starts, b)))
                unsure.update(i for i in span if not ranges[i].whole)
        if not unsure:
            cuts = _greedy(ranges, starts, enough, shards, False)
            ends = [ranges[bisect_left(starts, c) - 1].high for c in cuts[:-1] if c > 0]
            return enough, ends
        parts = iter(refine([ranges[i] for i in sorted(unsure)]))
        split: dict[int, list[Range]] = {i: [] for i in unsure}
        for part in parts:
            split[bisect_right([r.low for r in ranges], part.low) - 1].append(part)
        ranges = [p for i, r in enumerate(ranges) for p in (split[i] if i in unsure else [r])]


def _ranges_of(groups: DataFrame, within: list[Range]) -> list[Range]:
    """Split ranges into up to ``RANGES`` parts of equal width in all; one aggregation."""
    spark = groups.sparkSession
    rows = []
    parts = max(2, RANGES // len(within))
    for r in within:
        width = max(1, -(-(r.high - r.low + 1) // parts))
        rows.append((r.low, r.high, Decimal(width)))
    # At most RANGES rows, so they are sent to every task.
    bounds = F.broadcast(spark.createDataFrame(rows, "low bigint, high bigint, width decimal(20,0)"))
    joined = groups.join(bounds, F.col("key").between(F.col("low"), F.col("high")))
    part = F.floor((F.col("key").cast("decimal(20,0)") - F.col("low")) / F.col("width"))
    found = joined.groupBy("low", part.cast("bigint").alias("part")).agg(
        F.min("key").alias("first"), F.max("key").alias("last"), F.sum("size").alias("size"), F.count("*").alias("n")
    ).orderBy("first").collect()
    return [Range(r["first"], r["last"], r["size"], r["n"]) for r in found]


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``size`` is the text's UTF-8 bytes plus ``EXTRA_BYTES``; null texts have none, and form a
    group with the empty ones. Shards are numbered from 0; with fewer groups than shards the
    last ones stay empty. Groups whose 64-bit hashes are equal are kept together as well.
    ``slot`` numbers the rows of a shard without gaps. Repeated rows stay; an empty table gives
    no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = id_and_text(docs).select(
        "doc_id", (F.octet_length(text) + EXTRA_BYTES).cast("bigint").alias("size"),
        F.crc32(text).cast("bigint").alias("text_crc32"), F.xxhash64(text).alias("key"),
    )
    stored = materialise(rows, "sizes")
    groups = materialise(stored.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    alone, ends = _cut(groups, shards)
    numbered = number_rows(stored.withColumn("shard", _shard(F.col("key"), alone, ends)), ["shard"], ["doc_id", "key"], "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _cut(groups: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """Keys of the groups that get a shard of their own, and the last key of each later shard."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    largest = groups.orderBy(F.desc("size"), "key").limit(shards).collect()
    alone: list[int] = []
    for row in largest:
        if len(alone) == shards - 1 or row["size"] * (shards - len(alone)) < total:
            break
        alone.append(row["key"])
        total -= row["size"]
    rest = groups.filter(~F.col("key").isin(alone)) if alone else groups
    ranges = _ranges_of(rest, [Range(_LOW, _HIGH, total, 2)])
    if not ranges:
        return alone, []
    return alone, minimax_cuts(ranges, shards - len(alone), lambda some: _ranges_of(rest, some))[1]


def _shard(key: Column, alone: list[int], ends: list[int]) -> Column:
    """Fewer than ``shards`` comparisons; no join."""
    later = F.lit(len(alone))
    for end in ends:
        later = later + (key > F.lit(end)).cast("int")
    if not alone:
        return later
    own = F.array_position(F.array(*map(F.lit, alone)), key).cast("int")
    return F.when(own > 0, own - 1).otherwise(later)
