"""Exact copies by sorting rows by content.

Texts are normalised (A-Z in lower case) and dealt to ranges between sampled splitters. A
splitter would be as long as a text, so rows are ordered by their first bytes, then a hash of
all bytes, then all bytes, and splitters are cut from the first bytes, the hash and the id
alone. With the id in it, a splitter may also fall between equal texts: a group of any size is
spread over as many ranges as its rows fill. Each range is sorted by Spark's external sort, which
puts equal texts side by side, and one pass compares each text with the one before it, byte by
byte. Only the runs at the two ends of a range may go on in the next one; those are compared
again, one row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplelake.llm.common import fresh_name, id_and_text
from samplelake.operators.joins import join_dim
from samplelake.session import materialise

#: Bytes of a text that may be part of a splitter.
HEAD = 32
#: Ids a run passes on at once.
SLICE = 1 << 16

_SORTED = "place bigint, head binary, hash bigint, own binary"
_FOUND = (
    "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string, "
    "range int, side int, own binary"
)
_FIELDS = {
    "doc_id": pa.int64(), "keep_id": pa.int64(), "group_size": pa.int64(), "kept": pa.bool_(), "text_sha256": pa.string(),
    "range": pa.int32(), "side": pa.int32(), "own": pa.binary(),
}
#: Where a run stands in its range.
INSIDE, FIRST, LAST = 0, 1, 2


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = pc.ascii_lower(batch.column("text")).cast(pa.binary())
        # The seed keeps these hashes apart from those that Spark deals rows by.
        hashes = np.array([xxhash.xxh3_64_intdigest(x.as_buffer(), 11) for x in own], np.uint64).view(np.int64)
        head = pc.binary_slice(own, 0, HEAD)
        yield pa.RecordBatch.from_pydict({"place": batch.column("place"), "head": head, "hash": hashes, "own": own})


class _Run:
    """Rows of one text, in the order of the sort; their number is known at the end."""

    def __init__(self, own: pa.Scalar) -> None:
        self.own, self.places = own, []

    def rows(self, part: int, side: int) -> Iterator[pa.RecordBatch]:
        places = np.concatenate(self.places)
        size, keep = len(places), places[0]
        digest = hashlib.sha256(self.own.as_buffer()).hexdigest()
        for at in range(0, size, SLICE):
            some = places[at : at + SLICE]
            yield _rows(some, np.full(len(some), keep), np.full(len(some), size), np.arange(at, at + len(some)) == 0,
                        [digest] * len(some), part, side)

    def summary(self, part: int, side: int) -> pa.RecordBatch:
        size = sum(map(len, self.places))
        keep = self.places[0][:1]
        return _rows(keep, keep, np.array([size]), np.array([False]), [None], part, side, [self.own])


def _rows(places, keep, sizes, kept, digests, part, side, own=None) -> pa.RecordBatch:
    n = len(places)
    columns = (places, keep, sizes, kept, digests, np.full(n, part), np.full(n, side), own or [None] * n)
    return pa.RecordBatch.from_pydict({name: pa.array(c, kind) for (name, kind), c in zip(_FIELDS.items(), columns, strict=True)})


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a sorted range. A run inside the range is complete; the rows of those at
    its ends carry the range and the end, and one row more carries the text of such a run."""
    part = TaskContext.get().partitionId()
    current: _Run | None = None
    ended = 0

    def singles(places: np.ndarray, own: pa.Array) -> pa.RecordBatch:
        digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in own]
        one = np.ones(len(places), np.int64)
        return _rows(places, places, one, one > 0, digests, part, INSIDE)

    for batch in batches:
        if not batch.num_rows:
            continue
        own, places = batch.column("own"), batch.column("place").to_numpy()
        new = np.ones(len(places), bool)
        new[1:] = ~pc.equal(own.slice(1), own.slice(0, len(own) - 1)).to_numpy(zero_copy_only=False)
        new[0] = current is None or own[0] != current.own
        starts = np.flatnonzero(new)
        ends = np.concatenate((starts[1:], [len(places)])) if len(starts) else starts
        before = starts[0] if len(starts) else len(places)
        if before:
            current.places.append(places[:before])
        if not len(starts):
            continue
        if current is not None:
            yield from _ended(current, part, FIRST if ended == 0 else INSIDE)
            ended += 1
        # Runs of one row between others, which most are, are passed on together.
        inner, stops = starts[:-1], ends[:-1]
        if ended == 0 and len(inner):
            run = _Run(own[int(inner[0])])
            run.places.append(places[inner[0] : stops[0]])
            yield from _ended(run, part, FIRST)
            ended += 1
            inner, stops = inner[1:], stops[1:]
        alone = inner[stops - inner == 1]
        for at in range(0, len(alone), SLICE):
            some = alone[at : at + SLICE]
            yield singles(places[some], own.take(pa.array(some)))
        for a, b in zip(inner[stops - inner > 1].tolist(), stops[stops - inner > 1].tolist(), strict=True):
            run = _Run(own[a])
            run.places.append(places[a:b])
            yield from run.rows(part, INSIDE)
        ended += len(inner)
        current = _Run(own[int(starts[-1])])
        current.places.append(places[starts[-1] :])
    if current is not None:
        yield from _ended(current, part, LAST if ended else FIRST)


def _ended(run: _Run, part: int, side: int) -> Iterator[pa.RecordBatch]:
    yield from run.rows(part, side)
    if side != INSIDE:
        yield run.summary(part, side)


#: Null ids: after all others, whichever end comes first.
_NULL = (1 << 63) - 1


def _groups(docs: DataFrame, keep: str) -> DataFrame:
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    # The id as a number that grows away from the end that stays.
    place = F.col("doc_id") if keep == "smallest" else F.bitwise_not("doc_id")
    some = id_and_text(docs).select(F.coalesce(place, F.lit(_NULL)).alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    normal = some.mapInArrow(_normal, _SORTED)
    ranges = normal.repartitionByRange("head", "hash", "place").sortWithinPartitions("head", "hash", "own", "place")
    return materialise(ranges.select("place", "own").mapInArrow(_neighbours, _FOUND), "equal-texts")


def copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    Rows whose texts are equal but for the case of A-Z are one group; ``keep_id`` is its
    ``smallest`` or ``largest`` id, ``group_size`` counts its rows, and ``text_sha256`` is the
    digest of the normalised text. Null texts count as empty. Null ids come after all others:
    one stays only if its group has no other. Of rows that also repeat the id one is ``kept``.
    An empty table gives no rows.

    A task holds one range's rows in Spark's sort, and in Python one batch and the ids of the
    run it is in.
    """
    found = _groups(docs, keep)
    ends = found.filter("own is not null")
    # At most two rows per range and, for one text, as many as the ranges that it fills.
    whole = ends.groupBy("own").agg(
        F.min("keep_id").alias("least"), F.sum("group_size").alias("size"), F.min(F.struct("range", "side")).alias("first")
    )
    joined = ends.select("own", "range", "side").join(whole, "own").select("range", "side", "least", "size", "first")
    inside = found.filter((F.col("side") == INSIDE) & F.col("own").isNull())
    border = join_dim(found.filter((F.col("side") != INSIDE) & F.col("own").isNull()), joined, ["range", "side"], "inner")
    stays = F.col("kept") & (F.struct("range", "side") == F.col("first"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    both = inside.select(*columns).unionByName(
        border.select("doc_id", F.col("least").alias("keep_id"), F.col("size").alias("group_size"), stays.alias("kept"), "text_sha256")
    )

    def number(place):
        own = F.nullif(F.col(place), F.lit(_NULL))
        return (own if keep == "smallest" else F.bitwise_not(own)).alias(place)

    return both.select(number("doc_id"), number("keep_id"), *columns[2:])


def without_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text,
    any one."""
    kept = copies(docs, keep).filter("kept").select("doc_id", "text_sha256")
    row, own, digest = (fresh_name(docs, n) for n in ("row", "own_id", "digest"))
    normal = F.encode(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _UPPER.lower()), "utf-8")
    keyed = docs.select(F.struct("*").alias(row), F.col("doc_id").cast("bigint").alias(own), F.sha2(normal, 256).alias(digest))
    same = keyed[own].eqNullSafe(kept["doc_id"]) & (keyed[digest] == kept["text_sha256"])
    return keyed.join(kept, same, "left_semi").dropDuplicates([own, digest]).select(f"{row}.*")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
