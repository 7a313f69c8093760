"""Packing of documents into sequences of bounded length.

Only lengths matter for the plan, so the driver plans on their histogram, which has at most as
many entries as a sequence has tokens, and each pattern carries how often it is used. Lengths
are taken from the largest down; what a sequence still lacks is looked up among single lengths,
sums of two and sums of three, as far as they are available, and an exact filling is used as
often as its lengths last. What no sum fills goes to the fullest sequence that still holds it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplelake.llm.common import id_and_text, map_batches, number_rows
from samplelake.llm.tokens import Encoder, default_path
from samplelake.session import materialise

CAPACITY = 2048
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
Pattern = tuple[tuple[int, ...], int]


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The pieces of each document: one, or, above ``capacity`` tokens, full ones after a first
    one that takes the rest. ``ids_crc32`` is of the ids as 32-bit integers."""
    path = path or default_path()

    def work(batch: pa.RecordBatch) -> dict:
        encoder = Encoder.of(path)
        rows = []
        encoded = encoder.encode_many(batch.column("text").to_pylist())
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
            ids = np.frombuffer(data, encoder.type)
            rest = len(ids) % capacity or capacity
            bounds = [0, *range(rest, len(ids) + 1, capacity)]
            for piece, (at, to) in enumerate(zip(bounds, bounds[1:], strict=False)):
                rows.append((doc_id, piece, at, to - at, zlib.crc32(ids[at:to].astype("<u4").tobytes())))
        names = ("doc_id", "piece", "start", "length", "ids_crc32")
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return {n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True), types, strict=True)}

    return map_batches(id_and_text(docs), work, PIECES)


class _Sums:
    """Which available lengths make up a sum."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] += n

    def pair(self, total: int) -> tuple[int, ...] | None:
        if total < 2:
            return None
        large = np.arange((total + 1) // 2, total)
        both = np.minimum(self.left[large], self.left[total - large])
        if total % 2 == 0:
            both[0] = self.left[total // 2] // 2
        if not both.any():
            return None
        # The largest part, as small ones fill gaps later on.
        a = int(large[np.flatnonzero(both)[-1]])
        return a, total - a

    def filling(self, gap: int, parts: int) -> tuple[int, ...] | None:
        """Up to ``parts`` (three at most) available lengths that make up ``gap``."""
        if parts and self.left[gap] > 0:
            return (gap,)
        if parts > 1 and (two := self.pair(gap)) is not None:
            return two
        for a in np.flatnonzero(self.left[: gap - 1])[::-1].tolist() if parts > 2 and gap > 2 else ():
            if 3 * a < gap:
                break
            self.left[a] -= 1
            two = self.pair(gap - a)
            self.left[a] += 1
            if two is not None:
                return a, *two
        return None


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns of lengths and how often each is used; every counted length is placed once.

    Where few lengths are left to choose from, fillings of many parts may use up what best fit
    needs, so the plan is the one with the fewest sequences of those with fillings of up to
    three, two and one parts and of none.
    """
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("a length does not fit a sequence")
    plans = (_plan(counts, capacity, parts) for parts in (3, 2, 1, 0))
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _plan(counts: dict[int, int], capacity: int, parts: int) -> list[Pattern]:
    sums, patterns = _Sums(counts, capacity), []
    if sums.left[capacity]:
        patterns.append(((capacity,), int(sums.left[capacity])))
        sums.left[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while sums.left[length] > 0:
            sums.left[length] -= 1
            found = sums.filling(capacity - length, parts)
            sums.left[length] += 1
            if found is None:
                break
            pattern = (length, *found)
            times = min(int(sums.left[x]) // n for x, n in Counter(pattern).items())
            for x in pattern:
                sums.left[x] -= times
            patterns.append((pattern, times))
    return patterns + _best_fit(sums.left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit, longest first, with equal sequences kept as one pattern."""
    open_: dict[int, list[Pattern]] = {}
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                gap, pattern, times = capacity, (), n
            else:
                pattern, times = open_[gap].pop()
            each = min(gap // length, n)
            used = min(times, n // each)
            if gap != capacity and used < times:
                open_[gap].append((pattern, times - used))
            open_.setdefault(gap - each * length, []).append((pattern + (length,) * each, used))
            if gap in open_ and not open_[gap]:
                del open_[gap]
            n -= each * used
    return [pattern for some in open_.values() for pattern in some]


class Places:
    """Sequence and offset of the piece that is the n-th of its length."""

    def __init__(self, patterns: Iterable[Pattern]) -> None:
        rows, used, sequence = [], Counter(), 0
        for lengths, times in patterns:
            offset = 0
            for length in lengths:
                rows.append((length << 44 | used[length], used[length], sequence, offset))
                used[length] += times
                offset += length
            sequence += times
        self.key, self.first, self.sequence, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 4).T.copy()

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 44 | number, "right") - 1
        return self.sequence[at] + number - self.first[at], self.offset[at]


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    A null or empty text is one piece with the end id alone; an empty table gives no rows.
    Repeated rows are packed like any others. Pieces of equal length are interchangeable: which
    of them takes which place follows from hashes of the ids.
    """
    pieces = materialise(pieces_of(docs, capacity, path), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(plan_patterns(histogram, capacity)))
    numbered = number_rows(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "number")

    def work(batch: pa.RecordBatch) -> dict:
        columns = {name: batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
        sequence, offset = places.value.find(batch.column("length").to_numpy(), batch.column("number").to_numpy())
        return {**columns, "sequence_id": sequence, "offset": offset}

    return map_batches(numbered, work, f"{PIECES}, sequence_id bigint, offset bigint")
