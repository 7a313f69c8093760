"""Documents that hold test items, exactly or with a few edits.

An item may occur with up to seven hundredths of its length in edits, ``e``. Cut into ``e + 1``
pieces, an item with ``e`` edits keeps one piece as it was. All pieces are looked for in one
pass over a document, and around each hit the least edit distance between the item and any part
of the text is computed by Myers' bit-parallel algorithm. Texts and items are compared in lower
case with single spaces between words. Short items have to stand there as whole words, without
an edit. Items are looked for in blocks, one after the other, so a worker holds one block's
automaton at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplelake.llm.common import id_and_text, map_batches, packed, unpacked
from samplelake.operators.joins import join_dim
from samplelake.session import new_table_path

ERROR_RATE = 0.07
#: Items shorter than this are found as whole words, without edits.
LEAST_CHARS = 20
#: Characters of the items that are looked for in one pass; more items take more passes.
BLOCK_CHARS = 8 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def best_distance(pattern: str, text: str, most: int) -> int | None:
    """The least edit distance between ``pattern`` and any part of ``text``, if up to ``most``."""
    full, high = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, score, best = full, 0, len(pattern), len(pattern)
    for c in text:
        equal = where.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        score += bool(up & high) - bool(down & high)
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best = score
            if not best:
                break
    return best if best <= most else None


def spaced(text: str | None) -> str:
    """The normal text with a space at both ends, so that every word has one on each side."""
    return f" {normal(text)} "


@dataclass(frozen=True)
class Item:
    ids: tuple[int, ...]
    text: str
    edits: int

    @classmethod
    def of(cls, ids: Iterable[int], text: str, rate: float) -> Item:
        """An item of a normal text."""
        short = len(text) < LEAST_CHARS
        return cls(tuple(sorted(set(ids))), f" {text} " if short else text, 0 if short else int(len(text) * rate))

    def pieces(self) -> Iterator[tuple[int, str]]:
        n = self.edits + 1
        bounds = [len(self.text) * i // n for i in range(n + 1)]
        return ((a, self.text[a:b]) for a, b in zip(bounds, bounds[1:], strict=False))


class Finder:
    """Finds the items of one block in a text; a worker keeps the last one it has built."""

    _built: tuple[str, Finder] | None = None

    def __init__(self, items: list[Item]) -> None:
        import ahocorasick

        self.items = items
        self.automaton, places = ahocorasick.Automaton(), {}
        for n, item in enumerate(items):
            for at, piece in item.pieces():
                places.setdefault(piece, []).append((n, at))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.some = bool(places)

    @classmethod
    def of(cls, name: str, items: Callable[[], list[Item]]) -> Finder:
        if cls._built is None or cls._built[0] != name:
            cls._built = None
            cls._built = name, cls(items())
        return cls._built[1]

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """``item_id, distance`` of the items found, by id."""
        own = spaced(text)
        hits: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(own) if self.some else ():
            for n, at in where:
                hits.setdefault(n, set()).add(end + 1 - size - at)
        found = []
        for n, starts in hits.items():
            distance = self._verify(self.items[n], own, sorted(starts))
            if distance is not None:
                found += [(i, distance) for i in self.items[n].ids]
        return sorted(found)

    def _verify(self, item: Item, text: str, starts: list[int]) -> int | None:
        if any(start >= 0 and text.startswith(item.text, start) for start in starts):
            return 0
        best, slack, size = None, item.edits, len(item.text)
        at = 0
        while at < len(starts):
            low = high = starts[at]
            while at < len(starts) and starts[at] <= high + 2 * slack + size:
                high = starts[at]
                at += 1
            part = text[max(0, low - slack) : high + size + slack]
            distance = best_distance(item.text, part, slack)
            if distance is not None and (best is None or distance < best):
                best = distance
        return best


def items_of(benchmark: DataFrame) -> DataFrame:
    """``own, ids``: each distinct normal text and the ids of its items. Null and blank items, and
    those without an id, are left out."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        return {"item_id": batch.column("item_id"), "own": [normal(t) for t in batch.column("text").to_pylist()]}

    known = map_batches(rows.filter("item_id IS NOT NULL AND text IS NOT NULL"), work, "item_id bigint, own string")
    return known.filter("own <> ''").groupBy("own").agg(F.collect_set("item_id").alias("ids"))


def item_blocks(benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> Iterator[list[Item]]:
    """The items in blocks of bounded size, in the order of their texts; those with equal texts
    are one."""
    block: list[Item] = []
    size = 0
    for row in items_of(benchmark).orderBy("own").toLocalIterator():
        if size + len(row["own"]) > block_chars and block:
            yield block
            block, size = [], 0
        size += len(row["own"])
        block.append(Item.of(row["ids"], row["own"], rate))
    if block:
        yield block


LEAKS = "id bigint, text_hash bigint, doc_id bigint, item_id bigint, distance int"
_TYPES = {"id": pa.int64(), "text_hash": pa.int64(), "doc_id": pa.int64(), "item_id": pa.int64(), "distance": pa.int32()}


def _found(docs: DataFrame, benchmark: DataFrame, rate: float, block_chars: int) -> DataFrame:
    """``id, text_hash, doc_id, item_id, distance``, as a stored table; a block's items are let go of
    before the next one's are looked for."""
    spark = docs.sparkSession
    context = spark.sparkContext
    own = id_and_text(docs).select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("text_hash"), "doc_id", "text"
    )
    path = new_table_path(spark, "leaks")
    spark.createDataFrame([], LEAKS).write.parquet(path)
    for number, items in enumerate(item_blocks(benchmark, rate, block_chars)):
        shared, name = context.broadcast(items), f"{path}-{number}"
        _leaks(own, lambda shared=shared, name=name: Finder.of(name, lambda: shared.value)).write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema(LEAKS).parquet(path)


def _leaks(own: DataFrame, finder: Callable[[], Finder]) -> DataFrame:
    def work(batch: pa.RecordBatch) -> dict:
        find = finder().find
        columns = [batch.column(c).to_pylist() for c in ("id", "text_hash", "doc_id", "text")]
        rows = [(*key, *hit) for *key, text in zip(*columns, strict=True) for hit in find(text)]
        return {n: pa.array(c, t) for (n, t), c in zip(_TYPES.items(), list(zip(*rows, strict=True)) or [()] * len(_TYPES), strict=True)}

    return map_batches(own, work, LEAKS)


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``doc_id, item_id, distance`` for each item that a document holds, ``distance`` being its
    least number of edits.

    Documents without items, null and empty texts give no row, and so does an empty benchmark.
    Repeated rows of ``docs`` give repeated rows; repeated items count once.
    """
    return _found(docs, benchmark, rate, block_chars).select("doc_id", "item_id", "distance")


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, *, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""
    bad = _found(docs, benchmark, rate, block_chars).select("id", "text_hash").distinct()
    keyed = packed(docs).select("row", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("text_hash"))
    return unpacked(join_dim(keyed, bad, ["id", "text_hash"], "left_anti"), docs)
