"""Fingerprints of documents from their Lempel-Ziv phrases.

A text is read from its start; the shortest piece not read as a phrase before becomes the next
phrase. Texts that share much give many common phrases, as they would compress well together.
The set of phrases is hashed, the hashes are dealt into bins by their first bits, and the least
of each bin is kept: the share of bins that agree, of those that either text fills, estimates
the overlap of the two sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplelake.llm.common import id_and_text
from samplelake.session import materialise

BINS = 128
_BIN_BITS = BINS.bit_length() - 1
_BASE = 0x9E3779B97F4A7C15
#: Rows between two places where a document is needed by two tasks, and the most such places.
BLOCK_ROWS, MOST_BLOCKS = 2_000, 100_000
LAST = (1 << 63) - 1


def parse(text: str, seen: set[str]) -> tuple[list[int], str]:
    """Add the phrases of ``text`` to ``seen``; returns the lengths of the new ones, which make
    up the text in turn, and the piece at its end that is no new phrase."""
    new, open_ = [], ""
    add, note = seen.add, new.append
    for c in text:
        open_ += c
        if open_ not in seen:
            add(open_)
            note(open_)
            open_ = ""
    return list(map(len, new)), open_


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def phrase_hashes(text: str, lengths: list[int]) -> np.ndarray:
    """Hashes of the phrases that ``text`` starts with, of these lengths: polynomials of their
    code points modulo 2**64, mixed."""
    ends = np.cumsum(np.array([0, *lengths], np.int64))
    points = np.frombuffer(text[: ends[-1]].encode("utf-32-le", "surrogatepass"), np.uint32)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(points)), out=sums[1:])
    hashes = (sums[ends[1:]] - sums[ends[:-1]]) * _powers(pow(_BASE, -1, 1 << 64), len(points) + 1)[ends[:-1]]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        hashes = (hashes ^ (hashes >> np.uint64(shift))) * np.uint64(factor)
    return hashes ^ (hashes >> np.uint64(31))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Per bin the least hash, cut to 16 bits, or 0 where the bin is empty."""
    out = np.zeros(BINS, np.uint16)
    if len(hashes):
        hashes = np.sort(hashes)
        bins = (hashes >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
        first = np.concatenate(([True], bins[1:] != bins[:-1]))
        out[bins[first]] = (hashes[first] % np.uint64(65535)).astype(np.uint16) + 1
    return out


def fingerprint(text: str | None) -> np.ndarray:
    lengths, _ = parse(text or "", set())
    return sketch(phrase_hashes(text or "", lengths))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, also of two empty texts."""
    either = int(((a > 0) | (b > 0)).sum())
    return float(((a == b) & (a > 0)).sum()) / either if either else 1.0


def text_of(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex()


def values_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u2")


class _Document:
    """A text parsed up to its last third and, from there, to its end."""

    def __init__(self, doc_id: int | None, text: str | None) -> None:
        self.doc_id, self.text = doc_id, text or ""
        self.cut = len(self.text) - len(self.text) // 3
        self.seen: set[str] = set()
        lengths, self.open = parse(self.text[: self.cut], self.seen)
        self.hashes = phrase_hashes(self.text, lengths)
        self.values = self._go_on(self.text[self.cut :], self.seen.copy())

    def _go_on(self, tail: str, seen: set[str]) -> np.ndarray:
        """The fingerprint of the part before the cut with this tail."""
        rest = self.open + tail
        lengths, _ = parse(rest, seen)
        return sketch(np.concatenate((self.hashes, phrase_hashes(rest, lengths))))

    def against(self, following: _Document) -> tuple:
        """The row of this document, given the next one. The parse of the edited text goes on
        from the end of what both texts share."""
        tail = following.text[: len(self.text) // 3]
        edited = self._go_on(tail, self.seen)
        digest = hashlib.sha256((self.text[: self.cut] + tail).encode("utf-8", "surrogatepass")).hexdigest()
        return (
            self.doc_id, len(self.text), digest, text_of(self.values), text_of(edited),
            likeness(self.values, edited), likeness(self.values, following.values),
        )


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block and descending id; after a block's own rows comes the row that follows."""
    schema = pa.schema([
        (n, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[t])
        for n, t in (column.split() for column in SCHEMA.split(", "))
    ])
    block, before, ended = None, None, False
    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("block", "copy", "doc_id", "text")]
        for own_block, copy, doc_id, text in zip(*columns, strict=True):
            if own_block != block:
                block, before, ended = own_block, None, False
            if ended:
                continue
            document = _Document(doc_id, text)
            if before is not None:
                rows.append(before.against(document))
            before, ended = document, copy
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)],
            schema=schema,
        )


def _cuts(ids: DataFrame, rows: int) -> np.ndarray:
    """Ids between which blocks of about equal sizes lie; they decide only how even the blocks are."""
    blocks = min(MOST_BLOCKS, rows // BLOCK_ROWS)
    if blocks < 2:
        return np.array([], np.int64)
    some = ids.sample(min(1.0, 10 * blocks / rows), seed=7).toPandas()["order"].sort_values().to_numpy(np.int64)
    return np.unique(some[np.linspace(0, len(some) - 1, blocks + 1).astype(int)[1:-1]]) if len(some) else some


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text and of its edited text, in which the start of the next
    document takes the place of the last third; and how alike they and the next document's are.

    The next document is the one with the next smaller id, for the smallest the one with the
    largest (a single document follows itself). Rows that share an id are ordered by text; null
    ids count as the largest. A null text is an empty one, whose fingerprint has no filled bin.
    An empty table gives no rows. The texts are shuffled once: each block of ids gets the one
    document that follows it besides its own.
    """
    some = id_and_text(docs).withColumn("order", F.coalesce("doc_id", F.lit(LAST)))
    ids = materialise(some.select("order"), "document-ids")
    rows = ids.count()
    cuts = _cuts(ids, rows)
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("bigint")
    def block_of(order: pd.Series) -> pd.Series:
        # The largest ids are in block 0.
        return pd.Series(len(shared.value) - np.searchsorted(shared.value, order.to_numpy(np.int64), "right"))

    heads = ids.withColumn("block", block_of("order")).groupBy("block").agg(F.max("order").alias("order")).orderBy("block")
    tops = [(r["block"], r["order"]) for r in heads.collect()]
    # The top of a block follows the block before; the very first follows the last block.
    needed = {top: tops[i - 1][0] for i, (_, top) in enumerate(tops)}
    also = docs.sparkSession.sparkContext.broadcast((np.array(sorted(needed)), np.array([needed[k] for k in sorted(needed)])))

    @F.pandas_udf("bigint")
    def needed_by(order: pd.Series) -> pd.Series:
        keys, blocks = also.value
        own = order.to_numpy(np.int64)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        return pd.Series(np.where(keys[at] == own, blocks[at], -1))

    if not tops:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    places = some.select("*", block_of("order").alias("own"), needed_by("order").alias("other"))
    copies = F.filter(
        F.array(F.struct(F.col("own").alias("block"), F.lit(False).alias("copy")),
                F.struct(F.col("other").alias("block"), F.lit(True).alias("copy"))),
        lambda p: p["block"] >= 0,
    )
    dealt = places.select("doc_id", "text", "order", F.explode(copies).alias("p")).select("doc_id", "text", "order", "p.*")
    parts = max(dealt.sparkSession.sparkContext.defaultParallelism, rows // (5 * BLOCK_ROWS))
    ordered = dealt.repartition(parts, "block").sortWithinPartitions("block", "copy", F.desc("order"), "text")
    return ordered.select("block", "copy", "doc_id", "text").mapInArrow(_compare, SCHEMA)
