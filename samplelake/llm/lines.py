"""Repeated runs of lines, found by winnowing over line hashes.

Lines are compared without the blanks around them; blank lines are passed over. A window is the
fewest lines from some line on that are ``RUN`` lines or hold ``WORDS`` words, so a long line
is a window of its own. The line of a window with the smallest hash (the first, of equals) is
its fingerprint. Equal windows have equal fingerprints at equal places, so none that is repeated
is lost with the fingerprints that occur once. The windows around the others are joined with
the first place of the same window, and each match is extended both ways, as far as the lines
around both places agree. It has to look at ``RUN - 1`` lines on a side: more of them would be
a window, with a match of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplelake.llm.common import map_batches, packed, unpacked
from samplelake.operators.joins import join_dim
from samplelake.session import materialise

RUN, WORDS = 3, 20
BLANKS = " \t\r\f\v"
_BETWEEN = re.compile(f"[{BLANKS}]+")
_WINDOW = "window:binary,at:int,size:int,before:array<bigint>,after:array<bigint>"
_FOUND = f"id bigint, text_hash bigint, fingerprint bigint, windows array<struct<{_WINDOW}>>"


def places(text: str) -> tuple[list[int], list[str]]:
    """Numbers and contents of the lines that are not blank."""
    stripped = [line.strip(BLANKS) for line in text.split("\n")]
    numbers = [i for i, line in enumerate(stripped) if line]
    return numbers, [stripped[i] for i in numbers]


def _stops(lines: list[str]) -> Iterator[tuple[int, int]]:
    """First line and end of each window."""
    words = np.concatenate(([0], np.cumsum([len(_BETWEEN.split(line)) for line in lines], dtype=np.int64)))
    enough = np.searchsorted(words, words[:-1] + WORDS)
    for start, stop in enumerate(np.minimum(enough, np.arange(len(lines)) + RUN).tolist()):
        if stop <= len(lines):
            yield start, stop


def winnow(text: str | None) -> list[tuple[int, list[dict]]]:
    """Fingerprints and the windows that each stands for: a digest, the first line and how many,
    counted without blank lines, and the hashes of the lines around, the nearest first."""
    _, lines = places(text or "")
    own = [line.encode("utf-8", "surrogatepass") for line in lines]
    hashes = [xxhash.xxh64_intdigest(line) - (1 << 63) for line in own]
    chosen: dict[int, list[dict]] = {}
    for start, stop in _stops(lines):
        at = min(range(start, stop), key=hashes.__getitem__)
        chosen.setdefault(at, []).append({
            "window": hashlib.md5(b"\n".join(own[start:stop])).digest(), "at": start, "size": stop - start,
            "before": hashes[max(0, start - RUN + 1) : start][::-1], "after": hashes[stop : stop + RUN - 1],
        })
    return [(hashes[at], windows) for at, windows in chosen.items()]


def _keyed(docs: DataFrame) -> DataFrame:
    """Null ids count as the smallest."""
    return packed(docs).select(
        "row", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("text_hash")
    )


def _agree(side: str) -> Column:
    """How many lines on a side agree, from the nearest on."""
    same, count = F.lit(True), F.lit(0)
    for i in range(RUN - 1):
        same = same & F.coalesce(F.get(side, F.lit(i)) == F.get(f"first.{side}", F.lit(i)), F.lit(False))
        count = count + same.cast("int")
    return count


def repeated_runs(keyed: DataFrame) -> DataFrame:
    """``id, text_hash, spans`` of each document of ``keyed(id, text_hash, text)`` with a window
    that also starts earlier, in a document with a smaller id or earlier in the same one. Spans
    count lines that are not blank, the end not included."""

    def work(batch: pa.RecordBatch) -> dict:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("id", "text_hash", "text")]
        for key, text_hash, text in zip(*columns, strict=True):
            rows += [(key, text_hash, fingerprint, windows) for fingerprint, windows in winnow(text)]
        longs = pa.list_(pa.int64())
        window = pa.struct([("window", pa.binary()), ("at", pa.int32()), ("size", pa.int32()), ("before", longs), ("after", longs)])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(window))
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        names = ("id", "text_hash", "fingerprint", "windows")
        return {n: pa.array(c, kind) for n, c, kind in zip(names, columns, kinds, strict=True)}

    found = materialise(map_batches(keyed.select("id", "text_hash", "text"), work, _FOUND), "line-fingerprints")
    twice = found.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint")
    some = join_dim(found, twice, "fingerprint", "left_semi").select("id", "text_hash", F.explode("windows").alias("w"))
    windows = materialise(some.select("id", "text_hash", "w.*"), "line-windows")
    first = windows.groupBy("window").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "text_hash", "at", "before", "after")).alias("first")
    ).filter("n > 1").drop("n")
    met = join_dim(windows, first, "window", "inner")
    later = met.filter(F.struct("id", "text_hash", "at") != F.struct("first.id", "first.text_hash", "first.at"))
    span = F.struct((F.col("at") - _agree("before")).alias("start"), (F.col("at") + F.col("size") + _agree("after")).alias("stop"))
    return later.select("id", "text_hash", span.alias("span")).groupBy("id", "text_hash").agg(F.collect_set("span").alias("spans"))


def _keep(text: str | None, spans: list[dict] | None) -> tuple[str | None, int, int, int]:
    """The text without the lines of the spans and the blank ones inside them; its lines, the
    removed lines and the removed runs, of those that are not blank."""
    if text is None:
        return None, 0, 0, 0
    lines, (numbers, _) = text.split("\n"), places(text)
    gone = np.zeros(len(lines) + 1, np.int64)
    for span in spans or ():
        gone[numbers[span["start"]]] += 1
        gone[numbers[span["stop"] - 1] + 1] -= 1
    covered = np.cumsum(gone)[:-1] > 0
    runs = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
    kept = "\n".join(line for line, c in zip(lines, covered.tolist(), strict=True) if not c)
    return kept, len(numbers), int(covered[numbers].sum()), runs


def edited(docs: DataFrame) -> DataFrame:
    """``row, text, n_lines, n_removed, n_runs`` of every row of ``docs``: its columns but the text
    as one, and the text without the lines of repeated runs.

    The earliest copy of a run stays whole. A null text stays null; of a text that is one
    repeated run, the empty text stays. Rows that repeat id and text are one document and change
    alike; rows that share an id only are ordered by a hash of their texts. An empty table
    gives no rows.
    """
    keyed = _keyed(docs)
    spans = repeated_runs(keyed).withColumnRenamed("id", "own").withColumnRenamed("text_hash", "own_hash")
    same = (F.col("id") == F.col("own")) & F.col("text_hash").eqNullSafe(F.col("own_hash"))
    marked = keyed.join(spans, same, "left").select("row", "text", "spans")
    schema = keyed.select("row", "text").withColumns({n: F.lit(None).cast("int") for n in ("n_lines", "n_removed", "n_runs")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)
            done = list(zip(*(_keep(text, spans) for text, spans in rows), strict=True)) or [(), (), (), ()]
            counts = {n: pa.array(c, pa.int32()) for n, c in zip(("n_lines", "n_removed", "n_runs"), done[1:], strict=True)}
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "text": pa.array(done[0], pa.string()), **counts})

    return marked.mapInArrow(run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with all its columns, ``text`` without the lines of repeated runs
    (``edited``)."""
    return unpacked(edited(docs), docs)
