"""Attribute files in SOFT format, plain, gzip or in archives, as an attribute table."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samplelake.operators.joins import join_dim
from samplelake.session import materialise
from samplelake.sources.files import read_files


@dataclass(frozen=True)
class Soft:
    """``attr(file, kind, accession, key, key_ord, pos, value)``, ``entity(file, kind,
    accession, ord)`` and ``errors(file, stage, message)``."""

    attr: DataFrame
    entity: DataFrame
    errors: DataFrame


def read_path_list(spark: SparkSession, lists: str | Sequence[str]) -> DataFrame:
    """``path``: one row per non-blank line of path lists, trimmed."""
    lists = [lists] if isinstance(lists, str) else list(lists)
    return spark.read.text(lists).select(F.trim("value").alias("path")).filter("path != ''")


_HEAD = r"^\^(\w+)\s*=\s*(.*?)\s*$"
_LINE = re.compile(r"!\w*?_([^=]*?)\s*(?:=\s*(.*?)\s*)?$", re.ASCII)
_TABLE = re.compile("_table_(begin|end)")
#: A row of a run of lines, the end of a run, and how often a key stands at the open end of a run.
_ROW, _RUN, _KEYS = "row", "run", "keys"
_TYPES = {
    "mark": pa.string(), "file": pa.string(), "block": pa.int64(), "run": pa.int64(), "n": pa.int64(), "opens": pa.int64(),
    "section": pa.string(), "key": pa.string(), "nth": pa.int64(), "first": pa.int64(), "value": pa.string(),
}
_MARKED = (
    "mark string, file string, block bigint, run bigint, n bigint, opens bigint, section string, key string, nth bigint, "
    "first bigint, value string"
)


class _Run:
    """Lines of one block that a task reads in a row: the section each is in, and how often its key
    was there before, as far as this run shows."""

    def __init__(self, file: str, block: int, start: int) -> None:
        self.place = {"file": file, "block": block, "run": start}
        self.opens, self.section, self.seen, self.rows = 0, None, {}, []

    def add(self, n: int, value: str) -> None:
        row = {"mark": _ROW, **self.place, "n": n, "value": value}
        if value.startswith("^"):
            if not self.opens:
                # What came before the first section belongs to one of an earlier run.
                self._keys()
            self.opens, self.section, self.seen = self.opens + 1, value, {}
        elif not _TABLE.search(value) and (found := _LINE.match(value)):
            key = found[1]
            count, first = self.seen.get(key, (0, n))
            self.seen[key] = count + 1, first
            row |= {"key": key, "nth": count, "first": first, "value": found[2] or ""}
        self.rows.append(row | {"opens": self.opens, "section": self.section})

    def _keys(self) -> None:
        self.rows += [
            {"mark": _KEYS, **self.place, "opens": self.opens, "key": key, "nth": count, "first": first}
            for key, (count, first) in self.seen.items()
        ]

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pydict({name: pa.array([r.get(name) for r in rows], kind) for name, kind in _TYPES.items()})

    def end(self) -> pa.RecordBatch:
        self._keys()
        self.rows.append({"mark": _RUN, **self.place, "opens": self.opens, "section": self.section})
        return self.taken()


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run, last = None, None
    for batch in batches:
        for file, block, n, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "n", "value")), strict=True):
            if last is None or last[:2] != (file, block) or n <= last[2]:
                if run is not None:
                    yield run.end()
                run = _Run(file, block, n)
            last = file, block, n
            run.add(n, value)
        if run is not None and run.rows:
            yield run.taken()
    if run is not None:
        yield run.end()


def read_soft(spark: SparkSession, paths: DataFrame | str | Sequence[str]) -> Soft:
    """Attributes and entities of SOFT files: a list of files, folders and globs, or a frame with
    paths in its first column (``read_path_list``).

    Each file is read once (``read_files``). A path that is not there and a file that cannot be read
    to its end have a row in ``errors`` and give nothing. An entity that begins in one block and goes
    on in the next is carried over by one row per run of lines and one per key at its open end; the
    lines are never shuffled.
    """
    files = read_files(spark, paths, keep=F.col("value").rlike(r"^[\^!]"))
    marked = materialise(files.parts.mapInArrow(_sections, _MARKED), "soft-lines")
    place = ["file", "block", "run"]
    earlier = Window.partitionBy("file").orderBy("block", "run").rowsBetween(Window.unboundedPreceding, -1)
    runs = marked.filter(F.col("mark") == _RUN).select(
        *place, F.coalesce(F.sum("opens").over(earlier), F.lit(0)).alias("opens_before"),
        F.last("section", ignorenulls=True).over(earlier).alias("section_before"),
    )
    runs = materialise(runs.join(files.before.select("file", "block", "n_before"), ["file", "block"]), "soft-runs")
    # How often a key was there in the same section of earlier runs, and where first.
    number = F.col("opens") + F.col("opens_before")
    same = Window.partitionBy("file", "ord", "key").orderBy("block", "run").rowsBetween(Window.unboundedPreceding, -1)
    ends = marked.filter(F.col("mark") == _KEYS).select(*place, "opens", "key", "nth", "first").join(runs, place)
    placed = ends.select(*place, "opens", "key", "nth", (F.col("first") + F.col("n_before")).alias("first"), number.alias("ord"))
    carried = placed.select(
        *place, "opens", F.col("key").alias("open_key"), F.sum("nth").over(same).alias("nth_before"), F.min("first").over(same).alias("first_before")
    ).filter("opens = 0 AND nth_before IS NOT NULL").drop("opens")
    rows = marked.filter(F.col("mark") == _ROW).withColumn("open_key", F.when(F.col("opens") == 0, F.col("key")))
    rows = join_dim(join_dim(rows, runs, place, "inner", stored=True), carried, [*place, "open_key"])
    section = F.coalesce("section", "section_before")
    owned = rows.select(
        "file", F.upper(F.regexp_extract(section, _HEAD, 1)).alias("kind"), F.regexp_extract(section, _HEAD, 2).alias("accession"),
        number.alias("ord"), "key", F.coalesce(F.col("first_before"), F.col("first") + F.col("n_before")).alias("key_ord"),
        (F.col("nth") + F.coalesce("nth_before", F.lit(0))).alias("pos"), F.col("value"),
    ).filter("accession <> ''")
    entity = owned.filter(F.col("key").isNull() & F.col("value").startswith("^")).select("file", "kind", "accession", (F.col("ord") - 1).alias("ord"))
    attr = owned.filter(F.col("key").isNotNull()).select("file", "kind", "accession", "key", "key_ord", "pos", "value")
    known = entity.groupBy("file").agg(F.max(F.col("kind").isin("SAMPLE", "SERIES")).alias("useful"))
    odd = files.files.select("file").join(known, "file", "left").filter(~F.coalesce("useful", F.lit(False)))
    odd = odd.select("file", F.lit("parse").alias("stage"), F.lit("neither a sample nor a series in the file").alias("message"))
    return Soft(attr, entity, files.errors.unionByName(odd))
