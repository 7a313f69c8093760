"""Faults of conversations and their cheapest repair.

Rows are sorted by conversation and turn over ranges, as many as it takes, so a conversation of any
length is spread over the ranges that its rows fill. One pass over a range solves the
conversations that lie inside it (``dialogue_path``). Those at the two ends of a range may go on
in the next one, so their rows are kept as pieces, one per range, and solved in turns: each
piece tells what it costs to get over it from each state to each; what is left to pay behind a
piece follows from these numbers, piece by piece from the last; each piece then finds its least
path from each state; and the states that the whole path passes follow from the first piece on.
Between pieces only such numbers and audits are gathered, one row per piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplelake.llm import dialogue_path as path
from samplelake.session import materialise

#: Rows solved together.
TOGETHER = 1 << 13
BLANKS = " \t\n\v\f\r"
INSIDE, FIRST, LAST = 0, 1, 2
AUDIT, TURN, ROW = 0, 1, 2
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

_TYPES = {
    "kind": pa.int32(), "conv_id": pa.int64(), "part": pa.int32(), "side": pa.int32(), "place": pa.int64(),
    "turn": pa.int64(), "role": pa.string(), "text": pa.string(), **{c: pa.int64() for c in COUNTS}, "audit": pa.string(),
}
_FOUND = (
    "kind int, conv_id bigint, part int, side int, place bigint, turn bigint, role string, text string, "
    + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string"
)


def _batch(rows: list[dict], types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: pa.array([r.get(name) for r in rows], kind) for name, kind in types.items()})


def _fault(text: str, seen: bool) -> tuple[str | None, int]:
    """The name of a row's first fault, and what it means for its edits."""
    own = text.rstrip(BLANKS)
    if not own:
        return "blank", path.GONE
    if seen:
        return "duplicate", path.GONE
    return (None, path.SOUND) if own[-1] in ".!?" else ("truncated", path.TRUNCATED)


def _legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


def _gaps(turns: list[int | None]) -> int:
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - len(set(known)) if known else 0


def _marked(rows: list[tuple], seen: list[bool]) -> tuple[dict, list[int]]:
    """Counts of faults of ``turn, role, text`` rows, and their codes."""
    counts = {"blank": 0, "duplicate": 0, "truncated": 0}
    codes = []
    for (_, role, text), before in zip(rows, seen, strict=True):
        name, fault = _fault(text, before)
        if name:
            counts[name] += 1
        codes.append(path.code_of(role, fault))
    counts["illegal"] = sum(not _legal(a[1], b[1]) for a, b in pairwise(rows))
    return counts, codes


def _solved(some: list[tuple[int | None, list[tuple]]]) -> pa.RecordBatch:
    """The audits and turns of whole conversations."""
    out, pieces = [], []
    for key, rows in some:
        own: set = set()
        seen = [r[1:] in own or own.add(r[1:]) is not None for r in rows]
        counts, codes = _marked(rows, seen)
        out.append({"kind": AUDIT, "conv_id": key, "gaps": _gaps([r[0] for r in rows]), **counts})
        pieces.append((codes, path.END_COSTS, True, [path.NOTHING]))
    turns = []
    for told, (key, rows), ((cost, audit, states),) in zip(out, some, path.solve(pieces), strict=True):
        told |= {"cost": cost, "audit": audit}
        made = path.repaired(audit, states, [r[1:] for r in rows])
        turns += [{"kind": TURN, "conv_id": key, "place": i, "role": role, "text": text} for i, (role, text) in enumerate(made)]
    return _batch(out + turns, _TYPES)


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a sorted range: conversations inside it are solved, the rows of the first and
    the last are passed on."""
    part = TaskContext.get().partitionId()

    def passed(key: int | None, rows: list[tuple], side: int, at: int) -> pa.RecordBatch:
        return _batch([
            {"kind": ROW, "conv_id": key, "part": part, "side": side, "place": at + i, "turn": turn, "role": role, "text": text}
            for i, (turn, role, text) in enumerate(rows)
        ], _TYPES)

    waiting: list[tuple[int | None, list[tuple]]] = []
    number = size = 0
    for key, group in groupby(_rows(batches, ("conv_id", "turn", "role", "text")), key=lambda r: r[0]):
        rows: list[tuple] = []
        at = 0
        for row in group:
            rows.append(row[1:])
            if number == 0 and len(rows) == TOGETHER:
                yield passed(key, rows, FIRST, at)
                at, rows = at + len(rows), []
        if number == 0:
            yield passed(key, rows, FIRST, at)
        else:
            # The one before is not the last of the range.
            if size >= TOGETHER:
                last = waiting.pop() if number > 1 else None
                yield _solved(waiting)
                waiting, size = [last], len(last[1])
            waiting.append((key, rows))
            size += len(rows)
        number += 1
    if waiting:
        key, rows = waiting.pop()
        yield _solved(waiting)
        yield passed(key, rows, LAST, 0)


def _by_piece(rows: DataFrame, work: Callable, schema: str, types: dict) -> DataFrame:
    """``work`` gets the rows of one piece, which came out of one range, by their place."""
    names = tuple(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("part"), names.index("side")
        for _, group in groupby(_rows(batches, names), key=lambda r: (r[at[0]], r[at[1]])):
            yield _batch(work([dict(zip(names, r, strict=True)) for r in group]), types)

    return rows.repartition("part", "side").sortWithinPartitions("part", "side", "place").mapInArrow(run, schema)


def _by_conversation(rows: DataFrame, work: Callable, schema: str, types: dict) -> DataFrame:
    """``work`` gets the pieces of one conversation, one row each, in their order."""
    names = tuple(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("conv_id")
        for _, group in groupby(_rows(batches, names), key=lambda r: r[at]):
            yield _batch(work([dict(zip(names, r, strict=True)) for r in group]), types)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "side").mapInArrow(run, schema)


_LONGS = pa.list_(pa.int64())
_PIECE = {"conv_id": pa.int64(), "part": pa.int32(), "side": pa.int32()}
_SUMMARY = _PIECE | {c: pa.int64() for c in COUNTS} | {
    "low": pa.int64(), "high": pa.int64(), "turns": pa.int64(), "head": pa.string(), "tail": pa.string(), "moves": _LONGS,
}
_SUMMARY_SCHEMA = (
    "conv_id bigint, part int, side int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    + ", low bigint, high bigint, turns bigint, head string, tail string, moves array<bigint>"
)
_COUNTED = _PIECE | {c: pa.int64() for c in COUNTS} | {"ends": pa.bool_(), "end": _LONGS}
_COUNTED_SCHEMA = (
    "conv_id bigint, part int, side int, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", ends boolean, end array<bigint>"
)
_WAYS = _PIECE | {"exits": _LONGS, "audits": pa.list_(pa.string())}
_WAYS_SCHEMA = "conv_id bigint, part int, side int, exits array<bigint>, audits array<string>"
_WAY = _PIECE | {"entry": pa.int64(), "own_audit": pa.string(), "audit": pa.string()}
_WAY_SCHEMA = "conv_id bigint, part int, side int, entry bigint, own_audit string, audit string"


def _codes(rows: list[dict]) -> tuple[dict, list[int]]:
    return _marked([(r["turn"], r["role"], r["text"]) for r in rows], [r["seen"] for r in rows])


def _summary(rows: list[dict]) -> list[dict]:
    counts, codes = _codes(rows)
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    return [{
        **{c: rows[0][c] for c in _PIECE}, **counts, "low": min(turns, default=None), "high": max(turns, default=None),
        "turns": len(set(turns)), "head": rows[0]["role"][:1], "tail": rows[-1]["role"][:1], "moves": path.moves(codes),
    }]


def _counted(pieces: list[dict]) -> list[dict]:
    """What is left to pay behind each piece; the first also carries the conversation's counts."""
    n = path.STATES
    end, ends = list(path.END_COSTS), [None] * len(pieces)
    for i in range(len(pieces) - 1, -1, -1):
        ends[i], way = end, pieces[i]["moves"]
        end = [min(way[n * s + t] + end[t] for t in range(n)) for s in range(n)]
    counts = {c: sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated", "illegal")}
    counts["illegal"] += sum(not _legal(a["tail"], b["head"]) for a, b in pairwise(pieces))
    known = [p for p in pieces if p["turns"]]
    # A turn may begin at the end of one piece and go on in the next.
    distinct = sum(p["turns"] for p in known) - sum(a["high"] == b["low"] for a, b in pairwise(known))
    gaps = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
    out = [{**{c: p[c] for c in _PIECE}, "ends": p is pieces[-1], "end": e} for p, e in zip(pieces, ends, strict=True)]
    out[0] |= {**counts, "gaps": gaps, "cost": end[path.NOTHING]}
    return out


def _ways(rows: list[dict]) -> list[dict]:
    """The least path through a piece from each state; its first row tells what comes behind."""
    head, rows = rows[0], rows[1:]
    (found,) = path.solve([(_codes(rows)[1], head["end"], head["ends"], range(path.STATES))])
    exits = [states[-1] for _, _, states in found]
    return [{**{c: head[c] for c in _PIECE}, "exits": exits, "audits": [audit for _, audit, _ in found]}]


def _way(pieces: list[dict]) -> list[dict]:
    """The state that the whole path enters each piece in; the first carries the whole audit."""
    state, out = path.NOTHING, []
    for p in pieces:
        out.append({**{c: p[c] for c in _PIECE}, "entry": state, "own_audit": p["audits"][state]})
        state = p["exits"][state]
    out[0]["audit"] = "".join(p["own_audit"] for p in out)
    return out


_TURN = {"conv_id": pa.int64(), "place": pa.int64(), "role": pa.string(), "text": pa.string()}
_TURN_SCHEMA = "conv_id bigint, place bigint, role string, text string"


def _turns(rows: list[dict]) -> list[dict]:
    """The turns that a piece's audit, in its first row, makes of the others."""
    head, rows = rows[0], rows[1:]
    states = path.states_of(head["own_audit"], head["entry"], [r["role"] for r in rows])
    made = path.repaired(head["own_audit"], states, [(r["role"], r["text"]) for r in rows])
    first = (2 * head["part"] + head["side"]) << 36
    return [{"conv_id": head["conv_id"], "place": first + i, "role": r, "text": t} for i, (r, t) in enumerate(made)]


def _pieces_solved(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits and turns of the conversations whose rows are pieces."""
    here = F.struct("part", "side", "place")
    first = rows.groupBy(F.col("conv_id").alias("of"), F.col("role").alias("r"), F.col("text").alias("t")).agg(
        F.min(here).alias("first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t"))
    marked = materialise(rows.join(first, same).select(*rows.columns, (here > F.col("first")).alias("seen")), "pieces")
    summaries = _by_piece(marked, _summary, _SUMMARY_SCHEMA, _SUMMARY)
    counted = materialise(_by_conversation(summaries, _counted, _COUNTED_SCHEMA, _COUNTED), "piece-costs")

    def headed(heads: DataFrame) -> DataFrame:
        return marked.unionByName(heads.withColumn("place", F.lit(-1).cast("bigint")), allowMissingColumns=True)

    ways = _by_piece(headed(counted.select(*_PIECE, "ends", "end")), _ways, _WAYS_SCHEMA, _WAYS)
    way = materialise(_by_conversation(ways, _way, _WAY_SCHEMA, _WAY), "piece-paths")
    turns = _by_piece(headed(way.select(*_PIECE, "entry", "own_audit")), _turns, _TURN_SCHEMA, _TURN)
    # One row per conversation on both sides.
    told = counted.filter("cost is not null").select("conv_id", *COUNTS)
    audit = way.filter("audit is not null").select(F.col("conv_id").alias("own"), "audit")
    return told.join(audit, told["conv_id"].eqNullSafe(audit["own"])).drop("own"), turns


def _or_space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables for ``conv_id, turn, role, text`` rows: ``conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit`` of each conversation, and the repaired turns
    ``conv_id, place, role, text``, in the order of ``place`` (numbers may be left out).

    The repaired roles alternate between user and assistant, with a system turn before them at
    most, and end with the assistant; a conversation may also become empty. Rows go by turn, null
    turns first, those of one turn by a hash of role and text, so that equal ones are side by
    side. Each row's first fault counts: ``blank``, ``duplicate`` of an earlier row's role and
    text, ``truncated`` (its last letter is no full stop, exclamation or question mark).
    ``illegal`` counts neighbours whose roles do not follow each other, ``gaps`` the turns left
    out. ``cost`` is the least cost of edits, ``audit`` their initials (Delete, Insert, Keep,
    Rerole), the first in their order where several cost the same. Null roles and texts count as one
    space; rows with null ids are one conversation; other columns are not looked at. An empty
    table gives none.
    """
    own = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        _or_space("role").alias("role"), _or_space("text").alias("text"),
    )
    # The last column deals out even equal rows.
    keyed = own.withColumn("mix", F.xxhash64("role", "text")).withColumn("copy", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "mix"]
    ranges = keyed.repartitionByRange(*order, "copy").sortWithinPartitions(*order, "role", "text", "copy")
    found = materialise(ranges.select("conv_id", "turn", "role", "text").mapInArrow(_split, _FOUND), "conversations")
    audits, turns = _pieces_solved(found.filter(F.col("kind") == ROW).select(*_PIECE, "place", "turn", "role", "text"))
    columns = ["conv_id", *COUNTS, "audit"]
    return (
        found.filter(F.col("kind") == AUDIT).select(*columns).unionByName(audits.select(*columns)),
        found.filter(F.col("kind") == TURN).select(*_TURN).unionByName(turns),
    )


def digests(turns: DataFrame, name: str = "repaired_sha256") -> DataFrame:
    """``conv_id`` and the sha256 of its ``role:text`` turns, one per line.

    Such a digest can only be taken from the first turn to the last, so a conversation's turns are
    sorted in one task, by Spark, and pass through it one batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in groupby(_rows(batches, ("conv_id", "role", "text")), key=lambda r: r[0]):
            state, between = hashlib.sha256(), b""
            for _, role, text in group:
                state.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                between = b"\n"
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([key], pa.int64()), name: [state.hexdigest()]})

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(run, f"conv_id bigint, {name} string")


def damaged(conversations: DataFrame, kinds: int = 20) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` as faulty as those of crawled conversations, by
    crc32(``conv_id:turn``) modulo ``kinds``: 0 drops a row, 1 empties its text, 2 takes out its
    full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Nulls count
    as one space."""
    key = F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn"))
    kind = F.pmod(F.crc32(F.encode(key, "utf-8")), F.lit(kinds))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(_or_space("text"), ".!?", "")).otherwise(_or_space("text"))
    made = conversations.filter(kind != 0).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(_or_space("role")).alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(0), F.when(kind == 3, 1).otherwise(0))).alias("copy"),
    )
    return made.drop("copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: what ``repair`` tells of its ``damaged`` rows, and
    ``repaired_sha256``. A conversation that has lost all rows has zeros and the digest of nothing."""
    audits, turns = repair(damaged(conversations))
    told, sums = materialise(audits, "audits"), digests(turns).withColumnRenamed("conv_id", "own")
    every = conversations.select(F.col("conv_id").cast("bigint").alias("id")).distinct()
    whole = every.join(told, every["id"].eqNullSafe(told["conv_id"]), "left")
    joined = whole.join(sums, whole["id"].eqNullSafe(sums["own"]), "left")
    nothing = hashlib.sha256().hexdigest()
    return joined.select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
