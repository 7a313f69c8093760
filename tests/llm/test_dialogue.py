"""Repair of conversations against all edits, tried one by one."""

import hashlib
import random
import re
import zlib

import pytest

from samplelake.llm import dialogue
from samplelake.llm import dialogue_path as path

ROLES = ("user", "assistant", "system", "u", "tool", " ", "")
COLUMNS = "conv_id long, turn long, role string, text string, audit string, place long, `a.b` int, part int"


def _faults(rows):
    found, seen = [], set()
    for role, text in rows:
        own = text.rstrip(" \t\n\x0b\x0c\r")
        found.append("blank" if not own else "duplicate" if (role, text) in seen else "truncated" if own[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def _best(rows):
    """Cost, audit and turns of the best edits, by trying all with up to four new turns."""
    faults, best = _faults(rows), None

    def go(at, cost, audit, made, added):
        nonlocal best
        if best and cost > best[0]:
            return
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", "".join((role or "?")[0] for role, _ in made)):
            best = min(best or (cost, audit, made), (cost, audit, made), key=lambda b: b[:2])
        if added < 4:
            for role in ("user", "assistant"):
                go(at, cost + 5, audit + "I", [*made, (role, "")], added + 1)
        if at < len(rows):
            go(at + 1, cost + 2, audit + "D", made, added)
            if faults[at] not in ("blank", "duplicate"):
                more = cost + 5 * (faults[at] == "truncated")
                go(at + 1, more, audit + "K", [*made, rows[at]], added)
                for role in ("user", "assistant"):
                    go(at + 1, more + 1, audit + "R", [*made, (role, rows[at][1])], added)

    go(0, 0, "", [], 0)
    return best


def _counts(turns, rows):
    faults, known = _faults(rows), [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal


def test_all_edits_and_cuts():
    draw = random.Random(4)
    for _ in range(250):
        rows = [(draw.choice(ROLES[:5]), draw.choice(["Yes.", "no", "", "Why?"])) for _ in range(draw.randrange(5))]
        codes = dialogue._marked([(0, *r) for r in rows], [r in rows[:i] for i, r in enumerate(rows)])[1]
        ((cost, audit, states),) = path.solve([(codes, path.END_COSTS, True, [path.NOTHING])])[0]
        assert (cost, audit, path.repaired(audit, states, rows)) == _best(rows)
        assert path.states_of(audit, path.NOTHING, [r for r, _ in rows]) == states
        for cut in range(1, len(codes)):
            behind = path.costs_back(codes[cut:], path.END_COSTS)[0]
            over = path.moves(codes[:cut])
            assert min(over[e] + behind[e] for e in range(4)) == cost
            ((_, first, by),) = path.solve([(codes[:cut], behind, False, [path.NOTHING])])[0]
            ((_, then, _),) = path.solve([(codes[cut:], path.END_COSTS, True, [by[-1]])])[0]
            assert first + then == audit


def _check(df, rows):
    """``rows``: conv_id, turn, role, text, in the order of turns without ties."""
    audits, turns = dialogue.repair(df)
    made = {}
    for r in sorted(turns.collect(), key=lambda r: r["place"]):
        made.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    sums = {r["conv_id"]: r["repaired_sha256"] for r in dialogue.digests(turns).collect()}
    got = {r["conv_id"]: r for r in audits.collect()}
    assert len(got) == audits.count() == len({r[0] for r in rows})
    for key, r in got.items():
        own = [x[1:] for x in rows if x[0] == key]
        texts = [x[1:] for x in own]
        assert tuple(r)[1:6] == _counts([x[0] for x in own], texts)
        if len(own) < 9:
            assert (r["cost"], r["audit"], made.get(key, [])) == _best(texts)
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in made.get(key, [])))
        if key in made:
            assert sums[key] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made[key]).encode()).hexdigest()
    return got, made


def test_long_conversations_over_many_ranges(spark):
    draw = random.Random(9)
    rows = [(5, t, draw.choice(ROLES[:3]), draw.choice(["Yes.", "no", "", f"Why {t}?", f"{t}."])) for t in range(700) if t % 7]
    rows += [(c, t, draw.choice(ROLES[:5]), draw.choice(["Yes.", f"{t}?", " ", f"on {t}"])) for c in (1, 2, 6, 7, 8, 9, 12) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for partitions, joined in (("11", "false"), ("1", "true")):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", joined)
        try:
            got[partitions] = _check(df, rows)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got["11"] == got["1"] and len(got["1"][0][5]["audit"]) >= 600


def test_nulls_and_names_that_clash(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (1, 3, None, "x."), (1, 9, "user", None),
        (2, None, "user", "One."), (2, 4, "user", "One."), (2, 5, "assistant", " "), (3, 1, "", "é" * 70_000 + "."),
    ]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], COLUMNS)
    _check(df, [(c, t, r or (" " if r is None else r), " " if x is None else x) for c, t, r, x in rows])
    assert [x.count() for x in dialogue.repair(df.limit(0))] == [0, 0]
    assert dialogue.repair_damaged(df.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "system", "A! b? c.") for c in range(30) for t in range(4)] + [(None, None, None, None), (7, 1, "system", "again")]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], COLUMNS)
    want = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind, role, text = zlib.crc32(key.encode()) % 20, role or " ", text or " "
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text)
        want += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(tuple, dialogue.damaged(df).collect()), key=repr) == sorted(want, key=repr)
    got = dialogue.repair_damaged(df).collect()
    assert len(got) == len({r[0] for r in rows})


def test_a_conversation_without_rows_stays(spark):
    gone = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    (row,) = dialogue.repair_damaged(df).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_letters_must_differ():
    import numpy as np

    with pytest.raises(ValueError, match="share a letter"):
        path.least_paths(3, np.array([0, 0]), np.array([68, 68]), np.array([1, 2]), np.array([0]))
