"""Exact copies against a plain grouping."""

import hashlib
from collections import defaultdict

import pytest

from samplelake.llm import content_sort
from samplelake.session import materialise


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _plain(pairs, keep):
    groups, best = defaultdict(list), min if keep == "smallest" else max
    for i, t in pairs:
        groups[_lower(t)].append(i)
    rows = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        first = best(known) if known else None
        stays = [True]
        for i in ids:
            kept = i == first and bool(stays) and stays.pop()
            rows.append((i, first, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(rows, key=repr)


@pytest.fixture
def many_ranges(spark):
    """Ranges stay as small as they were cut."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_odd_texts(odd, keep):
    pairs, df = odd
    assert sorted(map(tuple, content_sort.copies(df, keep).collect()), key=repr) == _plain(pairs, keep)
    kept = content_sort.without_copies(df, keep)
    assert kept.columns == df.columns
    want = sorted(str(r[0]) for r in _plain(pairs, keep) if r[3])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_groups_over_many_ranges(frame, many_ranges, keep):
    # A hot text, a hot beginning, pairs, equal rows, letters beyond A-Z, common first bytes.
    pairs = [(i, "the same TEXT" if i % 2 else "The Same text") for i in range(400)]
    pairs += [(1000 + i, "x" * 40 + str(i % 70)) for i in range(300)] + [(2000 + i, f"own {i}") for i in range(150)]
    pairs += [(3000, "ÄÖ"), (3001, "äö"), (3002, "Äö"), (3003, "ÄÖ"), (7, "own 3"), (7, "own 3"), (None, "own 4"), (None, None), (5000, "")]
    df = frame(pairs)
    assert sorted(map(tuple, content_sort.copies(df, keep).collect()), key=repr) == _plain(pairs, keep)
    found = content_sort._groups(df, keep)
    filled = {r["range"] for r in found.filter("own is not null").filter("cast(own as string) = 'the same text'").collect()}
    assert len(filled) > 2


def test_names_that_clash(spark):
    rows = [(1, "a", "r", 1, 2.0), (2, "A", "r", 3, 4.0), (2, "A", "s", 5, 6.0), (None, None, None, None, None)]
    names = ["doc_id", "text", "row", "own_id", "a.b"]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, own_id long, `a.b` double")
    kept = content_sort.without_copies(df, "smallest")
    assert kept.columns == names and sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[3]], key=repr)
    assert content_sort.without_copies(df, "largest").count() == 2


def test_empty_table(none):
    assert content_sort.copies(none).collect() == [] and content_sort.without_copies(none).collect() == []


def test_another_end_is_refused(none):
    with pytest.raises(ValueError, match="smallest or largest"):
        content_sort.copies(none, "last")


def test_splitters_hold_no_whole_text(spark, frame):
    plan = content_sort._groups
    df = frame([(1, "a" * 10_000)])
    some = content_sort.id_and_text(df).selectExpr("doc_id as place", "text").mapInArrow(content_sort._normal, content_sort._SORTED)
    (row,) = materialise(some, "normal").collect()
    assert plan and len(row["head"]) == content_sort.HEAD and bytes(row["own"]) == b"a" * 10_000
