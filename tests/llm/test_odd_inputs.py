"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import math

import pytest

from samplelake.llm import binary, decontam, langid, licenses, lines, packing, phrases, repeats, shards, simhash
from samplelake.session import new_table_path


def _binary(df):
    path = new_table_path(df.sparkSession, "records")
    binary.write_ids(df, path)
    return binary.read_records(df.sparkSession, path)


def _items(df):
    rows = [(1, "some item that nobody has ever written down"), (2, None), (None, "x"), (3, "")]
    return df.sparkSession.createDataFrame(rows, "item_id long, text string")


PER_ROW = {
    "phrases": phrases.compare_with_edits,
    "language": lambda df: langid.identify(df, langid.learn(df)),
    "shards": shards.assign,
    "binary": _binary,
    "simhash": simhash.near_copies,
    "repeats": repeats.without_repeats,
    "lines": lines.edited,
}
OTHER = {
    "packing": packing.pack,
    "licenses": licenses.scan,
    "leaks": lambda df: decontam.leaks(df, _items(df)),
    "no leaks": lambda df: decontam.without_leaks(df, _items(df)),
    "no near copies": simhash.without_near_copies,
    "own lines": lines.without_repeats,
    "known language": lambda df: langid.without_unknown(df, langid.learn(df), 0.1),
}


@pytest.mark.parametrize("name", [*PER_ROW, *OTHER])
def test_empty_table(name, none):
    assert {**PER_ROW, **OTHER}[name](none).count() == 0


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_has_a_result(name, odd):
    pairs, df = odd
    got = PER_ROW[name](df).collect()
    ids = [r["row"]["doc_id"] if "row" in r else r["doc_id"] for r in got]
    assert sorted(map(str, ids)) == sorted(str(i) for i, _ in pairs)


def test_phrases(odd):
    got = phrases.compare_with_edits(odd[1]).collect()
    by_text = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 7, 9)}
    assert by_text[1]["fingerprint"] == by_text[2]["fingerprint"] and by_text[1]["n_chars"] == 0
    assert by_text[1]["near_edited"] == 1.0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_language(odd):
    got = langid.identify(odd[1], langid.learn(odd[1])).collect()
    unknown = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert unknown == {None, 1, 2, 3, 4} and sum(r["lang_pred"] == "und" for r in got) == 5
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert all(r["held_out"] for r in got if r["doc_id"] is None)


def test_no_label_is_known(odd, spark):
    from pyspark.sql import functions as F

    df = odd[1].withColumn("lang", F.lit(None).cast("string"))
    assert langid.learn(df) is None
    assert {r["lang_pred"] for r in langid.identify(df, None).collect()} == {"und"}


def test_shards(odd):
    got = shards.assign(odd[1], shards=4).collect()
    assert all(r["size"] == 16 and r["text_crc32"] == 0 for r in got if r["doc_id"] in (1, 2))
    assert len({r["shard"] for r in got if r["doc_id"] in (7, 8)}) == 1
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_simhash(odd):
    got = simhash.near_copies(odd[1]).collect()
    assert all(r["fingerprint"] == "0" * 16 and r["component_id"] == 1 for r in got if r["doc_id"] in (1, 2, 3))
    assert all(r["component_id"] == 7 for r in got if r["doc_id"] in (7, 8))
    assert {r["component_id"] for r in got if r["doc_id"] in (6, 13)} == {6}
    kept = simhash.without_near_copies(odd[1])
    assert kept.columns == odd[1].columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(str(i) for i in (None, 1, 4, 5, 6, 7, 9, 9, 10, 11, 12))


def test_lines(odd):
    got = {(r["row"]["doc_id"], r["n_removed"]) for r in lines.edited(odd[1]).collect()}
    assert (1, 0) in got and (7, 0) in got and (9, 0) in got
    assert {n for i, n in got if i == 8} == {7} and {n for i, n in got if i == 13} != {0}


def test_repeats(odd):
    got = {r["doc_id"]: r for r in repeats.without_repeats(odd[1]).collect()}
    assert got[1]["n_bytes"] == 0 and got[1]["n_removed"] == 0 and got[1]["kept_sha256"][:8] == "e3b0c442"
    assert got[7]["n_removed"] == 0 and got[8]["n_removed"] == got[8]["n_bytes"] and got[8]["n_spans"] == 1
    assert got[11]["n_removed"] == 1500 - 3 and got[13]["n_bytes"] - got[13]["n_removed"] == 4


def test_packing(odd):
    got = packing.pack(odd[1]).collect()
    assert {(r["length"], r["ids_crc32"]) for r in got if r["doc_id"] in (1, 2)} == {(1, 558161692)}
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
    assert max(sum(n for _, n in places) for places in used.values()) <= 2048
    total = sum(r["length"] for r in got)
    assert len(used) == math.ceil(total / 2048)


def test_other_operators_keep_columns(odd):
    for name in ("no leaks", "known language", "no near copies", "own lines"):
        assert OTHER[name](odd[1]).columns == odd[1].columns
    assert OTHER["no leaks"](odd[1]).count() == len(odd[0])
    assert OTHER["known language"](odd[1]).count() == len(odd[0]) - 5
    assert licenses.scan(odd[1]).count() == 0 and OTHER["leaks"](odd[1]).count() == 0


def test_no_benchmark(odd, spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(odd[1], nothing).columns == ["doc_id", "item_id", "distance"]
    assert decontam.without_leaks(odd[1], nothing).count() == len(odd[0])
