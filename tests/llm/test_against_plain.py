"""The queries over whole small tables against plain versions without Spark."""

import hashlib
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from oracle import compare, connect
from samplelake.llm import decontam, langid, lines, phrases, repeats, simhash
from samplelake.llm.components import components
from samplelake.llm.queries import QUERIES
from samplelake.llm.tokens import default_path

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def docs():
    return sorted(duckdb.sql(f"SELECT doc_id, text, lang FROM '{FOLDER}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def run(spark):
    def start(name):
        return QUERIES[name].run(spark, FOLDER).collect()

    return start


def _ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path())
    return [x.ids + [0] for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_phrase_fingerprints(run, docs, monkeypatch):
    def phrases_of(text):
        seen, piece = set(), ""
        for c in text:
            piece += c
            if piece not in seen:
                seen.add(piece)
                piece = ""
        return seen

    monkeypatch.setattr(phrases, "BLOCK_ROWS", 20)
    got = {r["doc_id"]: r for r in run("op1_phrase_fingerprints")}
    assert len(got) == len(docs)
    down = docs[::-1]
    off = []
    for i, (doc_id, text, _) in enumerate(down):
        after = down[(i + 1) % len(down)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        row = got[doc_id]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["edited_fingerprint"] == phrases.text_of(phrases.fingerprint(edited))
        assert row["fingerprint"] == phrases.text_of(phrases.fingerprint(text))
        for other, near in ((edited, row["near_edited"]), (after, row["near_next"])):
            a, b = phrases_of(text), phrases_of(other)
            off.append(abs(near - len(a & b) / len(a | b)))
    assert np.mean(off) < 0.05 and max(off) < 0.35


def test_language_of_held_out_documents(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(big, langid.learn(big)).join(big.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) > 100


def test_language_does_not_see_held_out_labels(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(langid.identify(docs, langid.learn(docs)).collect()) == sorted(langid.identify(wrong, langid.learn(wrong)).collect())


def test_shards(run, docs):
    texts = {i: (t or "").encode() for i, t, _ in docs}
    filled, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in run("op3_minimax_shards"):
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 16, zlib.crc32(texts[r["doc_id"]]))
        assert r["law"] == "bytes" and 0 <= r["shard"] < 40 and r["grown_shard"] is None
        filled[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[texts[r["doc_id"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values()) and sum(map(len, slots.values())) == len(docs)
    # Groups as large as an even share have shards of their own; no other shard is larger than
    # an even share of the rest and the largest group of it.
    sizes = Counter()
    for _, t, _ in docs:
        sizes[t] += len(t.encode()) + 16
    total, shards, largest = sum(sizes.values()), 40, sorted(sizes.values(), reverse=True)
    while largest and largest[0] * shards >= total and shards > 1:
        total, shards = total - largest.pop(0), shards - 1
    rest = sorted(filled.values())[:shards]
    assert max(rest) <= total / shards + largest[0]


def test_binary_records(spark, run, docs):
    want, start = [], 0
    for (doc_id, _, _), ids in zip(docs, _ids([t for _, t, _ in docs]), strict=True):
        want.append((doc_id, start, len(ids), _crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, run("op4_binary_records"))) == want


def test_shuffled_reads_and_broken_files(spark, docs, tmp_path):
    from samplelake.llm import binary

    path = str(tmp_path / "records")
    binary.write_ids(spark.read.parquet(f"{FOLDER}/documents.parquet"), path)
    some = binary.read_index(spark, path).filter(F.col("doc_id") % 7 == 0)
    found = {r["doc_id"]: r["ids"] for r in binary.read_shuffled(spark, path, some.orderBy(F.rand(3))).collect()}
    by_id = {i: t for i, t, _ in docs if i % 7 == 0}
    assert found == dict(zip(by_id, _ids(by_id.values()), strict=True))
    part = max((tmp_path / "records/kind=records").glob("part-*"), key=lambda p: p.stat().st_size)
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 4
    part.write_bytes(data)
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="checksum|is cut"):
        binary.read_records(spark, path).collect()


def _bits(text, words):
    found = text.encode().lower().split()
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(values, near):
    """The least key of each component, by trying all pairs."""
    keys = sorted(values)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if near(values[a], values[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def _close(a, b):
    return (a ^ b).bit_count() <= 2


def test_simhash(run, docs):
    bits = {i: _bits(t, 3) for i, t, _ in docs}
    roots = _roots(bits, _close)
    assert {tuple(r) for r in run("op5_simhash")} == {(i, f"{bits[i]:016x}", roots[i]) for i in bits}


def test_spark_hashes_are_the_shingle_hashes(spark):
    assert spark.sql("SELECT xxhash64('one two three') AS h").first()["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


@pytest.mark.parametrize("crowd", [8, 10**9])
def test_links_of_crowds_reach_the_same(spark, crowd):
    draw = np.random.default_rng(1)
    values = set()
    for base in draw.integers(0, 1 << 62, 3).tolist():
        for _ in range(150):
            value = base
            for bit in set(draw.integers(0, 64, draw.integers(0, 5)).tolist()):
                value ^= 1 << bit
            values.add(value - (1 << 64) if value >> 63 else value)
    nodes = spark.createDataFrame([(v,) for v in values], "bits long")
    got = {r["node"]: r["root"] for r in components(simhash.links(nodes, crowd)).collect()}
    want = _roots({v: v % (1 << 64) for v in values}, _close)
    assert {v: got.get(v, v) for v in values} == want


def test_components(spark):
    draw = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + draw.integers(2000, 2100, (60, 2)).tolist()
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {tuple(sorted(e)) for e in edges}
    want = _roots({n: n for e in edges for n in e if e[0] != e[1]}, lambda a, b: (a, b) in near)
    assert got == want


def _check_packing(rows, docs):
    ids = dict(zip([d[0] for d in docs], _ids([d[1] for d in docs]), strict=True))
    pieces, used, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and _crc(own) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    assert set(pieces) == set(ids) and total == sum(map(len, ids.values()))
    for found in pieces.values():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found))) and all(n == 2048 for _, _, n in found[1:])
        assert [s for _, s, _ in found] == [sum(n for _, _, n in found[:i]) for i in range(len(found))]
    for found in used.values():
        found.sort()
        assert [a for a, _ in found] == [sum(n for _, n in found[:i]) for i in range(len(found))]
        assert sum(n for _, n in found) <= 2048
    assert len(used) <= -(-total // 2048) * 1.02 + 1


def test_packing(run, docs):
    _check_packing(run("op6_best_fit_packing"), docs)


def test_license_scan(run, docs):
    lines_ = {
        "Apache-2.0": "Licensed under the Apache License, Version 2.0", "MIT": "Released under the MIT License",
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0", "proprietary": "All rights reserved",
    }
    want = {(i, name): t.lower().count(line.lower()) for i, t, _ in docs for name, line in lines_.items() if line.lower() in t.lower()}
    got = Counter((r["doc_id"], r["license_id"]) for r in run("op7_license_scan"))
    assert got == want and got


def _without_strings(docs, length=100):
    seen, out = set(), {}
    for doc_id, text, *_ in docs:
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(data[i : i + length])
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most", [1 << 19, 400])
def test_repeated_strings(spark, docs, most):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bounds = {} if most > 400 else {"common": 3, "per_task": 0}
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.without_repeats(table, most, **bounds).collect()}
    assert got == _without_strings(docs)


@pytest.mark.parametrize("most", [1 << 19, 3000, 0])
def test_a_passage_in_many_surroundings(frame, most):
    draw = np.random.default_rng(8)
    letters = list("abcdefgh ")

    def text(n):
        return "".join(draw.choice(letters, n))

    passage = text(180)
    pairs = [(i, text(90) + passage[int(draw.integers(0, 3)) :] + text(90)) for i in range(120)]
    pairs += [(200 + i, passage[:140] + "x" * i + passage[140:]) for i in range(20)] + [(300, passage * 3), (301, "ab" * 300)]
    bounds = {"common": 20, "per_task": 0} if most == 3000 else {}
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.without_repeats(frame(pairs), most, **bounds).collect()}
    assert got == _without_strings(pairs)


def test_common_anchors_are_counted_in_full(frame):
    passage = "the same words again and again " * 6
    df = repeats._keyed(frame([(i, passage + str(i) * 40) for i in range(300)] + [(1000 + i, str(i) * 200) for i in range(9)]))
    assert len(repeats._common(df, 200, 0)) > 0 and len(repeats._common(df, 3000, 0)) == 0


def test_line_dedup_equals_its_sql(spark):
    q = QUERIES["op9_line_dedup"]
    assert compare(spark, connect(FOLDER), FOLDER, "op9_line_dedup", q.run, q.sql)[0] == "equal"


def _held(item, text, most):
    """Whether the item is in the text with up to ``most`` edits, for all places at once."""
    points = np.array([ord(c) for c in text])
    at = np.arange(len(points) + 1)
    row = np.zeros(len(points) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (points != ord(c)))))
        row = np.minimum.accumulate(new - at) + at
    return int(row.min()) if row.min() <= most else None


def _plain_leaks(docs, items):
    texts = {i: decontam.normal(t) for i, t, *_ in docs}
    every, starts = [], {}
    at = 0
    for i, t in texts.items():
        starts[i] = at
        at += len(t) + 1000
        every.append(t + "\x00" * 1000)
    joined = "".join(every)
    found = set()
    points = np.array([ord(c) for c in joined])
    place = np.arange(len(points) + 1)
    for item_id, text in items:
        item = decontam.normal(text)
        row = np.zeros(len(points) + 1, int)
        for i, c in enumerate(item, 1):
            new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (points != ord(c)))))
            row = np.minimum.accumulate(new - place) + place
        for doc_id, start in starts.items():
            best = int(row[start : start + len(texts[doc_id]) + 1].min())
            if best <= int(len(item) * decontam.ERROR_RATE):
                found.add((doc_id, item_id, best))
    return found


def _benchmark():
    return duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()


def test_decontamination(run, docs):
    assert {tuple(r) for r in run("op10_decontamination")} == _plain_leaks(docs, _benchmark())


def test_leaks_with_edits_and_blocks(spark, frame):
    item = "the quick brown fox jumps over the lazy dog and then goes home to sleep until noon"
    other = "an item of other words that nobody would ever write by chance in any document at all"
    edited = item.replace("quick", "quikc").replace("home", "hom")
    many = item.replace("o", "0")
    pairs = [(1, f"x {item} y"), (2, f"A {edited.upper()}\n b"), (3, many), (4, item[: len(item) // 2]), (5, other), (6, "tiny")]
    pairs += [(7, "a tiny one"), (8, f"{edited} {item}"), (9, "tinyness of tin")]
    # An item may be there again, with other blanks; in small blocks that is far from the first.
    items = [(10, item), (11, item), (12, other), (13, "tiny"), (10, item.replace(" ", "  ").upper()), (13, " Tiny")]
    items = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 50):
        rows = decontam.leaks(frame(pairs), items, block_chars=block).collect()
        got = {tuple(r) for r in rows}
        assert len(got) == len(rows)
        assert got == {(1, 10, 0), (1, 11, 0), (2, 10, 3), (2, 11, 3), (5, 12, 0), (6, 13, 0), (7, 13, 0), (8, 10, 0), (8, 11, 0)}
        assert {r["doc_id"] for r in decontam.without_leaks(frame(pairs), items, block_chars=block).collect()} == {3, 4, 9}
    assert _held(item, edited, 4) == 3


def _plain_lines(docs):
    """Texts without repeated lines: each window (``lines``) that an earlier place has, with up to
    two lines on each side that agree, goes."""
    first, own, left = {}, {}, []
    for doc_id, text in docs:
        own[doc_id] = lines.places(text)[1]
    for doc_id, text in docs:
        numbers, mine = lines.places(text)
        gone = set()
        for k in range(len(mine)):
            size = next((n for n in (1, 2, 3) if k + n <= len(mine) and (n == 3 or sum(len(x.split()) for x in mine[k : k + n]) >= 20)), None)
            if size is None:
                continue
            window = "\n".join(mine[k : k + size])
            other, at = first.setdefault(window, (doc_id, k))
            if (other, at) == (doc_id, k):
                continue
            there, a, b = own[other], k, k + size
            while k - a < 2 and a > 0 and at - (k - a) > 0 and mine[a - 1] == there[at - (k - a) - 1]:
                a -= 1
            end = at + size
            while b - k - size < 2 and b < len(mine) and end + (b - k - size) < len(there) and mine[b] == there[end + (b - k - size)]:
                b += 1
            gone.update(range(numbers[a], numbers[b - 1] + 1))
        if not gone or any(n not in gone for n in numbers):
            left.append((doc_id, "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)))
    return left


def test_pipeline(spark, docs):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r["doc_id"] for r in langid.identify(table, langid.learn(table)).collect() if r["lang_pred"] != "und" and r["score"] >= 0.1}
    now = [(i, t) for i, t, _ in docs if i in kept]
    assert len(now) > 0.95 * len(docs)
    left = _plain_lines(now)
    roots = _roots({i: _bits(t, 3) for i, t in left}, _close)
    single = [(i, t) for i, t in left if roots[i] == i]
    leaked = {i for i, _, _ in _plain_leaks(single, _benchmark())}
    clean = [(i, t) for i, t in single if i not in leaked]
    assert len(clean) < len(single) <= len(left) < len(docs)
    current = table
    for (_, stage), want in zip(corpus_pipeline.STAGES, (now, left, single, clean, None), strict=True):
        before, current = current, stage(spark, current, FOLDER)
        if want is not None:
            assert current.columns == table.columns
            current.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{len(want)}-{_}")
            current = spark.read.parquet(path)
            rows = current.collect()
            assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted(want)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
    _check_packing(current.collect(), clean)
    _check_packing(corpus_pipeline.run(spark, FOLDER).collect(), clean)


def test_stages_on_odd_texts_and_an_empty_table(spark, odd, none):
    for table in (odd[1], none):
        current = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            current = stage(spark, current, FOLDER)
            assert current.columns == table.columns, name
            path = f"{spark.conf.get('spark.checkpoint.dir')}/odd-{name}-{table is none}"
            current.write.parquet(path)
            current = spark.read.schema(current.schema).parquet(path)
        assert (corpus_pipeline.STAGES[-1][1](spark, current, FOLDER).count() > 0) == (table is not none)
