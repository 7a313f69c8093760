"""Bytes of repeated strings across documents.

Every string of ``LENGTH`` bytes has an anchor, the first of its grams of ``GRAM`` bytes with the
smallest hash. Equal strings have equal anchors at equal places, so only stretches around equal
anchors need be compared. Consecutive strings with one anchor form a stretch, of which a document
has about one per 32 bytes.

Stretches that are equal as a whole are counted once: all but the first repeat it. Where stretches
around one anchor differ, the first of each kind are compared in part, by the Burrows-Wheeler
transform of the bytes of many such anchors together. Where those around one anchor are more
than a transform may hold, they are cut by where the anchor is in a string, into blocks of 32
places, then 16 and so on; all strings of a block share some bytes around the anchor, and only
stretches that agree in them stay together. Blocks that are equal as a whole are counted once
again, those that agree with no other are done, and those that are few enough by now go to the
transform. A block of one place holds one string, so at the latest there nothing is left over.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplelake.llm.bwt import later_copies
from samplelake.llm.common import id_and_text, map_batches
from samplelake.operators.joins import join_dim
from samplelake.session import materialise

LENGTH, GRAM = 100, 32
WIDTH = LENGTH - GRAM + 1
#: Bytes that are hashed at once, and bytes of one transform.
CHUNK, BATCH = 1 << 16, 1 << 19
#: Longer texts are taken in parts that overlap by a string less one byte.
PART = 1 << 22
#: The start of a stretch, where its first string has the anchor, and how many strings it has are
#: kept in one number.
SHIFT, BITS = 14, 7
MARK, ASK, ASK_ONE = 0, 1, 2
#: An anchor of more stretches than this, or than so many for each task, is spread over tasks.
COMMON, COMMON_PER_TASK = 1 << 20, 16
#: Anchors that are counted together at least.
MERGED = 1 << 19
KINDS = "kind tinyint, anchor bigint, id bigint, place bigint"


def _slide(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every ``width`` values in a row."""
    size = 1
    while size * 2 <= width:
        values, size = best(values[:-size], values[size:]), size * 2
    rest = width - size
    return best(values[:-rest], values[rest:]) if rest else values


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """32-bit hashes, none of them 0, of every ``GRAM`` (a power of two) bytes in a row."""
    value, factor, size = data.astype(np.uint32) + np.uint32(1), 0x9E3779B1, 1
    while size < GRAM:
        value = value[:-size] * np.uint32(factor) + value[size:]
        factor, size = factor * factor & 0xFFFFFFFF, size * 2
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x85EBCA77)
    value ^= value >> np.uint32(13)
    return np.maximum(value * np.uint32(0xC2B2AE3D), np.uint32(1))


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of ``LENGTH`` bytes or more: per stretch the text it is in, its anchor, the
    start of its first string and of its last, and the hash that has made it the anchor."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    grams = _gram_hashes(data)
    least = _slide(grams, WIDTH, np.minimum)
    # Strings that would reach into the next text.
    for end in ends[:-1].tolist():
        least[end - LENGTH + 1 : end] = 0
    edge = np.zeros(WIDTH - 1, np.uint32)
    most = _slide(np.concatenate((edge, least, edge)), WIDTH, np.maximum)
    anchor = np.flatnonzero(most[: len(grams)] == grams)
    text = np.searchsorted(ends, anchor, "right")
    begin = (ends - sizes)[text]
    low = np.empty(len(anchor), np.int64)
    low[1:] = np.where(grams[anchor[1:]] < grams[anchor[:-1]], anchor[1:] - WIDTH + 1, anchor[:-1] + 1)
    first = np.concatenate(([True], text[1:] != text[:-1]))
    low[first] = begin[first]
    low = np.maximum(low, begin)
    following = np.concatenate((low[1:], [0]))
    following[np.concatenate((first[1:], [True]))] = ends[text[np.concatenate((first[1:], [True]))]] - LENGTH + 1
    # A gram as small as one before it is passed over if a smaller one follows soon enough.
    high = np.minimum.accumulate(following[::-1])[::-1] - 1
    some = high >= low
    return text[some], anchor[some] - begin[some], low[some] - begin[some], high[some] - begin[some], grams[anchor[some]]


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """Where the sorted keys change."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


class _Stretches:
    """Rows ``kind, anchor, content, id, place`` of a batch of texts. Of stretches with equal
    content in the batch one is passed on and the others are marked at once."""

    def __init__(self, common: np.ndarray) -> None:
        self.common = common

    def __call__(self, batch: pa.RecordBatch) -> dict:
        ids, hashes, contents, places, grams = [], [], [], [], []
        texts, own, base = [], [], []

        def flush() -> None:
            if not texts:
                return
            text, anchor, low, high, gram = stretches(texts)
            for t, a, x, y in zip(text.tolist(), anchor.tolist(), low.tolist(), high.tolist(), strict=True):
                data = texts[t]
                hashes.append(xxhash.xxh3_64_intdigest(data[a : a + GRAM]))
                contents.append(xxhash.xxh3_64_intdigest(data[x : y + LENGTH]))
            ids.append(np.array(own, np.int64)[text])
            places.append(low + np.array(base, np.int64)[text] << SHIFT | anchor - low << BITS | (high - low + 1))
            grams.append(gram)
            for some in (texts, own, base):
                some.clear()

        size = 0
        for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            for at in range(0, len(data) - LENGTH + 1, PART):
                texts.append(data[at : at + PART + LENGTH - 1])
                own.append(key)
                base.append(at)
                size += len(texts[-1])
                if size >= CHUNK:
                    flush()
                    size = 0
        flush()
        if not ids:
            return self._rows(*[np.array([], np.int64)] * 5)
        anchor, content = np.array(hashes, np.uint64).view(np.int64), np.array(contents, np.uint64).view(np.int64)
        own_id, place = np.concatenate(ids), np.concatenate(places)
        by = np.lexsort((place, own_id, content, anchor))
        anchor, content, own_id, place, gram = anchor[by], content[by], own_id[by], place[by], np.concatenate(grams)[by]
        new = _first_of_runs(anchor, content)
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        other = (own_id != own_id[lead]) | (place != place[lead])
        kept = new | other
        kind = np.where(new, np.where(np.isin(gram, self.common), ASK_ONE, ASK), MARK)
        return self._rows(*(x[kept] for x in (kind, anchor, content, own_id, place)))

    @staticmethod
    def _rows(kind, anchor, content, own_id, place) -> dict:
        return {"kind": pa.array(kind.astype(np.int8)), "anchor": anchor, "content": content, "id": own_id, "place": place}


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, content, id and place. Of each content the first is kept and the
    others are marked; the kept ones are asked about if their anchor has several contents."""
    none = np.array([], np.int64)
    held = {"kind": none, "anchor": none, "content": none, "id": none, "place": none}
    last: tuple[int, int, int, int] | None = None

    def emit(kind, anchor, own_id, place) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array(kind.astype(np.int8)), "anchor": anchor, "id": own_id, "place": place})

    def asked(rows: dict) -> np.ndarray:
        new = _first_of_runs(rows["anchor"])
        number = np.cumsum(new) - 1
        return (np.bincount(number)[number] > 1) | (rows["kind"] == ASK_ONE) if len(new) else new

    for batch in batches:
        if not batch.num_rows:
            continue
        kind, anchor, content, own_id, place = (
            batch.column(c).to_numpy().astype(np.int64) for c in ("kind", "anchor", "content", "id", "place")
        )
        marked = kind == MARK
        if marked.any():
            yield emit(kind[marked], anchor[marked], own_id[marked], place[marked])
            kind, anchor, content, own_id, place = (x[~marked] for x in (kind, anchor, content, own_id, place))
        if not len(kind):
            continue
        new = _first_of_runs(anchor, content)
        lead_id, lead_place = own_id.copy(), place.copy()
        if last is not None and last[:2] == (anchor[0], content[0]):
            new[0], lead_id[0], lead_place[0] = False, last[2], last[3]
        head = np.flatnonzero(np.concatenate(([True], new[1:])))[np.cumsum(np.concatenate(([True], new[1:]))) - 1]
        lead_id, lead_place = lead_id[head], lead_place[head]
        last = (anchor[-1], content[-1], lead_id[-1], lead_place[-1])
        later = ~new & ((own_id != lead_id) | (place != lead_place))
        if later.any():
            yield emit(np.full(int(later.sum()), MARK), anchor[later], own_id[later], place[later])
        owners = {"kind": kind, "anchor": anchor, "content": content, "id": own_id, "place": place}
        held = {name: np.concatenate((held[name], x[new])) for name, x in owners.items()}
        # The anchor that the batch ends in may go on in the next one.
        done = held["anchor"] != anchor[-1]
        if done.any():
            rows = {name: x[done] for name, x in held.items()}
            ask = asked(rows)
            yield emit(*(rows[name][ask] for name in ("kind", "anchor", "id", "place")))
            held = {name: x[~done] for name, x in held.items()}
    if len(held["anchor"]):
        ask = asked(held)
        yield emit(*(held[name][ask] for name in ("kind", "anchor", "id", "place")))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by group; those of a group are compared in one transform."""
    strings: list[bytes] = []
    ids: list[int] = []
    starts: list[int] = []
    size, anchor = 0, None

    def done() -> pa.RecordBatch:
        own, at = later_copies(strings, np.array(ids, np.int64), np.array(starts, np.int64), LENGTH)
        strings.clear(), ids.clear(), starts.clear()
        return _runs(own, at)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("group", "id", "start", "bytes"))
        for key, own_id, start, data in zip(*columns, strict=True):
            if key != anchor and size >= BATCH:
                yield done()
                size = 0
            anchor = key
            strings.append(data)
            ids.append(own_id)
            starts.append(start)
            size += len(data)
    if strings:
        yield done()


def _runs(own: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Starts as places, those in a row as one as far as a place can count."""
    by = np.lexsort((at, own))
    own, at = own[by], at[by]
    new = _first_of_runs(own, at - np.arange(len(at)))
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(at) else at
    new |= (np.arange(len(at)) - head) % (1 << BITS - 1) == 0
    begin = np.flatnonzero(new)
    count = np.diff(np.concatenate((begin, [len(at)])))
    return pa.RecordBatch.from_pydict({"id": own[begin], "place": at[begin] << SHIFT | count})


_CUT = "group bigint, id bigint, start bigint, lead int, bytes binary"
_CUT_TYPES = {"group": pa.int64(), "id": pa.int64(), "start": pa.int64(), "lead": pa.int32(), "bytes": pa.binary()}


def _columns(rows: list[tuple], types: dict) -> dict:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return {name: pa.array(c, kind) for (name, kind), c in zip(types.items(), columns, strict=True)}


def _cut(batch: pa.RecordBatch) -> dict:
    """The bytes of the stretches that are asked about, and the place of the anchor in them."""
    rows = []
    for key, text, asked in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "asked")), strict=True):
        data = text.encode("utf-8", "surrogatepass")
        for ask in asked:
            start, lead, count = _unpacked(ask["place"])
            rows.append((ask["anchor"], key, start, lead, data[start : start + count - 1 + LENGTH]))
    return _columns(rows, _CUT_TYPES)


def _unpacked(place: int) -> tuple[int, int, int]:
    return place >> SHIFT, place >> BITS & (1 << BITS) - 1, place & (1 << BITS) - 1


def _blocks(batch: pa.RecordBatch, width: int) -> dict:
    """Stretches cut into blocks of ``width`` places of the anchor. The group tells the block and
    the bytes that all strings of such a block have around the anchor, ``whole`` all bytes."""
    rows = []
    for group, key, start, lead, data in zip(*(batch.column(c).to_pylist() for c in _CUT_TYPES), strict=True):
        last = lead - (len(data) - LENGTH)
        for block in range(last // width, lead // width + 1):
            low, high = block * width, min((block + 1) * width, WIDTH) - 1
            first, stop = min(lead, high), max(last, low)
            at = lead - first
            own = data[at : at + first - stop + LENGTH]
            core = data[lead - low : lead + GRAM + WIDTH - 1 - high]
            named = struct.pack("<qBB", group, width, block) + core
            rows.append((
                xxhash.xxh3_64_intdigest(named) - (1 << 63), key, start + at, first, own,
                xxhash.xxh3_64_intdigest(struct.pack("<BB", first, stop) + own) - (1 << 63),
            ))
    return _columns(rows, _CUT_TYPES | {"whole": pa.int64()})


def _keyed(docs: DataFrame) -> DataFrame:
    """``id, doc_id, text``: documents by an id that no two different texts share. That is the
    document's own id (null ids are the smallest) unless ids repeat; then it numbers the ids and
    hashes of the texts in their order."""
    some = id_and_text(docs).withColumn("own", F.coalesce("doc_id", F.lit(-(1 << 62))))
    counted = some.groupBy("own").agg(F.count("*").alias("n"))
    if not counted.filter("n > 1").limit(1).count():
        return some.select(F.col("own").alias("id"), "doc_id", "text")
    hashed = some.withColumn("text_hash", F.xxhash64("text"))
    pairs = hashed.select("own", "text_hash").distinct().orderBy("own", "text_hash")
    keys = materialise(pairs.withColumn("id", F.monotonically_increasing_id()), "documents")
    same = (hashed["own"] == keys["own"]) & hashed["text_hash"].eqNullSafe(keys["text_hash"])
    return hashed.join(keys, same).select(keys["id"], hashed["doc_id"], hashed["text"])


def _strings(start: str, count: Column) -> Column:
    """Some strings in a row, as a place."""
    return F.col(start) * (1 << SHIFT) + count


def _in_groups(cut: DataFrame, most: int) -> Iterator[DataFrame]:
    """``id, place`` of strings that also start earlier in the same group of stored stretches."""
    width = 1 << (WIDTH - 1).bit_length() - 1
    while True:
        sizes = cut.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.octet_length("bytes")).alias("size")).filter("n > 1").drop("n")
        sizes = materialise(sizes, "group-sizes")
        few = join_dim(cut, sizes.filter(F.col("size") <= most).select("group"), "group", "left_semi")
        few = few.repartition("group").sortWithinPartitions("group")
        yield few.select("group", "id", "start", "bytes").mapInArrow(_compare, "id bigint, place bigint")
        large = materialise(sizes.filter(F.col("size") > most).select("group"), "large-groups")
        if not width or not large.limit(1).count():
            return
        many = join_dim(cut, large, "group", "left_semi", stored=True)
        step = width
        blocks = materialise(map_batches(many, lambda batch, step=step: _blocks(batch, step), _CUT + ", whole bigint"), "blocks")
        spot = F.struct("id", "start")
        first = blocks.groupBy("group", "whole").agg(F.min(spot).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        met = materialise(join_dim(blocks, first, ["group", "whole"]), "equal-blocks")
        again = F.coalesce(spot != F.col("first"), F.lit(False))
        yield met.filter(again).select("id", _strings("start", F.octet_length("bytes") - LENGTH + 1).alias("place"))
        cut = met.filter(~again).select(*_CUT_TYPES)
        width //= 2


def _common(docs: DataFrame, most: int, per_task: int) -> np.ndarray:
    """The hashes of anchors of more than ``most`` stretches, or ``per_task`` for each task, whichever is more.

    Each task counts all its anchors and tells those that may matter: if it told none of fewer
    than half its share, the anchors looked for would still be told in half their places.
    """
    tasks = docs.rdd.getNumPartitions()
    bound = max(most, per_task * tasks)
    least = max(1, bound // (2 * max(1, tasks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts = np.array([], np.uint32), np.array([], np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def merge() -> None:
            nonlocal found, counts, size
            own, n = np.unique(np.concatenate([np.array([], np.uint32), *waiting]), return_counts=True)
            found, at = np.unique(np.concatenate((found, own)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, n)), len(found)).astype(np.int64)
            waiting.clear()
            size = 0

        for batch in batches:
            for some in _few(batch.column("text")):
                waiting.append(stretches(some)[4])
                size += len(waiting[-1])
                # As many as there are already, so that all merges cost no more than a few.
                if size > len(found) + MERGED:
                    merge()
        merge()
        often = counts >= least
        yield pa.RecordBatch.from_pydict({"gram": found[often].astype(np.int64), "n": counts[often]})

    told = docs.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return np.array([r["gram"] for r in told.filter(F.col("n") > bound // 2).collect()], np.uint32)


def _few(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts' parts that are long enough, some at a time."""
    some, size = [], 0
    for text in texts:
        data = (text.as_py() or "").encode("utf-8", "surrogatepass")
        for at in range(0, len(data) - LENGTH + 1, PART):
            some.append(data[at : at + PART + LENGTH - 1])
            size += len(some[-1])
            if size >= CHUNK:
                yield some
                some, size = [], 0
    if some:
        yield some


def marks(docs: DataFrame, most: int = BATCH, common: int = COMMON, per_task: int = COMMON_PER_TASK) -> DataFrame:
    """``id, place`` of the strings of ``docs(id, text)`` that also start earlier. Groups of up to
    ``most`` bytes are compared in one transform."""
    schema = "kind tinyint, anchor bigint, content bigint, id bigint, place bigint"
    own = docs.select("id", "text")
    rows = map_batches(own, _Stretches(_common(own, common, per_task)), schema)
    # Marks only pass through; stretches of common anchors are spread by their contents.
    spot = F.when(F.col("kind") == MARK, F.col("id")).when(F.col("kind") == ASK_ONE, F.col("content"))
    dealt = rows.withColumn("spot", F.coalesce(spot, F.lit(0))).repartition("anchor", "spot").drop("spot")
    sorted_rows = dealt.sortWithinPartitions("anchor", "content", "id", "place")
    found = materialise(sorted_rows.mapInArrow(_resolve, KINDS), "stretches")
    asked = found.filter(F.col("kind") != MARK).groupBy("id").agg(F.collect_list(F.struct("anchor", "place")).alias("asked"))
    cut = materialise(map_batches(own.join(asked, "id"), _cut, _CUT), "asked-stretches")
    every = found.filter(F.col("kind") == MARK).select("id", "place")
    for more in _in_groups(cut, most):
        every = every.unionByName(more)
    return every


def _remove(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
    for doc_id, text, found in zip(*(batch.column(c) for c in ("doc_id", "text", "places")), strict=True):
        data = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
        covered = np.zeros(len(data), bool)
        if found.is_valid:
            place = found.values.to_numpy()
            edges = np.zeros(len(data) + 1, np.int32)
            start = place >> SHIFT
            np.add.at(edges, start, 1)
            np.add.at(edges, start + (place & (1 << BITS) - 1) - 1 + LENGTH, -1)
            covered = np.cumsum(edges[:-1]) > 0
        spans = int((covered[1:] & ~covered[:-1]).sum()) + int(covered[:1].sum())
        row = (doc_id.as_py(), len(data), int(covered.sum()), spans, hashlib.sha256(data[~covered].tobytes()).hexdigest())
        for column, value in zip(out.values(), row, strict=True):
            column.append(value)
    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    return {name: pa.array(out[name], kind) for name, kind in types.items()}


SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def without_repeats(docs: DataFrame, most: int = BATCH, **bounds: int) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row: what is left without
    the bytes of strings of ``LENGTH`` bytes that also start earlier, in a document with a
    smaller id or earlier in the same one.

    Texts are taken as UTF-8, null texts as empty; shorter texts stay whole. Rows that repeat id
    and text are one document and get equal rows; rows that share an id only come by a hash of
    their texts. An empty table gives no rows.
    """
    keyed = _keyed(docs)
    places = marks(keyed, most, **bounds).groupBy("id").agg(F.collect_list("place").alias("places"))
    return map_batches(keyed.join(places, "id", "left").select("doc_id", "text", "places"), _remove, SCHEMA)
