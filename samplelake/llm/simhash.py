"""Near copies by fingerprints that differ in at most two bits.

The 64 bits are cut into four pieces. Two fingerprints that differ in two bits at most agree in
two pieces at least, so each fingerprint is filed under its six pairs of pieces, and only
fingerprints filed together are compared. Where a pair of pieces is shared by many, as among
thousands of near copies, comparing all would grow with the square. Their fingerprints are filed
instead under themselves and the 64 fingerprints one bit away: two of them that differ in two
bits at most meet there, and all that meet are within two bits of each other, so each is tied to
the least one only. No link between components is lost either way.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplelake.llm.common import id_and_text, map_batches, packed, unpacked
from samplelake.llm.components import components
from samplelake.operators.joins import join_dim
from samplelake.session import materialise

DISTANCE, PIECES, SEED = 2, 4, 42
#: Above this many fingerprints under one pair of pieces, the other way is the cheaper one.
CROWD = 64
_CHUNK = 1 << 15
LAST = (1 << 63) - 1


def fingerprint(text: str | None, words: int) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's shingles of ``words``
    words, counted as often as they occur; 0 for a null text or one without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    ends = ends[words - 1 :] if len(found) >= words else ends[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        some = zip(starts[at : min(at + _CHUNK, n)].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in some], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view("<i8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, text_hash, bits`` of every row, the bits as a signed integer."""

    def work(batch: pa.RecordBatch) -> dict:
        bits = [fingerprint(text, words) for text in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "bits": pa.array(bits, pa.int64())}

    own = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    return map_batches(own, work, "doc_id bigint, text_hash bigint, bits bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _block_masks() -> list[int]:
    size = 64 // PIECES
    piece = [((1 << size) - 1) << (size * i) for i in range(PIECES)]
    return [_signed(sum(piece[i] for i in some)) for some in combinations(range(PIECES), PIECES - DISTANCE)]


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (the column ``bits`` of a stored table) at
    most two bits apart: all of them among few, and enough to reach all of them in a crowd."""
    bits = F.col("bits")
    keys = F.array(*[
        F.struct(F.lit(i).alias("block"), bits.bitwiseAND(F.lit(mask)).alias("key")) for i, mask in enumerate(_block_masks())
    ])
    filed = nodes.select("bits", F.explode(keys).alias("k")).select("bits", "k.*")
    sizes = filed.groupBy("block", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialise(filed.join(sizes, ["block", "key"]), "blocks")
    few = shared.filter(F.col("n") <= crowd)
    left, right = few.select("block", "key", F.col("bits").alias("a")), few.select("block", "key", F.col("bits").alias("b"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    close = left.join(right, ["block", "key"]).filter((F.col("a") < F.col("b")) & (apart <= DISTANCE)).select("a", "b")
    crowded = shared.filter(F.col("n") > crowd).select("bits").distinct()
    flips = F.array(bits, *[bits.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    # At most 65 fingerprints meet at a centre.
    centres = crowded.select("bits", F.explode(flips).alias("centre"))
    least = centres.groupBy("centre").agg(F.collect_list("bits").alias("all")).filter(F.size("all") > 1)
    tied = least.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a < b")
    return close.unionByName(tied).distinct()


def _components(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and for each distinct one the first document, by id and
    then a hash of its text, that can be reached from it; null ids come last."""
    stored = materialise(fingerprints(docs, words), "fingerprints")
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "text_hash")
    nodes = materialise(stored.groupBy("bits").agg(F.min(place).alias("first")), "distinct-fingerprints")
    roots = materialise(components(links(nodes)), "roots").withColumnRenamed("node", "bits")
    linked = roots.join(nodes, "bits")
    first = linked.groupBy("root").agg(F.min("first").alias("least"))
    moved = linked.join(first, "root").select("bits", "least")
    every = nodes.join(moved, "bits", "left").select("bits", F.coalesce("least", "first").alias("first"))
    return stored, every


def near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Rows whose fingerprints are linked, directly or through others, share ``component_id``, the
    smallest document id among them (null if they have none). Null and empty texts have
    fingerprint 0 and are linked like any others. Repeated rows stay; an empty table gives no
    rows. Copies have one fingerprint, so only distinct fingerprints are compared.
    """
    stored, every = _components(docs, words)
    return join_dim(stored, every, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        F.nullif(F.col("first.id"), F.lit(LAST)).alias("component_id"),
    )


def without_near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their component, by id
    and then a hash of the text; of rows that repeat id and text any one. Null ids come last."""
    stored, every = _components(docs, words)
    first = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "text_hash")
    kept = join_dim(stored, every, "bits").filter(F.col("first") == first).select("first.id", "first.text_hash").distinct()
    keyed = packed(docs).withColumns({"id": F.coalesce("doc_id", F.lit(LAST)), "text_hash": F.xxhash64("text")})
    return unpacked(keyed.join(kept, ["id", "text_hash"], "left_semi").dropDuplicates(["id", "text_hash"]), docs)
