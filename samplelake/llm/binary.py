"""Token ids in files of length-delimited records, with an index of offsets.

A record is: payload size (u32), masked checksum of that size (u32), payload, masked checksum of
the payload (u32), end mark (one line feed). The payload is: whether there is a document id
(u8), the id (i64), the byte width of a token (u8), and the tokens. Everything is little-endian.
Checksums are CRC-32, rotated and moved by a constant, so that records that hold checksums have
sound ones themselves. Files are numbered in the order of document ids. Spark's text writer
writes the records as they are, so files appear only when their task has succeeded. The task
that writes a file also writes the part of the index that tells its offsets, next to it.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samplelake.llm.common import SLICE_ROWS, id_and_text, map_batches
from samplelake.llm.tokens import Encoder, default_path
from samplelake.sources.files import plain_path

_HEAD, _SUM, _META = struct.Struct("<II"), struct.Struct("<I"), struct.Struct("<?qB")
END_MARK = b"\n"
FILE_BYTES = 16 << 20
RECORDS, INDEX_LINES = "records", "index"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without its end mark, which the writer adds."""
    size = struct.pack("<I", len(payload))
    return size + _SUM.pack(masked(size)) + payload + _SUM.pack(masked(payload))


def payload_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return _META.pack(doc_id is not None, doc_id or 0, width) + ids


def read_frame(content: bytes, offset: int) -> tuple[memoryview, int]:
    """The payload of the record at ``offset`` and where the next one starts."""
    if offset + _HEAD.size > len(content):
        raise ValueError(f"the record at {offset} is cut")
    size, check = _HEAD.unpack_from(content, offset)
    if check != masked(content[offset : offset + 4]):
        raise ValueError(f"the record at {offset} has a wrong size checksum")
    start = offset + _HEAD.size
    end = start + size
    if end + _SUM.size + 1 > len(content) or content[end + _SUM.size : end + _SUM.size + 1] != END_MARK:
        raise ValueError(f"the record at {offset} is cut")
    payload = memoryview(content)[start:end]
    if _SUM.unpack_from(content, end)[0] != masked(payload):
        raise ValueError(f"the record at {offset} has a wrong checksum")
    return payload, end + _SUM.size + 1


def read_payload(payload: memoryview) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = _META.unpack_from(payload, 0)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=_META.size)


def write_ids(docs: DataFrame, folder: str, *, path: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of every whole text to files in ``folder``, by ascending document id, and
    the index (``read_index``) beside them.

    A null or empty text is the end id alone. Null ids come first; rows that share an id are
    ordered by their text. An empty table gives no records.
    """
    path = path or default_path()
    some = id_and_text(docs)
    spark = docs.sparkSession
    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(2 * spark.sparkContext.defaultParallelism, size // file_bytes)
    ordered = some.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        width, offset = encoder.type.itemsize, 0
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                lines, told = [], []
                encoded = encoder.encode_many(batch.column("text").to_pylist())
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                    lines.append(frame(payload_of(doc_id, ids, width)))
                    size = len(lines[-1]) + len(END_MARK)
                    told.append(json.dumps({"offset": offset, "size": size, "doc_id": doc_id, "n_tokens": len(ids) // width}).encode())
                    offset += size
                kinds = [RECORDS] * len(lines) + [INDEX_LINES] * len(told)
                yield pa.RecordBatch.from_pydict({"kind": kinds, "line": pa.array(lines + told, pa.binary())})

    records = ordered.mapInArrow(run, "kind string, line binary").select("kind", F.col("line").cast("string").alias("line"))
    _write_beside(records, folder)


def _write_beside(rows: DataFrame, folder: str) -> None:
    """Each kind of row to a folder of its own, in the order of the task; a sort by kind, which the
    writer does without this setting, would not keep that order."""
    spark, name = rows.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, 2)
    try:
        rows.write.option("lineSep", END_MARK.decode()).partitionBy("kind").text(folder)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    # Without any record there is no folder of a kind.
    some = found.filter(F.col("kind") == RECORDS) if "kind" in found.columns else found
    return some.select(plain_path(F.col("path")).alias("file"), "content")


def _file_number(file: Column) -> Column:
    return F.regexp_extract(file, r"part-(\d+)", 1).cast("int")


_LINES = "offset bigint, size bigint, doc_id bigint, n_tokens bigint"
INDEX = "file string, file_number int, offset bigint, size bigint, doc_id bigint, n_tokens bigint"


def _record(content: bytes, offset: int) -> tuple:
    payload, after = read_frame(content, offset)
    doc_id, ids = read_payload(payload)
    return offset, after - offset, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes())


def _columns(rows: list[tuple], names: tuple[str, ...]) -> dict:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return {name: pa.array(c, pa.string() if name == "file" else pa.int32() if name == "file_number" else pa.int64())
            for name, c in zip(names, columns, strict=True)}


def _scan(contents: DataFrame) -> DataFrame:
    """Every record of the files in turn, checked."""
    names = ("file", "file_number", "offset", "size", "doc_id", "n_tokens", "ids_crc32")

    def records(content: bytes) -> Iterator[tuple]:
        offset = 0
        while offset < len(content):
            row = _record(content, offset)
            yield row
            offset += row[1]

    def work(batch: pa.RecordBatch) -> dict:
        rows = []
        for file, number, content in zip(*(batch.column(c) for c in ("file", "file_number", "content")), strict=True):
            rows += [(file.as_py(), number.as_py(), *row) for row in records(content.as_py())]
        return _columns(rows, names)

    numbered = contents.withColumn("file_number", _file_number(F.col("file")))
    return map_batches(numbered, work, f"{INDEX}, ids_crc32 bigint")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """``file, file_number, offset, size, doc_id, n_tokens`` of every record."""
    lines = spark.read.schema(f"{_LINES}, kind string").json(folder).filter(F.col("kind") == INDEX_LINES).select(
        # A file of records and the part of the index that tells of it have the same name.
        F.replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), F.lit(f"/kind={INDEX_LINES}/"), F.lit(f"/kind={RECORDS}/")).alias("path"),
        "offset", "size", "doc_id", "n_tokens",
    )
    return lines.select(plain_path(F.col("path")).alias("file"), _file_number(F.col("path")).alias("file_number"), *lines.columns[1:])


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records in turn, with ``start``, the number of ids in the records before, and
    ``ids_crc32``, over the ids as 32-bit integers."""
    rows = _scan(_contents(spark, folder))
    totals = read_index(spark, folder).groupBy("file_number").agg(F.sum("n_tokens").alias("n"))
    # One row per file.
    earlier = Window.orderBy("file_number").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file_number", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file_number").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return own.join(starts, "file_number").select(
        "file", "offset", "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_shuffled(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """``file, offset, doc_id, ids`` of the records whose ``file, offset`` are in ``wanted``, a
    part of the index in any order. Only the files that hold some of them are read."""
    files = [r["file"] for r in wanted.select("file").distinct().limit(10_001).collect()]
    content = _contents(spark, folder)
    if len(files) <= 10_000:
        content = content.filter(F.col("file").isin(files))
    offsets = wanted.groupBy("file").agg(F.sort_array(F.collect_set("offset")).alias("offsets"))

    def work(batch: pa.RecordBatch) -> dict:
        found: dict[str, list] = {"file": [], "offset": [], "doc_id": [], "ids": []}
        for file, content, at in zip(*(batch.column(c) for c in ("file", "content", "offsets")), strict=True):
            whole = content.as_py()
            for offset in at.as_py():
                doc_id, ids = read_payload(read_frame(whole, offset)[0])
                for name, value in zip(found, (file.as_py(), offset, doc_id, ids.astype(np.int32)), strict=True):
                    found[name].append(value)
        return {
            "file": pa.array(found["file"], pa.string()), "offset": pa.array(found["offset"], pa.int64()),
            "doc_id": pa.array(found["doc_id"], pa.int64()), "ids": pa.array(found["ids"], pa.list_(pa.int32())),
        }

    return map_batches(content.join(offsets, "file"), work, "file string, offset bigint, doc_id bigint, ids array<int>")
