"""Lines of many text files, plain, gzip or in archives, numbered, with what could not be read.

Every file is read once. Plain text is split over tasks by Spark; a compressed file or an archive
comes in pieces through one task, which inflates it as a stream and passes lines on in blocks. A
block counts only if its file was read to the end, so a cut file, archive or member gives an error
and no lines, and the others come out whole. Lines are numbered where they are read; what stands
in earlier blocks is added from one row per block, so lines are never shuffled.
"""

from __future__ import annotations

import hashlib
import io
import re
import tarfile
import zlib
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import groupby, islice
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samplelake.operators.joins import join_dim
from samplelake.session import materialise, new_table_path

ERRORS = "file string, stage string, message string"
#: Paths that are listed and read by one job, and how many tasks a core has of a listing.
PATHS, LISTING_TASKS = 20_000, 4
#: Paths that are looked for at a time where some are not there.
LOOKS = 16
#: Bytes of a compressed file that go to a task at once, and the longest such file.
PIECE, LONGEST = 1 << 20, (1 << 31) - 1024
#: Lines and bytes of a block, and the longest line of a compressed file.
BLOCK_LINES, BLOCK_BYTES, LINE_BYTES = 1 << 15, 8 << 20, 64 << 20
#: Rows that a task passes on at once, as far as its files are small, and bytes that opening a file is worth.
PASSED_ROWS, OPEN_BYTES = 10_000, 1 << 18
ARCHIVES = (".tar", ".tar.gz", ".tgz", ".tar.bz2")
#: Between an archive's path and the path of a file in it.
INSIDE = "!/"
#: The file system that a path names, paths of which it takes a look to say if they are there, and what is said of one that is not.
_SYSTEM, _UNSURE, _GONE = re.compile("([^/:]+:(//[^/]*)?)?"), re.compile(r"[{}\[\]*?\\$\n\r]|(^|/)[._][^/]*/*$|^$"), "Input path does not exist: "

_TYPES = {
    "file": pa.string(), "block": pa.int64(), "n": pa.int64(), "full": pa.int64(), "value": pa.string(), "mark": pa.string(),
    "size": pa.int64(), "digest": pa.string(), "problem": pa.string(),
}
_RAW = "file string, block bigint, n bigint, full bigint, value string, mark string, size bigint, digest string, problem string"
#: Marks of a block that is whole and of a file that has come to its end.
BLOCK, FILE = "block", "file"


@dataclass(frozen=True)
class Files:
    """``lines(file, block, n, full, value)``: ``n`` numbers the lines of a file from 0, ``full``
    those that are not blank (for a blank one, the next of them). ``files(file, size, digest,
    n_lines, n_full)``: all that were read, empty ones included; size and digest of the content
    are known for compressed files and members. ``errors(file, stage, message)``.

    ``parts(file, block, n, full, value)`` are the lines as they are stored, with numbers inside
    their block, and ``before(file, block, n_before, full_before)`` what stands before each block.
    A task reads ``parts`` in the order of the file; ``lines`` may come in any order."""

    lines: DataFrame
    files: DataFrame
    errors: DataFrame
    parts: DataFrame
    before: DataFrame


def plain_path(path: Column) -> Column:
    """One form of a path: a local one has one slash after its scheme."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def is_archive(path: Column) -> Column:
    named = F.lit(False)
    for end in ARCHIVES:
        named = named | F.lower(path).endswith(end)
    return named


_LISTING, _OPENING = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes"


@contextmanager
def _at_most(spark: SparkSession, key: str, most: int) -> Iterator[None]:
    """A setting that is no higher than ``most`` for a while."""
    before = spark.conf.get(key)
    # Bytes may be told with a unit; a number in another one than bytes is the user's own choice.
    if (number := before.removesuffix("b")).isdigit():
        spark.conf.set(key, str(min(int(number), most)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _few_tasks(spark: SparkSession):
    """Listings by a few tasks a core; Spark's own number is a task for each path."""
    return _at_most(spark, _LISTING, LISTING_TASKS * spark.sparkContext.defaultParallelism)


def _loaded(spark: SparkSession, paths: list[str], form: str) -> DataFrame:
    with _few_tasks(spark):
        return spark.read.format(form).option("recursiveFileLookup", "true").load(paths)


def is_packed(file: str) -> bool:
    return file.lower().endswith((".gz", *ARCHIVES))


def _listed(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[tuple[str, str, str]]]:
    """The files behind some paths, and the paths that cannot be listed: those that are not there are told
    at once, others are found by halves."""
    try:
        found = _loaded(spark, paths, "binaryFile").inputFiles()
        return [unquote(f) for f in found], []
    except (AnalysisException, Py4JJavaError) as error:
        told = error.java_exception.toString() if isinstance(error, Py4JJavaError) else str(error)
        told, named = told.splitlines()[0], None
        if isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND":
            named = error.getMessageParameters()["path"]
    if len(paths) == 1:
        return [], [(paths[0], "list", told)]
    systems: dict[str, list[str]] = {}
    for path in paths:
        systems.setdefault(_SYSTEM.match(path)[0], []).append(path)
    if len(systems) > 1:
        parts = [_listed(spark, some) for some in systems.values()]
    elif named and (missing := _missing(spark, paths)):
        # Spark names one path that is not there; of the others it would say the same.
        parts = [([], [(path, "list", told.replace(named, full)) for path, full in missing.items()])]
        if rest := [path for path in paths if path not in missing]:
            parts.append(_listed(spark, rest))
    else:
        half = len(paths) // 2
        parts = [_listed(spark, some) for some in (paths[:half], paths[half:])]
    # A file may be named in several ways, and is read once.
    return list(dict.fromkeys(f for found, _ in parts for f in found)), [b for _, bad in parts for b in bad]


def _missing(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Of paths in one file system those that are not there, with their full names, by one listing: Hadoop
    tells all of them together where Spark stops at the first. What it does not surely tell is left out:
    patterns, hidden files, which it passes over, and what it would read as a variable."""
    plain = list(dict.fromkeys(p for p in paths if not _UNSURE.search(p)))
    if not plain:
        return {}
    mapreduce, text = spark._jvm.org.apache.hadoop.mapreduce, spark._jvm.org.apache.hadoop.util.StringUtils
    inputs, told = mapreduce.lib.input.FileInputFormat, ""
    try:
        job = mapreduce.Job.getInstance(spark._jsparkSession.sessionState().newHadoopConf())
        job.getConfiguration().unset(inputs.PATHFILTER_CLASS)
        job.getConfiguration().setInt(inputs.LIST_STATUS_NUM_THREADS, LOOKS)
        # A call for each path would be a wait for each; so they go over as one text.
        inputs.setInputPaths(job, text.stringToPath(text.getStrings("\n".join(plain), "\n")))
        full = [name.replace("\\,", ",") for name in re.split(r"(?<!\\),", job.getConfiguration().get(inputs.INPUT_DIR))]
        try:
            mapreduce.lib.input.TextInputFormat().getSplits(job)
        except Py4JJavaError as error:
            told = error.java_exception.getMessage() or ""
    except Py4JJavaError:
        # Some path has another fault.
        return {}
    gone = {line.removeprefix(_GONE) for line in told.split("\n") if line.startswith(_GONE)}
    return {path: name for path, name in zip(plain, full, strict=True) if name in gone}


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file`` for files, folders and globs, those of length 0 included, which Spark's readers
    pass over; contents are not read. Spark has the listing on the driver as for any read."""
    found = [(f,) for f in listed_paths(spark, paths)]
    return spark.createDataFrame(found, "file string").select(plain_path(F.col("file")).alias("file"))


def listed_paths(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    found, bad = _listed(spark, [paths] if isinstance(paths, str) else list(paths))
    if bad:
        raise FileNotFoundError(f"{bad[0][0]}: {bad[0][2]}")
    return found


def batches(paths: DataFrame | str | Sequence[str], size: int) -> Iterator[list[str]]:
    if isinstance(paths, DataFrame):
        named = paths.select(F.trim(F.col(paths.columns[0])).alias("path")).filter("path <> ''").distinct()
        rows: Iterable[str] = (r["path"] for r in named.toLocalIterator())
    else:
        rows = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    rows = iter(rows)
    while batch := list(islice(rows, size)):
        yield batch


class _Pieces(io.RawIOBase):
    """The pieces of a file as a stream."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.rest = pieces, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.rest:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.rest = piece
        n = min(len(buffer), len(self.rest))
        buffer[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _read(stream) -> Iterator[bytes]:
    while piece := stream.read(PIECE):
        yield piece


def inflated(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces of bounded size. An error if it
    ends early; nothing at all is an empty file. What comes after a member and is none is passed
    over, as is usual."""
    stream, empty = zlib.decompressobj(31), True
    for piece in pieces:
        while piece:
            if stream.eof:
                if not piece.startswith(b"\x1f"):
                    return
                stream = zlib.decompressobj(31)
            empty = False
            data = stream.decompress(piece, BLOCK_BYTES)
            piece = stream.unconsumed_tail or stream.unused_data
            if data:
                yield data
    if not empty and not stream.eof:
        raise EOFError("the compressed file ends early")


def _lines(pieces: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Lines, some at a time, cut as Spark's reader cuts them."""
    rest: list[bytes] = []
    held = 0
    for piece in pieces:
        if b"\n" not in piece and b"\r" not in piece:
            rest.append(piece)
            held += len(piece)
            if held > LINE_BYTES:
                raise ValueError(f"a line of more than {LINE_BYTES} bytes")
            continue
        whole = b"".join([*rest, piece])
        found = whole.splitlines()
        # A line may go on in the next piece, and so may its end.
        last = found.pop() + b"\r" * whole.endswith(b"\r") if whole[-1:] != b"\n" else b""
        rest, held = [last] if last else [], len(last)
        yield found
    if rest:
        yield b"".join(rest).splitlines()


def _records(rows: dict) -> pa.RecordBatch:
    n = max(len(v) for v in rows.values())
    return pa.RecordBatch.from_pydict({name: pa.array(rows[name], kind) if name in rows else pa.nulls(n, kind) for name, kind in _TYPES.items()})


def _one(file: str, pieces: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    """The lines of one file, its blocks, and a mark at its end."""
    digest, size, n, full, block = hashlib.sha256(), 0, 0, 0, 0
    waiting: list[bytes] = []
    held = 0

    def counted() -> Iterator[bytes]:
        nonlocal size
        for piece in pieces:
            digest.update(piece)
            size += len(piece)
            yield piece

    def passed(values: list[bytes]) -> pa.RecordBatch:
        nonlocal n, full, block
        texts = [v.decode("utf-8", "replace") for v in values]
        own = np.array([bool(t.strip(" ")) for t in texts], np.int64)
        before = full + np.cumsum(own) - own
        batch = _records({
            "file": [file] * len(texts), "block": [block] * len(texts), "n": list(range(n, n + len(texts))),
            "full": before, "value": texts,
        })
        n, full, block = n + len(texts), full + int(own.sum()), block + 1
        return batch

    for found in _lines(counted()):
        waiting += found
        held += sum(map(len, found))
        if held >= BLOCK_BYTES or len(waiting) >= BLOCK_LINES:
            for at in range(0, len(waiting), BLOCK_LINES):
                yield passed(waiting[at : at + BLOCK_LINES])
            waiting, held = [], 0
    if waiting:
        yield passed(waiting)
    # Numbers are those of the whole file already, so blocks add none.
    if block:
        yield _records({"file": [file] * block, "block": list(range(block)), "n": [0] * block, "full": [0] * block, "mark": [BLOCK] * block})
    yield _records({"file": [file], "n": [n], "full": [full], "mark": [FILE], "size": [size], "digest": [digest.hexdigest()]})


_FAULTS = (OSError, EOFError, ValueError, tarfile.TarError, zlib.error)


def _problem(file: str, error: Exception) -> pa.RecordBatch:
    return _records({"file": [file], "mark": [FILE], "problem": [f"{type(error).__name__}: {error}"]})


def _guarded(file: str, pieces: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    try:
        yield from _one(file, pieces)
    except _FAULTS as error:
        yield _problem(file, error)


def _members(file: str, stream: io.RawIOBase) -> Iterator[pa.RecordBatch]:
    """The files of an archive. What is wrong with a member's compression ends that member only."""
    with tarfile.open(fileobj=io.BufferedReader(stream), mode="r|*") as tar:
        for info in tar:
            if not info.isfile():
                continue
            pieces = _read(tar.extractfile(info))
            name = f"{file}{INSIDE}{info.name.removeprefix('./')}"
            if not info.name.lower().endswith(".gz"):
                yield from _one(name, pieces)
                continue
            try:
                yield from _one(name, inflated(pieces))
            except zlib.error as error:
                yield _problem(name, error)
            except EOFError as error:
                yield _problem(name, error)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines and marks from ``file, at, piece`` rows, the pieces of a file in a row."""

    def rows() -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for file, piece in zip(batch.column("file"), batch.column("piece"), strict=True):
                yield file.as_py(), piece.as_py()

    for file, group in groupby(rows(), key=lambda r: r[0]):
        pieces = (piece for _, piece in group)
        if not file.lower().endswith(ARCHIVES):
            yield from _guarded(file, inflated(pieces))
            continue
        try:
            yield from _members(file, _Pieces(pieces))
            yield _records({"file": [file], "mark": [FILE]})
        except _FAULTS as error:
            yield _problem(file, error)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some size, since each batch has a price of its own."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PASSED_ROWS or size >= BLOCK_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _packed(spark: SparkSession, files: list[str]) -> DataFrame:
    """The lines of compressed files and archives. Spark's reader gives a whole compressed file, which
    is cut into pieces before it leaves the JVM; longer files than it can hold are errors."""
    found = _loaded(spark, files, "binaryFile")
    file = plain_path(F.col("path")).alias("file")
    short = found.filter(F.col("length") <= LONGEST)
    last = F.ceil(F.col("length") / PIECE).cast("int") - 1
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr("content", i * PIECE + 1, F.lit(PIECE)))
    cut = short.select(file, F.posexplode(pieces).alias("at", "piece"))
    long = found.filter(F.col("length") > LONGEST).select(
        file, F.lit(FILE).alias("mark"), F.lit(f"longer than {LONGEST} bytes").alias("problem")
    )
    return cut.mapInArrow(lambda rows: _together(_unpacked(rows)), _RAW).unionByName(long, allowMissingColumns=True)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the lines of each block, and marks its end with what is in it. A batch may hold the lines of many
    small files, so it is looked at as a whole."""
    current, n, full = None, 0, 0
    for batch in batches:
        file, block, value = (batch.column(c) for c in ("file", "block", "value"))
        rows = len(value)
        if not rows:
            continue
        change = np.ones(rows, bool)
        change[1:] = pc.or_(pc.not_equal(file.slice(1), file.slice(0, rows - 1)), pc.not_equal(block.slice(1), block.slice(0, rows - 1)))
        change[0] = (file[0].as_py(), block[0].as_py()) != current
        own = pc.not_equal(pc.utf8_trim(value, " "), "").to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.flatnonzero(change)
        # Rows before the first start go on with the block of the batch before.
        first = np.concatenate(([0], starts))[np.cumsum(change)]
        goes_on = np.cumsum(change) == 0
        before = np.cumsum(own) - own
        numbers = np.arange(rows) - first + np.where(goes_on, n, 0)
        fulls = before - before[first] + np.where(goes_on, full, 0)
        if change[0] and current is not None:
            yield _block_ends([current[0]], [current[1]], [n], [full])
        yield pa.RecordBatch.from_pydict({
            "file": file, "block": block, "n": numbers, "full": fulls, "value": value,
            **{c: pa.nulls(rows, _TYPES[c]) for c in ("mark", "size", "digest", "problem")},
        })
        ends = starts[starts > 0] - 1
        if len(ends):
            yield _block_ends(file.take(ends), block.take(ends), numbers[ends] + 1, fulls[ends] + own[ends])
        current, n, full = (file[rows - 1].as_py(), block[rows - 1].as_py()), int(numbers[-1]) + 1, int(fulls[-1] + own[-1])
    if current is not None:
        yield _block_ends([current[0]], [current[1]], [n], [full])


def _block_ends(file, block, n, full) -> pa.RecordBatch:
    return _records({"file": file, "block": block, "n": n, "full": full, "mark": [BLOCK] * len(n)})


def _plain(spark: SparkSession, files: list[str]) -> DataFrame:
    # Here a blank or a percent sign in a path is encoded, in a listing it is not.
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    lines = _loaded(spark, files, "text").select(
        plain_path(F.url_decode(encoded)).alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    return lines.mapInArrow(_numbered, _RAW)


def read_files(
    spark: SparkSession, paths: DataFrame | str | Sequence[str], *, keep: Column | None = None, batch: int = PATHS
) -> Files:
    """The lines of the files behind ``paths``: files, folders and globs, as a list or as the first
    column of a frame, of which the driver holds ``batch`` at a time.

    Files that end in ``.gz`` are inflated; the files in tar archives (``ARCHIVES``) are files of
    their own, named after the archive (``INSIDE``), and inflated if they end in ``.gz``. ``keep``
    is a condition on ``value``: other lines are numbered but not passed on. A path that is not
    there, and a file, archive or member that cannot be read to its end, gives no line and a row in
    ``errors``. The lines are stored once.
    """
    target, unlisted, empty = (new_table_path(spark, name) for name in ("lines", "unlisted", "listed"))
    spark.createDataFrame([], _RAW).write.parquet(target)
    spark.createDataFrame([], ERRORS).write.parquet(unlisted)
    spark.createDataFrame([], "file string").write.parquet(empty)
    kept = F.col("mark").isNotNull() | (F.lit(True) if keep is None else keep)
    for some in batches(paths, batch):
        found, bad = _listed(spark, some)
        if bad:
            spark.createDataFrame(bad, ERRORS).write.mode("append").parquet(unlisted)
        names = [(f,) for f in found]
        if not names:
            continue
        spark.createDataFrame(names, "file string").select(plain_path(F.col("file")).alias("file")).write.mode("append").parquet(empty)
        packed = [f for f in found if is_packed(f)]
        plain = sorted(set(found) - set(packed))
        for reader, own in ((_packed, packed), (_plain, plain)):
            if own:
                # Many small files to a task: each task starts Python and writes a file.
                with _at_most(spark, _OPENING, OPEN_BYTES):
                    reader(spark, [escaped(f) for f in own]).filter(kept).write.mode("append").parquet(target)
    return _files(spark.read.schema(_RAW).parquet(target), spark.read.schema("file string").parquet(empty), spark.read.schema(ERRORS).parquet(unlisted))


def escaped(path: str) -> str:
    """A path as a reader takes it, without what it would read as a pattern."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in path)


def _files(raw: DataFrame, listed: DataFrame, unlisted: DataFrame) -> Files:
    blocks = raw.filter(F.col("mark") == BLOCK)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per block.
    before = blocks.select(
        "file", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "full")]
    )
    before = materialise(before, "blocks")
    own = raw.filter(F.col("mark").isNull()).select("file", "block", "n", "full", "value")
    # Small files are one block each, before which nothing stands, and only a compressed file or a member can
    # lack its end. So lines meet two short tables instead of a row for each file.
    inside = F.lower("file").endswith(".gz") | is_archive(F.col("file")) | F.col("file").contains(INSIDE)
    lost = own.filter(inside).select("file", "block").distinct().join(before, ["file", "block"], "left_anti")
    later = before.filter("n_before > 0 OR full_before > 0")
    whole = join_dim(own, lost, ["file", "block"], "left_anti")
    lines = join_dim(whole, later, ["file", "block"]).select(
        "file", "block", *[(F.col(c) + F.coalesce(f"{c}_before", F.lit(0))).alias(c) for c in ("n", "full")], "value"
    )
    ends = raw.filter(F.col("mark") == FILE)
    sums = blocks.groupBy("file").agg(F.sum("n").alias("n_lines"), F.sum("full").alias("n_full"))
    whole = ends.filter("problem IS NULL AND n IS NOT NULL").select("file", "size", "digest", F.col("n").alias("n_lines"), F.col("full").alias("n_full"))
    plain = listed.distinct().join(ends.select("file"), "file", "left_anti").join(sums, "file", "left").select(
        "file", F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("string").alias("digest"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_full", F.lit(0)).alias("n_full"),
    )
    errors = ends.filter("problem IS NOT NULL").select("file", F.lit("read").alias("stage"), F.col("problem").alias("message"))
    return Files(lines, whole.unionByName(plain), unlisted.unionByName(errors), own, before)
