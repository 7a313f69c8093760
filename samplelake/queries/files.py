"""Compressed files, archives and path lists written from the tables, some of them faulty, and read
back."""

from __future__ import annotations

import gzip
import io
import os
import tarfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from samplelake.plans.count_matrix import load_matrices
from samplelake.queries.matrices import DENSE_SQL, MTX_SQL, file_tasks, supplier_lines, write_lines, written_parts
from samplelake.queries.registry import ATTR_SQL, document_attr, query, table
from samplelake.session import materialise, new_table_path
from samplelake.sources.files import listed_paths
from samplelake.sources.matrices import label_matrix, read_dense_matrix
from samplelake.sources.soft import read_path_list, read_soft
from samplelake.sources.supplementary import base_name


#: Files that are renamed at a time.
RENAMES = 16


@F.pandas_udf(BinaryType())
def _zipped(content: pd.Series) -> pd.Series:
    return content.map(lambda text: None if text is None else gzip.compress(text.encode(), mtime=0))


@F.pandas_udf(BinaryType())
def _tarred(names: pd.Series, contents: pd.Series) -> pd.Series:
    """A tar archive of each row's members."""

    def tar(names, contents) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as archive:
            for name, content in zip(names, contents, strict=True):
                info = tarfile.TarInfo(name)
                info.size = len(content)
                archive.addfile(info, io.BytesIO(content))
        return out.getvalue()

    return pd.Series([tar(n, c) for n, c in zip(names, contents, strict=True)])


def _first_half(content: Column) -> Column:
    return F.substr(content, F.lit(1), (F.octet_length(content) / 2).cast("int"))


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """A folder as Python names it, if it is in a file system that all machines have mounted."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(folder).toUri().getPath() if system.getUri().getScheme() == "file" else None


def _written_in(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(batch.column(c).to_pylist() for c in ("name", "content")), strict=True):
                # Another attempt at the task may write the same file.
                part = f"{folder}/.{uuid.uuid4().hex}"
                with open(part, "wb") as out:
                    out.write(content + b"\n")
                os.replace(part, f"{folder}/{name}")
            yield batch.select(["name"])

    return write


def _write_named(files: DataFrame, label: str) -> str:
    """Files of given names from ``files(name, content)``, in one folder, a line feed after each content.
    In a mounted folder the tasks write them in place. Elsewhere Spark's text writer writes the bytes, and
    chooses names of its own, which are changed then."""
    spark = files.sparkSession
    path = new_table_path(spark, label)
    spread = files.select("name", "content").repartition(file_tasks(spark), "name")
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if local := _local_folder(spark, path):
        system.mkdirs(folder)
        spread.mapInArrow(_written_in(local), "name string").write.format("noop").mode("overwrite").save()
        return path
    spread.select("name", F.col("content").cast("string")).write.partitionBy("name").text(path)

    def rename(part: str) -> None:
        system.rename(hadoop.Path(part), hadoop.Path(folder, part.rsplit("/", 2)[1].removeprefix("name=")))

    # Spark lists the folders in tasks; a rename is a wait for the file system, so many wait at a time.
    with ThreadPoolExecutor(RENAMES) as pool:
        for _ in pool.map(rename, listed_paths(spark, path)):
            pass
    return path


RUN = 25


def _family_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``run, text``: per run of ``RUN`` document ids a SOFT text of samples."""
    number = F.regexp_replace("accession", "^D", "").cast("bigint")
    lines = document_attr(spark, folder).filter("kind = 'SAMPLE'").select(
        number.alias("id"), "key_ord", "pos", F.concat(F.lit("!Sample_"), F.col("key"), F.lit(" = "), F.col("value")).alias("line")
    )
    heads = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("key_ord"), F.lit(0).cast("bigint").alias("pos"),
        F.concat(F.lit("^SAMPLE = D"), F.col("doc_id").cast("string")).alias("line"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("id", "key_ord", "pos", "line")))
    joined = F.array_join(F.transform(ordered, lambda r: r["line"]), "\n")
    # A run is a few documents.
    runs = lines.unionByName(heads).groupBy(F.floor(F.col("id") / RUN).alias("run")).agg(joined.alias("text"))
    return runs.select("run", F.concat("text", F.lit("\n")).alias("text"))


@query(
    f"""
    WITH {ATTR_SQL}
    SELECT 'attr' AS kind, accession AS name, key, pos, value FROM attr
    WHERE kind = 'SAMPLE' AND substr(accession, 2)::BIGINT // {RUN} % 4 < 2
    UNION ALL
    SELECT DISTINCT CASE doc_id // {RUN} % 4 WHEN 2 THEN 'read' ELSE 'list' END, 'f' || doc_id // {RUN} || '.soft.gz', NULL, NULL, NULL
    FROM documents WHERE doc_id // {RUN} % 4 >= 2
    """
)
def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """A list of gzip files of which, of every four, one is whole, one has two members, one is cut and
    one is not there: the attributes of the sound ones, and what is said of the others."""
    run, text = F.col("run") % 4, F.col("text")
    half = (F.length(text) / 2).cast("int")
    # The second member goes on in the middle of a line. A function runs for all rows, whatever is taken of it: so
    # each text is zipped in one go or in two halves.
    first = _zipped(F.when(run == 1, F.substr(text, F.lit(1), half)).otherwise(text))
    second = _zipped(F.when(run == 1, F.substr(text, half + 1, F.length(text))))
    content = F.when(run == 0, first).when(run == 1, F.concat(first, second)).otherwise(_first_half(first))
    texts = _family_texts(spark, folder).withColumn("name", F.concat(F.lit("f"), F.col("run").cast("string"), F.lit(".soft.gz")))
    path = _write_named(texts.filter(run < 3).select("name", content.alias("content")), "families")
    lists = new_table_path(spark, "lists")
    texts.select(F.concat(F.lit(f" {path}/"), F.col("name"))).write.text(lists)
    soft = read_soft(spark, read_path_list(spark, lists))
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("key", "string"), ("pos", "bigint"), ("value", "string"))]
    return soft.attr.select(F.lit("attr").alias("kind"), F.col("accession").alias("name"), "key", "pos", "value").unionByName(
        soft.errors.select(F.col("stage").alias("kind"), base_name(F.col("file")).alias("name"), *nothing)
    )


@query(
    MTX_SQL.replace("l_suppkey // 50", "l_suppkey // 3")
    + """,
    sums AS (SELECT run, sum(q)::BIGINT AS q FROM owned GROUP BY run)
    SELECT run::VARCHAR AS sample, 'entries' AS message, q AS value FROM sums WHERE run % 5 < 2 AND q <> 0
    UNION ALL
    SELECT run::VARCHAR, CASE run % 5 WHEN 2 THEN 'not read' WHEN 3 THEN 'not read' ELSE 'files of one name differ' END, NULL
    FROM sums WHERE run % 5 > 1
    UNION ALL
    SELECT run::VARCHAR, 'the specification names no such file', NULL FROM sums WHERE run % 5 IN (2, 4)
    """
)
def archived_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """An archive of three files per sample, the labels compressed. Of every five, one is sound, one has
    a file twice, one a compressed member that is cut, one is cut itself, and one has two files of one
    name that differ: sums of the entries, and what is said of the rest."""
    files = supplier_lines(spark, folder, 3)
    texts = {}
    for role, lines in files.items():
        ordered = F.array_sort(F.collect_list(F.struct("at", "value")))
        text = F.concat(F.array_join(F.transform(ordered, lambda r: r["value"]), "\n"), F.lit("\n"))
        # A run is a few suppliers.
        texts[role] = lines.groupBy("part").agg(text.alias(role))
    rows = texts["matrix"].join(texts["barcodes"], "part").join(texts["genes"], "part")
    kind = F.col("part").cast("int") % 5
    cells = _zipped(F.col("barcodes"))
    members = [
        ("m.mtx", F.encode("matrix", "utf-8")), ("in/b.tsv.gz", F.when(kind == 2, _first_half(cells)).otherwise(cells)),
        ("in/g.tsv", F.encode("genes", "utf-8")),
    ]
    more = F.when(kind == 4, _zipped(F.lit("other\n"))).otherwise(cells)
    names, contents = (F.array(*x) for x in ([F.lit(n) for n, _ in members], [c for _, c in members]))
    again = kind.isin(1, 4)
    names = F.when(again, F.concat(names, F.array(F.lit("copy/b.tsv.gz")))).otherwise(names)
    contents = F.when(again, F.concat(contents, F.array(more))).otherwise(contents)
    tar = _tarred(names, contents)
    # The first member is cut, too.
    content = F.when(kind == 3, F.substr(tar, F.lit(1), F.lit(530))).otherwise(tar)
    name = F.concat(F.lit("s"), F.col("part"), F.lit(".tar"))
    rows = materialise(rows.select("part", content.alias("content")), "archive-contents")
    path = _write_named(rows.select(name.alias("name"), "content"), "archives")
    supp = rows.select(F.col("part").alias("sample"), name.alias("name"), F.concat(F.lit(f"{path}/"), name).alias("path"))
    text = F.lit(None).cast("string")
    specs = rows.select(
        F.col("part").alias("sample"), F.lit("MTX").alias("file_type"), F.lit("m.mtx").alias("matrix"), F.lit("b.tsv.gz").alias("barcodes"),
        F.lit("g.tsv").alias("genes"), text.alias("sep"), F.lit(None).cast("boolean").alias("cell_by_gene"), F.lit(None).cast("array<string>").alias("drop"),
    )
    loaded = load_matrices(spark, supp, specs)
    whole = label_matrix(loaded.matrices["MTX"]).groupBy("sample").agg(F.sum("value").alias("value"))
    return whole.select("sample", F.lit("entries").alias("message"), "value").unionByName(
        loaded.errors.select("sample", F.split("message", ": ")[0].alias("message"), F.lit(None).cast("bigint").alias("value"))
    )


@query(
    DENSE_SQL.replace("vec_id // 200", "vec_id // 40")
    + """
    SELECT v.sample, 'c' || v.vec_id % 7 || CASE WHEN v.vec_id % 40 = 1 AND (v.vec_id // 40) % 3 = 2 THEN E'\n"x' ELSE '' END AS cell_id,
           'g' || v.pos AS gene_name, sum(v.value) AS value
    FROM vals v WHERE v.value <> 0 AND (v.vec_id % 40 > 0 OR (v.vec_id // 40) % 3 = 2) GROUP BY ALL
    UNION ALL
    SELECT sample, NULL, 'line 2 has ' || CASE (vec_id // 40) % 3 WHEN 0 THEN 64 ELSE 66 END || ' fields, not 65', NULL
    FROM vals WHERE vec_id % 40 = 0 AND (vec_id // 40) % 3 < 2 AND pos = 1
    """
)
def uneven_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Dense tables in which the first line after the header lacks a field, has one too many, or comes
    before one with a line break and a quote in its name. Sums by name, which repeat."""
    vectors = table(spark, folder, "embeddings").withColumn("part", F.floor(F.col("vec_id") / 40))
    numbers = F.transform("embedding", lambda v: (v.cast("double") * 100).cast("string"))
    kind, at = F.col("part") % 3, F.col("vec_id") % 40
    fields = F.when((at == 0) & (kind == 0), F.slice(numbers, 1, 63)).when(
        (at == 0) & (kind == 1), F.concat(numbers, F.array(F.lit("1")))).otherwise(numbers)
    name = F.concat(F.lit("c"), (F.col("vec_id") % 7).cast("string"))
    name = F.when((at == 1) & (kind == 2), F.concat(F.lit('"'), name, F.lit('\n""x"'))).otherwise(name)
    value = F.concat_ws(",", name, F.array_join(fields, ","))
    rows = vectors.select(F.col("part").cast("string").alias("part"), F.col("vec_id").alias("at"), value.alias("value"))
    head = "cell," + ",".join(f"g{i}" for i in range(1, 65))
    heads = rows.select("part").distinct().select("part", F.lit(-1).cast("bigint").alias("at"), F.lit(head).alias("value"))
    files = written_parts(spark, write_lines(rows.unionByName(heads), "uneven", "at"), "path")
    spec = files.select("*", F.lit(",").alias("sep"), F.lit(True).alias("cell_by_gene"), F.lit(None).cast("array<string>").alias("drop"))
    matrix = read_dense_matrix(spark, spec)
    # Names are told apart by their numbers, which a sum does without.
    own = F.regexp_replace("cell_id", r"(?s)^(c\d)-\d+$", "$1")
    sums = label_matrix(matrix).groupBy("sample", own.alias("cell_id"), "gene_name").agg(F.sum("value").alias("value"))
    return sums.unionByName(matrix.errors.select(
        "sample", F.lit(None).cast("string").alias("cell_id"), F.col("message").alias("gene_name"), F.lit(None).cast("bigint").alias("value")
    ))
