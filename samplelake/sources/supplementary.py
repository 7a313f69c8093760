"""Supplementary files: peeks, archive members, types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samplelake.functions.filetypes import file_type
from samplelake.functions.text import cut_line
from samplelake.operators.joins import join_dim
from samplelake.session import materialise, new_table_path
from samplelake.sources.files import INSIDE, PATHS, Files, batches, escaped, is_archive, plain_path, read_files

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def base_name(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def bare_path(path: Column) -> Column:
    """A path without scheme and authority."""
    return F.regexp_replace(plain_path(path), _SCHEME, "")


def peek_files(spark: SparkSession, paths: DataFrame | str | Sequence[str], n: int = 10, width: int = 100) -> DataFrame:
    """``file, lines, total``: the first ``n`` lines, long ones cut, and the number of lines.

    Plain and gzip text, and the files in archives. Lines are counted where they are read, and only
    the first ones are kept. An empty file has no lines and a total of 0; a file that cannot be read
    has no row.
    """
    files = read_files(spark, paths, keep=F.col("n") < n)
    head = files.lines.filter(F.col("n") < n).withColumn("value", cut_line(F.col("value"), width))
    ordered = F.array_sort(F.collect_list(F.struct("n", "value")))
    peeks = head.groupBy("file").agg(F.transform(ordered, lambda r: r["value"]).alias("lines"))
    none = F.array().cast("array<string>")
    return files.files.join(peeks, "file", "left").select("file", F.coalesce("lines", none).alias("lines"), F.col("n_lines").alias("total"))


def with_members(supp: DataFrame, files: Files) -> DataFrame:
    """``sample, name, path`` of ``supp`` with the files in its archives, folders flattened, in the
    place of the archives. ``files`` are those read, of which the archives are some."""
    rows = supp.select("sample", "name", "path")
    inside = files.files.select("file", F.split("file", INSIDE, 2).alias("p")).filter(F.size("p") == 2)
    members = inside.select(bare_path(F.col("p")[0]).alias("bare"), base_name(F.col("p")[1]).alias("name"), F.col("file").alias("path"))
    archives = rows.filter(is_archive(F.col("name"))).select("sample", bare_path(F.col("path")).alias("bare"))
    opened = join_dim(members, archives, "bare", "inner").select("sample", "name", "path")
    return rows.filter(~is_archive(F.col("name"))).unionByName(opened)


def one_per_name(supp: DataFrame, files: Files) -> tuple[DataFrame, DataFrame]:
    """``sample, name, path`` with each name once in a sample, and ``sample, message`` of the names
    that are left out.

    Of files with one name in a sample, all with the same content are one, the one with the first
    path; if contents differ none is taken. The content is told by its digest: the one taken when a
    compressed file or a member was read, or, for a plain file that shares its name, of its bytes.
    """
    spark = supp.sparkSession
    rows = supp.select("sample", "name", "path").distinct()
    many = rows.groupBy("sample", "name").agg(F.count("*").alias("n")).filter("n > 1").select("sample", "name")
    twice = join_dim(rows, many, ["sample", "name"], "left_semi")
    bare = files.files.select(bare_path(F.col("file")).alias("bare"), "file", "digest")
    told = join_dim(twice.withColumn("bare", bare_path(F.col("path"))), bare, "bare").select("sample", "name", "path", "file", "digest")
    told = materialise(told, "same-names")
    sums = new_table_path(spark, "digests")
    spark.createDataFrame([], "bare string, own string").write.parquet(sums)
    for some in batches(told.filter("digest IS NULL AND file IS NOT NULL").select("file"), PATHS):
        found = spark.read.format("binaryFile").load([escaped(f) for f in some])
        found.select(bare_path(F.col("path")).alias("bare"), F.sha2("content", 256).alias("own")).write.mode("append").parquet(sums)
    plain = spark.read.schema("bare string, own string").parquet(sums)
    told = join_dim(told.withColumn("bare", bare_path(F.col("path"))), plain, "bare", stored=True).withColumn("digest", F.coalesce("digest", "own"))
    kept = told.groupBy("sample", "name").agg(F.min("path").alias("path"), F.count_distinct(F.coalesce("digest", F.col("path"))).alias("kinds"))
    single = join_dim(rows, many, ["sample", "name"], "left_anti")
    odd = kept.filter("kinds > 1").select("sample", F.concat(F.lit("files of one name differ: "), F.col("name")).alias("message"))
    return single.unionByName(kept.filter("kinds = 1").select("sample", "name", "path")), odd


def sample_type(supp: DataFrame, last_wins: bool = False) -> DataFrame:
    """``sample, file_type`` from ``supp(sample, name)``: the type of the last name that has one,
    by name order; with MTX over TABLE unless ``last_wins``. No typed file gives UNKNOWN."""
    typed = supp.select("sample", "name", file_type(F.col("name")).alias("t"))
    known = F.col("t") != "UNKNOWN"
    latest = F.max_by(F.when(known, F.col("t")), F.when(known, F.col("name")))
    chosen = F.coalesce(latest, F.lit("UNKNOWN"))
    if not last_wins:
        chosen = F.when((latest == "TABLE") & F.max(F.col("t") == "MTX"), F.lit("MTX")).otherwise(chosen)
    return typed.groupBy("sample").agg(chosen.alias("file_type"))
