"""Count matrices of many samples from their supplementary files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplelake.functions.replies import field
from samplelake.operators.infer import Responder, infer, parse_replies
from samplelake.operators.prompts import file_context
from samplelake.operators.joins import join_dim
from samplelake.session import materialise
from samplelake.sources.files import INSIDE, is_archive, read_files
from samplelake.sources.matrices import Matrix, read_dense_matrix, read_mtx
from samplelake.sources.supplementary import bare_path, base_name, one_per_name, sample_type, with_members

# The members of a reader specification.
SPEC = ("file_type", "matrix", "barcodes", "genes", "sep", "cell_by_gene", "drop")


@dataclass(frozen=True)
class Loaded:
    matrices: dict[str, Matrix]
    errors: DataFrame


def spec_prompt(context: str) -> str:
    return (
        "These are the files of one sample, each with its first lines. Say how its count matrix is "
        "to be read.\n" + context + "\nAnswer with one fenced json block with the members: "
        "file_type (MTX for coordinate text with two label files, TABLE for a dense table), matrix, "
        "barcodes, genes (file names; the last two only for MTX), and for TABLE sep, cell_by_gene "
        "(true if rows are cells), drop (names of rows or columns that are no counts)."
    )


def propose_specs(supp: DataFrame, responder: Responder, *, store: str | None = None, retries: int = 3) -> DataFrame:
    """``sample`` and the members of ``SPEC``: a model's proposal from the peeks, as data. It
    never returns code. ``supp`` holds ``sample, name, lines, total``."""
    head, tail = spec_prompt("\x00").split("\x00")
    prompt = F.concat(F.lit(head), F.col("context"), F.lit(tail))
    asked = file_context(supp).select("sample", prompt.alias("prompt")).withColumn("prompt_key", F.sha2("prompt", 256))
    replies = infer(asked, responder, None, store, retries)
    value = F.col("value")
    members = [field(value, n, "boolean" if n == "cell_by_gene" else "string").alias(n) for n in SPEC if n != "drop"]
    members.append(field(value, "drop", "array<string>").alias("drop"))
    return asked.select("sample", "prompt_key").join(parse_replies(replies), "prompt_key").select("sample", *members)


def load_matrices(spark: SparkSession, supp: DataFrame, specs: DataFrame) -> Loaded:
    """Matrices of all samples, by file type, and ``errors(stage, sample, message)``.

    ``supp`` holds ``sample, path, name``; ``specs`` the members of ``SPEC`` per sample, files by
    name. The files in a sample's archives are files of the sample. Of files with one name and the
    same content one is taken; if their contents differ none is (``one_per_name``). The type a
    sample's names give decides which reader it goes to; types without a reader, samples without a
    known file and files that cannot be read are errors.
    """
    supp = materialise(supp.select("sample", "name", "path").distinct(), "supplementary")
    roles = ["matrix", "barcodes", "genes"]
    named = specs.select("sample", F.explode(F.array(*roles)).alias("name")).filter("name IS NOT NULL").distinct()
    packed = supp.filter(is_archive(F.col("name")))
    wanted = packed.unionByName(join_dim(supp.filter(~is_archive(F.col("name"))), named, ["sample", "name"], "left_semi").select(*supp.columns))
    # Everything is read once, whatever its role.
    read = read_files(spark, wanted.select("path"))
    members = materialise(with_members(supp, read), "members")
    paths, odd = one_per_name(members, read)
    paths = materialise(paths, "one-per-name")
    broken = join_dim(read.errors.withColumn("bare", bare_path(F.split("file", INSIDE, 2)[0])), packed.select(bare_path(F.col("path")).alias("bare"), "sample"), "bare", "inner")
    unread = broken.select("sample", F.concat(F.lit("not read: "), F.col("message"), F.lit(": "), base_name(F.col("file"))).alias("message"))
    typed = sample_type(members).join(specs.drop("file_type"), "sample", "left")

    def path_of(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        for c in columns:
            side = paths.select("sample", F.col("name").alias(c), F.col("path").alias(f"{c}_path"))
            rows = rows.join(side, ["sample", c], "left").drop(c).withColumnRenamed(f"{c}_path", c)
        return rows

    typed = materialise(typed, "typed-samples")
    mtx = materialise(path_of(typed.filter("file_type = 'MTX'"), roles), "mtx-files")
    table = materialise(path_of(typed.filter("file_type = 'TABLE'"), ["matrix"]), "table-files")
    mtx_ok = F.col("matrix").isNotNull() & F.col("barcodes").isNotNull() & F.col("genes").isNotNull()
    table_ok = F.col("matrix").isNotNull() & F.col("sep").isNotNull() & F.col("cell_by_gene").isNotNull()

    problems = (
        typed.filter(~F.col("file_type").isin("MTX", "TABLE")).select(
            "sample", F.concat(F.lit("no reader for file type "), F.col("file_type")).alias("message")
        )
        .unionByName(mtx.filter(~mtx_ok).select("sample", F.lit("the specification names no such file").alias("message")))
        .unionByName(table.filter(~table_ok).select("sample", F.lit("the specification is not complete").alias("message")))
        .unionByName(odd).unionByName(unread)
        .select(F.lit("matrix").alias("stage"), "sample", "message")
    )
    matrices = {}
    good = mtx.filter(mtx_ok).select("sample", *roles)
    if good.take(1):
        matrices["MTX"] = read_mtx(spark, good, read)
    good = table.filter(table_ok).select("sample", F.col("matrix").alias("path"), "sep", "cell_by_gene", "drop")
    if good.take(1):
        matrices["TABLE"] = read_dense_matrix(spark, good, read)
    for m in matrices.values():
        problems = problems.unionByName(m.errors)
    return Loaded(matrices, problems)
