"""Count matrices from text files, in long form.

A matrix is three tables: ``entries(sample, cell_ix, gene_ix, value)`` without zeros,
``cells(sample, cell_ix, cell_id)`` and ``genes(sample, gene_ix, gene_name)``. Many samples are
read by one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samplelake.operators.joins import join_dim
from samplelake.operators.ordered import make_unique
from samplelake.session import materialise
from samplelake.sources.files import INSIDE, Files, plain_path, read_files
from samplelake.sources.supplementary import bare_path

#: Lines that a record with line breaks in quotes may have.
LONGEST_RECORD = 1000


@dataclass(frozen=True)
class Matrix:
    entries: DataFrame
    cells: DataFrame
    genes: DataFrame
    errors: DataFrame


def whole_number(text: Column) -> Column:
    """A number cut to an integer; null if the text is no number."""
    return text.try_cast("double").try_cast("bigint")


def orient(entries: DataFrame, cell_by_gene: Column | bool) -> DataFrame:
    """Rows become cells: swap the two positions where the source is gene-by-cell."""
    keep = F.lit(cell_by_gene) if isinstance(cell_by_gene, bool) else cell_by_gene
    return entries.select(
        "sample",
        F.when(keep, F.col("row_ix")).otherwise(F.col("col_ix")).alias("cell_ix"),
        F.when(keep, F.col("col_ix")).otherwise(F.col("row_ix")).alias("gene_ix"),
        "value",
    )


def label_matrix(matrix: Matrix) -> DataFrame:
    """``sample, cell_id, gene_name, value``: entries with both labels."""
    cells = matrix.cells.select("sample", "cell_ix", "cell_id")
    genes = matrix.genes.select("sample", "gene_ix", "gene_name")
    by_cell = join_dim(matrix.entries, cells, ["sample", "cell_ix"])
    named = join_dim(by_cell, genes, ["sample", "gene_ix"])
    return named.select("sample", "cell_id", "gene_name", "value")


def _owned(files: DataFrame, column: str, read: Files) -> DataFrame:
    """``file, sample`` of the files that ``files(sample, <column>)`` names, as they were read."""
    wanted = files.select("sample", plain_path(F.col(column)).alias("own"), bare_path(F.col(column)).alias("bare"))
    # A path without a scheme is in the session's own file system.
    known = read.files.select("file", bare_path(F.col("file")).alias("bare"))
    both = wanted.join(known, "bare").filter((F.col("own") == F.col("bare")) | (F.col("own") == F.col("file")))
    return both.select("file", "sample").distinct()


def _unread(files: DataFrame, columns: Sequence[str], read: Files) -> DataFrame:
    """``sample, message`` for the files that are not there or could not be read to their end."""
    named = files.select("sample", F.explode(F.array(*columns)).alias("path")).withColumn("bare", bare_path(F.col("path")))
    known = read.files.select(bare_path(F.col("file")).alias("bare"))
    lost = named.join(known, "bare", "left_anti")
    why = read.errors.groupBy(bare_path(F.col("file")).alias("bare")).agg(F.min("message").alias("why"))
    return lost.join(why, "bare", "left").select(
        "sample", F.concat(F.lit("not read: "), F.coalesce("why", F.lit("no such file")), F.lit(": "), F.col("path")).alias("message")
    )


def paths_of(files: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``path``: what has to be read for them; of a file in an archive the archive."""
    named = files.select(F.explode(F.array(*columns)).alias("path")).filter("path IS NOT NULL")
    return named.select(F.split("path", INSIDE, 2)[0].alias("path")).distinct()


def _labels(files: DataFrame, column: str, read: Files, ix: str, name: str) -> DataFrame:
    """``sample, <ix>, <name>``: the lines of label files by position from 0; of several
    tab-separated columns the first."""
    lines = read.lines.filter(F.trim("value") != "")
    owned = join_dim(lines, _owned(files, column, read), "file", "inner")
    return owned.select("sample", F.col("full").alias(ix), F.trim(F.split("value", "\t")[0]).alias(name))


def _matrix_errors(bad: DataFrame, message: Column) -> DataFrame:
    return bad.select(F.lit("matrix").alias("stage"), "sample", message.alias("message"))


def _not_a_number() -> Column:
    return F.concat(F.lit("not a number: "), F.col("text"))


def read_mtx(spark: SparkSession, files: DataFrame, read: Files | None = None) -> Matrix:
    """Sparse matrices from ``files(sample, matrix, barcodes, genes)``, the last three being
    paths: coordinate text and two label files. A matrix whose first dimension is not the
    number of barcodes is turned. Names are made unique. A path may name a file in an archive
    (``archive!/member``). ``read`` has the lines if they have been read already.

    A sample with a file that is not there or cannot be read to its end, whose labels fit the
    matrix neither way, or whose size line cannot be read, gives no entries and a row in ``errors``;
    so does a line that is no entry, for itself alone.
    """
    roles = ("matrix", "barcodes", "genes")
    files = materialise(files.select("sample", *roles), "matrix-files")
    read = read or read_files(spark, paths_of(files, roles))
    unread = materialise(_unread(files, roles, read), "unread")
    files = materialise(files.join(unread.select("sample"), "sample", "left_anti"), "read-files")
    cells = materialise(_labels(files, "barcodes", read, "cell_ix", "cell_id"), "cells")
    genes = materialise(_labels(files, "genes", read, "gene_ix", "gene_name"), "genes")
    owner = materialise(_owned(files, "matrix", read), "matrix-owners")
    every = join_dim(read.lines.select("file", "n", "value"), owner.select("file").distinct(), "file", "left_semi")
    parts = F.split(F.trim("value"), r"\s+")
    row, col = (F.get(parts, F.lit(i)).try_cast("bigint") for i in (0, 1))
    # a pattern matrix has no third column: what is listed is there once
    text = F.coalesce(F.get(parts, F.lit(2)), F.lit("1"))
    # Stored as they are taken apart, since the size, the entries and the errors are taken from them.
    lines = materialise(
        every.filter(~F.col("value").startswith("%") & (F.trim("value") != "")).select(
            "*", row.alias("row"), col.alias("col"), text.alias("text")
        ), "matrix-lines",
    )

    # The first line that is no comment gives the size.
    size = lines.groupBy("file").agg(F.min_by("value", "n").alias("size"), F.min("n").alias("size_at"))
    shape = F.split(F.trim("size"), r"\s+")
    n_rows, n_cols = (F.get(shape, F.lit(i)).try_cast("bigint") for i in (0, 1))
    barcodes = cells.groupBy("sample").agg(F.count("*").alias("n_cells"))
    names = genes.groupBy("sample").agg(F.count("*").alias("n_genes"))
    counted = owner.join(size, "file", "left").join(barcodes, "sample", "left").join(names, "sample", "left").select(
        "file", "sample", "size", "size_at", n_rows.alias("n_rows"), n_cols.alias("n_cols"),
        F.coalesce("n_cells", F.lit(0)).alias("n_cells"), F.coalesce("n_genes", F.lit(0)).alias("n_genes"),
    )
    first_is_cell = (F.col("n_rows") == F.col("n_cells")) & (F.col("n_cols") == F.col("n_genes"))
    first_is_gene = (F.col("n_rows") == F.col("n_genes")) & (F.col("n_cols") == F.col("n_cells"))
    sizes = materialise(counted.select(
        "*", first_is_cell.alias("by_cell"), F.coalesce(first_is_cell | first_is_gene, F.lit(False)).alias("fits")
    ), "sizes")
    fitting = sizes.filter("fits").select("file", "sample", "size_at", "by_cell", "n_rows", "n_cols")
    plain = join_dim(lines, fitting, "file", "inner").filter(F.col("n") > F.col("size_at"))
    row, col = F.col("row"), F.col("col")
    parsed = plain.select(
        "sample",
        "by_cell",
        F.col("value").alias("line"),
        (row - 1).alias("row_ix"),
        (col - 1).alias("col_ix"),
        F.coalesce(row.between(1, F.col("n_rows")) & col.between(1, F.col("n_cols")), F.lit(False)).alias("placed"),
        "text",
    ).withColumn("value", whole_number(F.col("text")))
    misfit = F.concat(
        F.lit("the labels do not fit: size line "), F.coalesce("size", F.lit("missing")), F.lit(", "),
        F.col("n_cells"), F.lit(" barcodes, "), F.col("n_genes"), F.lit(" genes"),
    )
    errors = (
        _matrix_errors(parsed.filter("placed AND value IS NULL"), _not_a_number())
        .unionByName(_matrix_errors(parsed.filter("NOT placed"), F.concat(F.lit("not an entry: "), F.col("line"))))
        .unionByName(_matrix_errors(sizes.filter("NOT fits"), misfit))
        .unionByName(_matrix_errors(unread, F.col("message")))
    )
    return Matrix(
        orient(parsed.filter("placed AND value != 0"), F.col("by_cell")),
        make_unique(cells, "cell_id", "cell_ix", by=["sample"]),
        make_unique(genes, "gene_name", "gene_ix", by=["sample"]),
        errors,
    )


def _cells_of_line(value: Column, sep: Column) -> Column:
    """The fields of a line; a separator inside double quotes is part of its field."""
    quoted = F.concat(F.lit("\\Q"), sep, F.lit("\\E"))
    field = F.concat(quoted, F.lit("(\"[^\"]*(?:\"\"[^\"]*)*\"|(?:(?!"), quoted, F.lit(").)*)"))
    return F.transform(F.regexp_extract_all(F.concat(sep, value), field, F.lit(1)), _unquote)


def _joined_records(lines: DataFrame) -> DataFrame:
    """``lines(file, sample, sep, n, full, value)`` with the lines of a quoted field that holds line
    breaks put together, at the number of the first of them.

    Whether a line ends inside quotes depends on how it starts. Only lines that change that, which
    are few, are looked at: some always end inside or always outside, the others turn it over,
    so the state behind a line is that of the last line of the first kind, turned as often as there
    are lines of the second kind since. Lines that are more than ``LONGEST_RECORD`` apart have
    nothing to do with each other, so a stray quote spoils no more.
    """
    sep = F.concat(F.lit("\\Q"), F.col("sep"), F.lit("\\E"))
    starts = F.concat(F.lit('\\s*"([^"]|"")*$'))
    opens = F.concat(F.lit("^(.*"), sep, F.lit(")?"), starts)
    closes = F.concat(F.lit('^([^"]|"")*"\\s*('), sep, F.lit("|$)"))
    reopens = F.concat(F.lit('^([^"]|"")*"\\s*'), sep, F.lit("(.*"), sep, F.lit(")?"), starts)
    told = lines.filter(F.col("value").contains('"')).select(
        "file", "sample", "n", F.regexp("value", opens).alias("from_outside"),
        (~F.regexp("value", closes) | F.regexp("value", reopens)).alias("from_inside"),
    )
    changing = materialise(told.filter("from_outside OR NOT from_inside"), "quotes")
    own = ["file", "sample"]
    by = Window.partitionBy(*own).orderBy("n")
    far = F.coalesce(F.col("n") - F.lag("n").over(by) > LONGEST_RECORD, F.lit(False))
    spans = changing.withColumn("span", F.sum(far.cast("int")).over(by))
    inside = Window.partitionBy(*own, "span").orderBy("n")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    always = F.col("from_outside") == F.col("from_inside")
    turns = spans.withColumn("turns", F.sum((~always).cast("int")).over(upto))
    fixed = F.last(F.when(always, F.struct("from_outside", "turns")), ignorenulls=True).over(upto)
    known = turns.withColumn("fixed", fixed)
    odd = (F.col("turns") - F.coalesce("fixed.turns", F.lit(0))) % 2 == 1
    states = known.withColumn("after", F.coalesce("fixed.from_outside", F.lit(False)) != odd)
    placed = states.withColumn("before", F.coalesce(F.lag("after").over(inside), F.lit(False)))
    following = inside.rowsBetween(1, Window.unboundedFollowing)
    placed = placed.withColumn("stop", F.min(F.when(~F.col("after"), F.col("n"))).over(following))
    records = placed.filter(F.col("after") & ~F.col("before") & (F.col("stop") - F.col("n") <= LONGEST_RECORD))
    inside = records.select(*own, F.col("n").alias("record"), F.explode(F.sequence("n", "stop")).alias("n"))
    inside = materialise(inside, "records-of-lines")
    if not inside.limit(1).count():
        return lines.filter("value <> ''")
    placed = join_dim(lines, inside, ["file", "sample", "n"], stored=True)
    alone = placed.filter("record IS NULL AND value <> ''").select(*lines.columns)
    ordered = F.array_sort(F.collect_list(F.struct("n", "value")))
    pieces = placed.filter("record IS NOT NULL").groupBy("file", "sample", "sep", F.col("record").alias("n")).agg(
        F.min("full").alias("full"), F.array_join(F.transform(ordered, lambda r: r["value"]), "\n").alias("value")
    )
    return alone.unionByName(pieces)


def read_dense_matrix(spark: SparkSession, files: DataFrame, read: Files | None = None) -> Matrix:
    """Dense tables from ``files(sample, path, sep, cell_by_gene, drop)``: a header line, then a
    name and values per line. ``drop`` names rows or columns that hold no counts; positions are
    those of the source, so what is dropped leaves a gap. Values are cut to integers; text
    that is no number goes to ``errors``. Names are made unique. A quoted field may hold the
    separator and line breaks. ``read`` has the lines if they have been read already.

    The width that most lines have tells whether the header names the column of row names. If it
    fits the header neither way the sample gives no entries; a line that is longer or shorter than
    most gives none itself. Both are in ``errors``, and so is a file that is not there or cannot be
    read to its end.

    What is known per file (header, drop list) is joined to lines, never to values.
    """
    files = materialise(files.select("sample", F.col("path").alias("__path"), "sep", "cell_by_gene", "drop"), "matrix-files")
    read = read or read_files(spark, paths_of(files, ["__path"]))
    unread = materialise(_unread(files, ["__path"], read), "unread")
    owner = _owned(files.join(unread.select("sample"), "sample", "left_anti"), "__path", read)
    owner = materialise(owner.join(files.select("sample", "sep", "cell_by_gene", "drop"), "sample"), "dense-owners")
    lines = join_dim(read.lines.select("file", "n", "full", "value"), owner.select("file", "sample", "sep"), "file", "inner")
    whole = _joined_records(lines)
    records = materialise(
        whole.select("file", "sample", F.col("full").alias("n"), _cells_of_line(F.col("value"), F.col("sep")).alias("parts")), "dense-records"
    )
    header = records.filter("n = 0").select("file", "sample", F.col("parts").alias("names"))
    # One number per width and file leaves each task; the narrower of two that are as frequent.
    widths = records.filter("n > 0").groupBy("file", "sample", F.size("parts").alias("width")).agg(F.count("*").alias("lines"))
    most = widths.groupBy("file", "sample").agg(F.max_by("width", F.struct("lines", -F.col("width"))).alias("width"))
    spec = owner.join(header, ["file", "sample"], "left").join(most, ["file", "sample"], "left")
    split = spec.select(
        "file", "sample", "sep", "cell_by_gene",
        F.coalesce("drop", F.array().cast("array<string>")).alias("__drop"),
        F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.coalesce("width", F.lit(0)).alias("width"),
    )
    # A header that leaves out the name of the row-name column is one entry shorter.
    fits = (F.col("width") > 1) & F.col("width").isin(F.size("names"), F.size("names") + 1)
    # A header alone is an empty matrix.
    spec = materialise(split.withColumn("fits", fits | ((F.col("width") == 0) & (F.size("names") > 0))), "dense-spec")
    known = spec.filter("fits").select(
        "file", "sample", "sep", "cell_by_gene", "__drop", "width",
        F.slice("names", F.size("names") - F.col("width") + 2, F.greatest(F.col("width") - 1, F.lit(0))).alias("names"),
    )
    owned = join_dim(records.filter("n > 0"), known, ["file", "sample"], "inner").select(
        "sample", "cell_by_gene", "__drop", "names", "width", (F.col("n") - 1).alias("row_ix"), (F.col("n") + 1).alias("line_no"), "parts"
    )
    whole = owned.filter(F.size("parts") == F.col("width"))
    rows = whole.withColumn("name", F.col("parts")[0]).filter(~F.array_contains("__drop", F.col("name")))

    # Dropped columns go before the values are spread over rows.
    pairs = F.arrays_zip(
        F.col("names").alias("name"), F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))).alias("text"),
        F.sequence(F.lit(0), F.size("parts") - 2).alias("col_ix"),
    )
    values = rows.select(
        "sample", "cell_by_gene", "row_ix", F.explode(F.filter(pairs, lambda p: ~F.array_contains("__drop", p["name"]))).alias("p")
    )
    valued = values.select(
        "sample", "cell_by_gene", "row_ix", F.col("p.col_ix").cast("bigint").alias("col_ix"), F.col("p.text").alias("text"),
        whole_number(F.col("p.text")).alias("value"),
    )
    entries = orient(valued.filter("value != 0"), F.col("cell_by_gene"))

    row_names = rows.select("sample", "cell_by_gene", F.col("row_ix").alias("ix"), "name", F.lit(True).alias("is_row"))
    col_names = (
        known.filter("width > 0").select("sample", "cell_by_gene", "__drop", F.posexplode("names").alias("ix", "name"))
        .filter(~F.array_contains("__drop", F.col("name")))
        .select("sample", "cell_by_gene", F.col("ix").cast("bigint").alias("ix"), "name", F.lit(False).alias("is_row"))
    )
    both = row_names.unionByName(col_names)
    on_cells = F.col("is_row") == F.col("cell_by_gene")
    cells = both.filter(on_cells).select("sample", F.col("ix").alias("cell_ix"), F.col("name").alias("cell_id"))
    genes = both.filter(~on_cells).select("sample", F.col("ix").alias("gene_ix"), F.col("name").alias("gene_name"))
    uneven = F.concat(F.lit("line "), F.col("line_no"), F.lit(" has "), F.size("parts"), F.lit(" fields, not "), F.col("width"))
    misfit = F.concat(
        F.lit("the header does not fit: "), F.size("names"), F.lit(" names, "), F.col("width"), F.lit(" fields in most lines")
    )
    return Matrix(
        entries,
        make_unique(cells, "cell_id", "cell_ix", by=["sample"]),
        make_unique(genes, "gene_name", "gene_ix", by=["sample"]),
        _matrix_errors(valued.filter(F.col("value").isNull()), _not_a_number())
        .unionByName(_matrix_errors(owned.filter(F.size("parts") != F.col("width")), uneven))
        .unionByName(_matrix_errors(spec.filter("NOT fits"), misfit))
        .unionByName(_matrix_errors(unread, F.col("message"))),
    )


def _unquote(text: Column) -> Column:
    inner = F.regexp_replace(F.regexp_extract(F.trim(text), r'(?s)^"(.*)"$', 1), '""', '"')
    return F.when(F.trim(text).rlike(r'(?s)^".*"$'), inner).otherwise(F.trim(text))
