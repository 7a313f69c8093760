"""Matrices, supplementary files and attribute files written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplelake.operators.ordered import ordinal
from samplelake.operators.prompts import file_context
from samplelake.queries.registry import ATTR_SQL, document_attr, query, table
from samplelake.session import materialise, new_table_path
from samplelake.sinks.tables import write_matrix
from samplelake.sources.matrices import Matrix, label_matrix, orient, read_dense_matrix, read_mtx, whole_number
from samplelake.sources.files import list_files
from samplelake.sources.soft import read_soft
from samplelake.sources.supplementary import peek_files, sample_type


def file_tasks(spark: SparkSession) -> int:
    """Tasks that write many files. A given number is kept, where adaptive execution would merge tasks by their
    bytes and leave thousands of small files to one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def write_lines(lines: DataFrame, label: str, *order: str) -> str:
    """Text files, one per ``part`` value, lines sorted by ``order``. ``lines`` holds ``part,
    value``; a part is small, and parts are spread over the tasks."""
    path = new_table_path(lines.sparkSession, label)
    sorted_lines = lines.repartition(file_tasks(lines.sparkSession), "part").sortWithinPartitions("part", *order)
    sorted_lines.select("part", "value").write.partitionBy("part").text(path)
    return path


def written_parts(spark: SparkSession, path: str, column: str) -> DataFrame:
    """``sample, <column>``: the file of each part."""
    files = list_files(spark, path).filter(F.col("file").endswith(".txt"))
    return files.select(F.regexp_extract("file", r"part=([^/]+)/", 1).alias("sample"), F.col("file").alias(column))


@query(
    """
    SELECT vec_id AS cell_ix, u.pos - 1 AS gene_ix, CAST(trunc(u.v::DOUBLE * 100) AS BIGINT) AS value
    FROM embeddings, UNNEST(embedding) WITH ORDINALITY AS u(v, pos)
    WHERE CAST(trunc(u.v::DOUBLE * 100) AS BIGINT) <> 0
    """
)
def vector_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as a gene-by-cell source, turned."""
    vectors = table(spark, folder, "embeddings")
    wide = vectors.select(F.lit("s").alias("sample"), F.col("vec_id").alias("col_ix"), F.posexplode("embedding").alias("row_ix", "v"))
    value = whole_number((F.col("v").cast("double") * 100).cast("string"))
    entries = wide.select("sample", F.col("row_ix").cast("bigint").alias("row_ix"), "col_ix", value.alias("value"))
    return orient(entries.filter("value <> 0"), False).drop("sample")


DENSE_SQL = """
WITH vals AS (
  SELECT (vec_id // 200)::VARCHAR AS sample, vec_id, u.pos, CAST(trunc(u.v::DOUBLE * 100) AS BIGINT) AS value
  FROM embeddings, UNNEST(embedding) WITH ORDINALITY AS u(v, pos)
),
names AS (
  SELECT vec_id, row_number() OVER (PARTITION BY vec_id // 200, vec_id % 7 ORDER BY vec_id) - 1 AS k FROM embeddings
)
"""


@query(
    DENSE_SQL
    + """
    SELECT v.sample, 'c' || v.vec_id % 7 || CASE WHEN n.k > 0 THEN '-' || n.k ELSE '' END AS cell_id,
           'g' || v.pos AS gene_name, v.value
    FROM vals v JOIN names n USING (vec_id) WHERE v.value <> 0 AND v.pos <> 3
    """
)
def dense_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A dense table per run of 200 vectors, row names repeated, one column dropped by name."""
    return label_matrix(read_dense_matrix(spark, _dense_files(spark, folder, "dense", "c", "g", "")))


def _dense_files(spark: SparkSession, folder: str, label: str, cell: str, gene: str, quote: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").withColumn("part", F.floor(F.col("vec_id") / 200).cast("string"))
    numbers = F.transform("embedding", lambda v: (v.cast("double") * 100).cast("string"))
    header = F.array_join(
        F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.concat(F.lit(f'"{gene}'), i.cast("string"), F.lit('"'))), ","
    )
    name = F.concat(F.lit(f"{quote}{cell}"), (F.col("vec_id") % 7).cast("string"), F.lit(quote))
    rows = vectors.select(
        "part", F.col("vec_id").alias("at"), F.concat_ws(",", name, F.array_join(numbers, ",")).alias("value"),
    )
    heads = vectors.select("part").distinct().select(
        "part", F.lit(-1).cast("bigint").alias("at"), F.concat(F.lit("cell,"), header).alias("value")
    )
    files = written_parts(spark, write_lines(rows.unionByName(heads), label, "at"), "path")
    return files.select("*", F.lit(",").alias("sep"), F.lit(True).alias("cell_by_gene"), F.array(F.lit(f"{gene}3")).alias("drop"))


@query(
    DENSE_SQL
    + """
    SELECT v.sample, 'c,' || v.vec_id % 7 || CASE WHEN n.k > 0 THEN '-' || n.k ELSE '' END AS cell_id,
           'g,' || v.pos AS gene_name, v.value
    FROM vals v JOIN names n USING (vec_id) WHERE v.value <> 0 AND v.pos <> 3
    """
)
def quoted_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Names that hold the separator, in files whose path holds a space and a percent sign."""
    return label_matrix(read_dense_matrix(spark, _dense_files(spark, folder, "100% dense", "c,", "g,", '"')))


MTX_SQL = """
WITH owned AS (
  SELECT l_suppkey // 50 AS run, l_partkey AS part, l_suppkey AS supp, CAST(sum(l_quantity) AS BIGINT) AS q
  FROM lineitem GROUP BY ALL
),
cells AS (SELECT DISTINCT run, supp FROM owned),
cell_ix AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY supp) - 1 AS ix FROM cells),
genes AS (SELECT DISTINCT o.run, o.part, p.p_name FROM owned o JOIN part p ON p.p_partkey = o.part),
gene_ix AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY part) - 1 AS ix,
         row_number() OVER (PARTITION BY run, p_name ORDER BY part) - 1 AS k FROM genes
)
"""


def _supplier_matrices(spark: SparkSession, folder: str) -> Matrix:
    return read_mtx(spark, _supplier_files(spark, folder, 50))


def supplier_lines(spark: SparkSession, folder: str, run: int, faults: bool = False) -> dict[str, DataFrame]:
    """``part, at, value`` lines by role: a gene-by-cell coordinate file per run of suppliers, with
    suppliers as cells and parts as genes. With ``faults``, of every four runs the second has two lines that are no entries, the third
    an empty label file and the fourth a label too many."""
    items = table(spark, folder, "lineitem").select(
        F.floor(F.col("l_suppkey") / run).cast("string").alias("part"), "l_partkey", "l_suppkey", "l_quantity"
    )
    owned = materialise(items.groupBy("part", "l_partkey", "l_suppkey").agg(F.sum("l_quantity").cast("bigint").alias("q")), "owned")

    # Positions: the labels of each run in key order.
    def placed(key: str, name: str) -> DataFrame:
        return ordinal(owned.select("part", key).distinct(), ["part"], key, name)

    cells, genes = placed("l_suppkey", "c"), placed("l_partkey", "g")
    named = genes.join(table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    barcodes = cells.select("part", F.col("c").alias("at"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("value"))
    symbols = named.select("part", F.col("g").alias("at"), F.col("p_name").alias("value"))

    entries = materialise(owned.join(cells, ["part", "l_suppkey"]).join(genes, ["part", "l_partkey"]).select("part", "g", "c", "q"), "placed")
    body = entries.select(
        "part", F.lit(2).alias("at"), F.concat_ws(" ", (F.col("g") + 1).cast("string"), (F.col("c") + 1).cast("string"), F.col("q").cast("string")).alias("value")
    )
    sizes = entries.groupBy("part").agg(F.max("g").alias("g"), F.max("c").alias("c"), F.count("*").alias("n")).select(
        "part", F.lit(1).alias("at"), F.concat_ws(" ", (F.col("g") + 1).cast("string"), (F.col("c") + 1).cast("string"), F.col("n").cast("string")).alias("value")
    )
    comment = sizes.select("part", F.lit(0).alias("at"), F.lit("%%MatrixMarket matrix coordinate integer general").alias("value"))
    if faults:
        kind = F.col("part").cast("int") % 4
        runs = sizes.select("part", "at")
        broken = runs.filter(kind == 1).select("part", F.lit(3).alias("at"), F.explode(F.array(F.lit("x 1 1"), F.lit("7"))).alias("value"))
        body = body.union(broken)
        blank = runs.filter(kind == 2).select("part", F.lit(0).cast("bigint").alias("at"), F.lit("").alias("value"))
        extra = runs.filter(kind == 3).select("part", F.lit(1 << 40).cast("bigint").alias("at"), F.lit("none").alias("value"))
        barcodes = barcodes.filter(kind != 2).union(blank).union(extra)
    return {"matrix": body.union(sizes).union(comment), "barcodes": barcodes, "genes": symbols}


def _supplier_files(spark: SparkSession, folder: str, run: int, faults: bool = False) -> DataFrame:
    lines = supplier_lines(spark, folder, run, faults)
    matrix, barcodes, genes = (written_parts(spark, write_lines(lines[r], r, "at"), r) for r in ("matrix", "barcodes", "genes"))
    return matrix.join(barcodes, "sample").join(genes, "sample")


@query(
    MTX_SQL
    + """
    SELECT o.run::VARCHAR AS sample, 'S' || o.supp AS cell_id,
           g.p_name || CASE WHEN g.k > 0 THEN '-' || g.k ELSE '' END AS gene_name, o.q AS value
    FROM owned o JOIN gene_ix g ON g.run = o.run AND g.part = o.part WHERE o.q <> 0
    """
)
def sparse_matrices(spark: SparkSession, folder: str) -> DataFrame:
    return label_matrix(_supplier_matrices(spark, folder))


FAULT_SQL = MTX_SQL.replace("l_suppkey // 50", "l_suppkey // 3")


@query(
    FAULT_SQL
    + """,
    sizes AS (
      SELECT run, count(DISTINCT part) AS g, count(DISTINCT supp) AS c, count(*) AS n, sum(q) AS q FROM owned GROUP BY run
    )
    SELECT run::VARCHAR AS sample, 'entries' AS message, q::BIGINT AS value FROM sizes WHERE run % 4 < 2 AND q <> 0
    UNION ALL SELECT run::VARCHAR, 'not an entry: ' || unnest(['x 1 1', '7']), NULL FROM sizes WHERE run % 4 = 1
    UNION ALL
    SELECT run::VARCHAR, 'the labels do not fit: size line ' || g || ' ' || c || ' ' || n || ', ' ||
           CASE run % 4 WHEN 2 THEN 0 ELSE c + 1 END || ' barcodes, ' || g || ' genes', NULL
    FROM sizes WHERE run % 4 > 1
    """
)
def faulty_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of the entries that could be read, and what is said of the rest."""
    matrix = read_mtx(spark, _supplier_files(spark, folder, 3, faults=True))
    whole = label_matrix(matrix).groupBy("sample").agg(F.sum("value").alias("value"))
    return whole.select("sample", F.lit("entries").alias("message"), "value").unionByName(
        matrix.errors.select("sample", "message", F.lit(None).cast("bigint").alias("value"))
    )


@query(
    MTX_SQL
    + """
    SELECT o.run::VARCHAR AS sample, 'S' || o.supp AS cell_id,
           g.p_name || CASE WHEN g.k > 0 THEN '-' || g.k ELSE '' END AS gene_name, o.q AS value
    FROM owned o JOIN gene_ix g ON g.run = o.run AND g.part = o.part WHERE o.q <> 0
    """
)
def stored_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """Matrices written to the sink's folders and read back, labels too."""
    path = new_table_path(spark, "matrices")
    write_matrix(_supplier_matrices(spark, folder), path)
    entries, cells, genes = (
        spark.read.parquet(f"{path}/{name}").withColumn("sample", F.col("sample").cast("string")) for name in ("entries", "cells", "genes")
    )
    return label_matrix(Matrix(entries, cells, genes, entries.limit(0)))


def _file_names(spark: SparkSession, folder: str) -> DataFrame:
    """Files of an order: named after its lines."""
    items = table(spark, folder, "lineitem")
    suffix = (
        F.when(F.col("l_linenumber") == 1, "_Matrix.mtx.gz").when(F.col("l_linenumber") == 2, "_barcodes.tsv")
        .when(F.col("l_linenumber") == 3, ".RData").when(F.col("l_linenumber") == 4, ".h5")
        .when(F.col("l_linenumber") == 5, ".h5ad").otherwise(".bin")
    )
    stem = F.concat(F.lit("p"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))
    return items.select(F.col("l_orderkey").alias("sample"), F.concat(stem, suffix).alias("name")).distinct()


NAMES_SQL = """
names AS (
  SELECT DISTINCT l_orderkey AS sample, 'p' || lpad(l_partkey::VARCHAR, 9, '0') ||
    CASE l_linenumber WHEN 1 THEN '_Matrix.mtx.gz' WHEN 2 THEN '_barcodes.tsv' WHEN 3 THEN '.RData'
                      WHEN 4 THEN '.h5' WHEN 5 THEN '.h5ad' ELSE '.bin' END AS name
  FROM lineitem
),
typed AS (
  SELECT *, CASE WHEN name LIKE '%.h5ad' THEN 'H5AD' WHEN name LIKE '%.h5' THEN 'H5' WHEN name LIKE '%.RData' THEN 'RDATA'
                 WHEN name LIKE '%.tsv' THEN 'TABLE' WHEN name LIKE '%mtx%' THEN 'MTX' END AS t FROM names
)
"""


@query(
    f"""
    WITH {NAMES_SQL},
    latest AS (SELECT sample, max_by(t, name) FILTER (WHERE t IS NOT NULL) AS t, bool_or(t = 'MTX') AS mtx FROM typed GROUP BY sample)
    SELECT sample, CASE WHEN t = 'TABLE' AND mtx THEN 'MTX' ELSE coalesce(t, 'UNKNOWN') END AS file_type FROM latest
    """
)
def file_types(spark: SparkSession, folder: str) -> DataFrame:
    return sample_type(_file_names(spark, folder))


@query(f"WITH {NAMES_SQL} SELECT sample, coalesce(max_by(t, name) FILTER (WHERE t IS NOT NULL), 'UNKNOWN') AS file_type FROM typed GROUP BY sample")
def file_types_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    return sample_type(_file_names(spark, folder), last_wins=True)


@query(
    f"""
    WITH {NAMES_SQL},
    numbered AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY name) AS i FROM names)
    SELECT sample, string_agg('File ' || i || E': `' || name || E'`\\n```\\nfirst\\nsecond\\n[Total ' || length(name) || E' lines]\\n```', E'\\n' ORDER BY i) AS context
    FROM numbered GROUP BY sample
    """
)
def file_contexts(spark: SparkSession, folder: str) -> DataFrame:
    files = _file_names(spark, folder)
    return file_context(files.select("*", F.array(F.lit("first"), F.lit("second")).alias("lines"), F.length("name").alias("total")))


FAMILY = 500


def _family_files(spark: SparkSession, folder: str) -> str:
    """Documents as SOFT family files: per source and run of document ids one file."""
    attr = document_attr(spark, folder)
    number = F.regexp_replace("accession", "^D", "").cast("bigint")
    docs = table(spark, folder, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("accession"),
        F.concat_ws("-", "source", F.floor(F.col("doc_id") / FAMILY).cast("string")).alias("part"),
        "source",
    )
    line = F.concat(F.lit("!"), F.initcap("kind"), F.lit("_"), F.col("key"), F.lit(" = "), F.col("value"))
    samples = attr.filter("kind = 'SAMPLE'").join(docs.select("accession", "part"), "accession")
    series = attr.filter("kind = 'SERIES'").join(docs.select(F.col("source").alias("accession"), "part").distinct(), "accession")
    lines = samples.select("part", number.alias("a"), "key_ord", "pos", line.alias("value")).unionByName(
        series.select("part", F.lit(-1).cast("bigint").alias("a"), "key_ord", "pos", line.alias("value"))
    )
    heads = docs.select(
        "part", F.regexp_replace("accession", "^D", "").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("key_ord"),
        F.lit(0).cast("bigint").alias("pos"), F.concat(F.lit("^SAMPLE = "), F.col("accession")).alias("value"),
    ).unionByName(
        docs.select("part", "source").distinct().select(
            "part", F.lit(-1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("key_ord"),
            F.lit(0).cast("bigint").alias("pos"), F.concat(F.lit("^SERIES = "), F.col("source")).alias("value"),
        )
    )
    return write_lines(lines.unionByName(heads), "soft", "a", "key_ord", "pos")


@query(
    f"""
    WITH {ATTR_SQL}
    SELECT kind, accession, key, pos, value FROM attr WHERE kind = 'SAMPLE'
    UNION ALL
    SELECT a.kind, a.accession, a.key, a.pos, a.value FROM attr a
    JOIN (SELECT DISTINCT source, doc_id // {FAMILY} AS part FROM documents) f ON f.source = a.accession WHERE a.kind = 'SERIES'
    """
)
def soft_attributes(spark: SparkSession, folder: str) -> DataFrame:
    return read_soft(spark, _family_files(spark, folder)).attr.select("kind", "accession", "key", "pos", "value")


@query(
    f"""
    WITH {ATTR_SQL},
    files AS (SELECT doc_id, source, source || '-' || doc_id // {FAMILY} AS part FROM documents),
    lines AS (
      SELECT f.part, f.doc_id AS a, a.key_ord, a.pos, '!Sample_' || a.key || ' = ' || a.value AS line
      FROM attr a JOIN files f ON a.accession = 'D' || f.doc_id
      UNION ALL SELECT part, doc_id, 0, 0, '^SAMPLE = D' || doc_id FROM files
      UNION ALL SELECT f.part, -1, a.key_ord, a.pos, '!Series_' || a.key || ' = ' || a.value
      FROM attr a JOIN (SELECT DISTINCT part, source FROM files) f ON a.accession = f.source AND a.kind = 'SERIES'
      UNION ALL SELECT DISTINCT part, -1, 0, 0, '^SERIES = ' || source FROM files
    ),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY part ORDER BY a, key_ord, pos) AS i, count(*) OVER (PARTITION BY part) AS total FROM lines
    )
    SELECT part, any_value(total) AS total,
           string_agg(CASE WHEN length(line) > 100 THEN substr(line, 1, 100) || '... [' || (length(line) - 100) || ' characters truncated]' ELSE line END,
                      E'\\n' ORDER BY i) AS peek
    FROM numbered WHERE i <= 10 GROUP BY part
    """
)
def file_peeks(spark: SparkSession, folder: str) -> DataFrame:
    path = _family_files(spark, folder)
    peeks = peek_files(spark, f"{path}/part=*/*.txt")
    return peeks.select(
        F.regexp_extract("file", r"part=([^/]+)/", 1).alias("part"), "total", F.array_join("lines", "\n").alias("peek")
    )
