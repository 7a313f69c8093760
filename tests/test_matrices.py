import json

import pytest
from pyspark.sql import functions as F

from fixtures import gz
from samplelake.plans.count_matrix import load_matrices, propose_specs
from samplelake.sinks.tables import write_matrix
from samplelake.sources.matrices import label_matrix, read_dense_matrix, read_mtx
from samplelake.sources.supplementary import base_name, peek_files

HEAD = "%%MatrixMarket matrix coordinate integer general\n% made up\n"
ENTRIES = {(1, 1): 5, (2, 1): 0, (4, 2): 7, (3, 3): 1, (4, 3): 6}  # (gene, cell), 4 genes, 3 cells
GENES, CELLS = ["A", "A", "A-1", "B"], ["c1", "c2", "c3"]
WANT = sorted((c, g, v) for (i, j), v in ENTRIES.items() if v for g, c in [(["A", "A-2", "A-1", "B"][i - 1], CELLS[j - 1])])


def mtx(turned):
    lines = [f"{j} {i} {v}" if turned else f"{i} {j} {v}" for (i, j), v in ENTRIES.items()]
    return HEAD + ("3 4 5\n" if turned else "4 3 5\n") + "\n".join(lines) + "\n"


def labelled(matrix, sample=None):
    rows = label_matrix(matrix)
    if sample:
        rows = rows.filter(F.col("sample") == sample)
    return sorted((r["cell_id"], r["gene_name"], r["value"]) for r in rows.collect())


def test_mtx_both_ways_round(spark, tmp_path):
    for name, turned in (("s1", False), ("s2", True)):
        (tmp_path / f"{name}.mtx.gz").write_bytes(gz(mtx(turned)))
        (tmp_path / f"{name}.barcodes.tsv").write_text("\n".join(CELLS) + "\n")
        (tmp_path / f"{name}.genes.tsv").write_text("".join(f"{g}\tGene\n" for g in GENES))
    files = spark.createDataFrame([(s, *(str(tmp_path / f"{s}.{e}") for e in ("mtx.gz", "barcodes.tsv", "genes.tsv"))) for s in ("s1", "s2")],
                                  "sample string, matrix string, barcodes string, genes string")
    matrix = read_mtx(spark, files)
    assert labelled(matrix, "s1") == labelled(matrix, "s2") == WANT
    assert matrix.errors.count() == 0
    write_matrix(matrix, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "entries")).filter("sample = 's1'").count() == len(WANT)
    assert spark.read.parquet(str(tmp_path / "out" / "genes")).count() == 8


def test_an_entry_may_look_like_the_size_line(spark, tmp_path):
    (tmp_path / "m.mtx").write_text(HEAD + "1 1 1\n1 1 1\n")
    (tmp_path / "b.tsv").write_text("c\n")
    (tmp_path / "g.tsv").write_text("g\n")
    files = spark.createDataFrame([("s", str(tmp_path / "m.mtx"), str(tmp_path / "b.tsv"), str(tmp_path / "g.tsv"))],
                                  "sample string, matrix string, barcodes string, genes string")
    assert labelled(read_mtx(spark, files)) == [("c", "g", 1)]
    (tmp_path / "n.mtx").write_text(HEAD + "1 1 1\n1 1 x\n")
    files = files.withColumn("matrix", F.lit(str(tmp_path / "n.mtx")))
    broken = read_mtx(spark, files)
    assert labelled(broken) == [] and [r["message"] for r in broken.errors.collect()] == ["not a number: x"]


DENSE = 'id,"g1",g2,batch,g3\nr1,3.7,0,1,-1.9\nr2,x,2,9,0\nr1,0,0,9,4\nnote,1,1,1,1\n'
DENSE_WANT = [("r1", "g1", 3), ("r1", "g3", -1), ("r1-1", "g3", 4), ("r2", "g2", 2)]


@pytest.mark.parametrize("header", ["id,", ""])
def test_dense_both_ways_round(spark, tmp_path, header):
    (tmp_path / "a.csv").write_text(DENSE.replace("id,", header, 1))
    columns = list(zip(*(line.split(",") for line in DENSE.replace('"', "").splitlines())))
    (tmp_path / "b.tsv").write_text("\n".join("\t".join(c) for c in columns) + "\n")
    drop = ["batch", "note"]
    spec = spark.createDataFrame([("a", str(tmp_path / "a.csv"), ",", True, drop), ("b", str(tmp_path / "b.tsv"), "\t", False, drop)],
                                 "sample string, path string, sep string, cell_by_gene boolean, drop array<string>")
    matrix = read_dense_matrix(spark, spec)
    assert labelled(matrix, "a") == labelled(matrix, "b") == DENSE_WANT
    assert sorted((r["sample"], r["message"]) for r in matrix.errors.collect()) == [("a", "not a number: x"), ("b", "not a number: x")]


def test_samples_from_proposed_specs(spark, tmp_path):
    for name, content in {
        "s1_matrix.mtx": mtx(False), "s1_barcodes.tsv": "\n".join(CELLS), "s1_genes.tsv": "\n".join(GENES),
        "s2_counts.csv": DENSE, "s3.rdata": "z", "s4.bin": "z", "s5.csv": "a,b\n",
    }.items():
        (tmp_path / name).write_text(content)
    peeks = peek_files(spark, str(tmp_path))
    name = base_name(F.col("file"))
    supp = peeks.select(F.regexp_extract(name, r"^(s\d)", 1).alias("sample"), F.col("file").alias("path"), name.alias("name"), "lines", "total").cache()

    def model(prompt):
        if "s1_matrix" in prompt:
            return json.dumps({"file_type": "MTX", "matrix": "s1_matrix.mtx", "barcodes": "s1_barcodes.tsv", "genes": "s1_genes.tsv"})
        if "s2_counts" in prompt:
            return json.dumps({"file_type": "TABLE", "matrix": "s2_counts.csv", "sep": ",", "cell_by_gene": True, "drop": ["batch", "note"]})
        return "{}"

    loaded = load_matrices(spark, supp, propose_specs(supp, model))
    assert labelled(loaded.matrices["MTX"]) == WANT and labelled(loaded.matrices["TABLE"]) == DENSE_WANT
    errors = {r["sample"]: r["message"] for r in loaded.errors.filter("message NOT LIKE 'not a number%'").collect()}
    assert errors == {"s3": "no reader for file type RDATA", "s4": "no reader for file type UNKNOWN", "s5": "the specification is not complete"}


def test_faulty_dense_tables_do_not_touch_others(spark, tmp_path):
    folder = tmp_path / "50% of it"
    folder.mkdir()
    contents = {
        "good": 'id,"g,1",g2\n"a,b",5,6\n"say ""x""",1,2\n', "uneven": "id,g1,g2\nr1,1,2\nr2,3\nr3,4,5,6\nr4,7,8\n",
        "misfit": "id,g1,g2,g3,g4\nr1,1\n", "empty": "", "short": "id,g1,g2\nr0,9\nr1,1,2\nr2,3,4\n", "long": "g1,g2\nr0,9,9,9\nr1,1,2\n\nr2,3,4\n",
        "breaks": 'id,"g\n1",g2\n"a\n\nb",5,"6"\nr"2,7,"8\n"\n"c\nd","1\n0",11\nr3,12,13\n',
        "stray": 'id,g1,g2\n"r1,1,2\nr2,3,4\nr3,5,6\n',
    }
    for name, content in contents.items():
        (folder / f"{name}.csv").write_text(content)
    paths = {n: str(folder / f"{n}.csv") for n in contents} | {"none": str(folder / "none.csv"), "cut": str(folder / "cut.csv.gz")}
    (folder / "cut.csv.gz").write_bytes(gz("id,g1\n" + "".join(f"r{i},{i}\n" for i in range(9999)))[:-20])
    spec = spark.createDataFrame([(n, p, ",", True, None) for n, p in paths.items()],
                                 "sample string, path string, sep string, cell_by_gene boolean, drop array<string>")
    matrix = read_dense_matrix(spark, spec)
    assert labelled(matrix, "good") == [("a,b", "g,1", 5), ("a,b", "g2", 6), ('say "x"', "g,1", 1), ('say "x"', "g2", 2)]
    assert labelled(matrix, "uneven") == [("r1", "g1", 1), ("r1", "g2", 2), ("r4", "g1", 7), ("r4", "g2", 8)]
    assert labelled(matrix, "short") == labelled(matrix, "long") == [("r1", "g1", 1), ("r1", "g2", 2), ("r2", "g1", 3), ("r2", "g2", 4)]
    assert labelled(matrix, "breaks") == [
        ("a\n\nb", "g\n1", 5), ("a\n\nb", "g2", 6), ("c\nd", "g2", 11), ('r"2', "g\n1", 7), ('r"2', "g2", 8), ("r3", "g\n1", 12), ("r3", "g2", 13),
    ]
    assert labelled(matrix, "stray") == [('"r1', "g1", 1), ('"r1', "g2", 2), ("r2", "g1", 3), ("r2", "g2", 4), ("r3", "g1", 5), ("r3", "g2", 6)]
    errors = sorted((r["sample"], r["message"].split(": file:")[0].split(": /")[0]) for r in matrix.errors.collect())
    assert errors == [
        ("breaks", "not a number: 1\n0"),
        ("cut", "not read: EOFError: the compressed file ends early"),
        ("empty", "the header does not fit: 0 names, 0 fields in most lines"),
        ("long", "line 2 has 4 fields, not 3"), ("misfit", "the header does not fit: 5 names, 2 fields in most lines"),
        ("none", "not read: [PATH_NOT_FOUND] Path does not exist"), ("short", "line 2 has 2 fields, not 3"),
        ("uneven", "line 3 has 2 fields, not 3"), ("uneven", "line 4 has 4 fields, not 3"),
    ]


def test_a_missing_or_cut_label_file_costs_its_sample_only(spark, tmp_path):
    (tmp_path / "m.mtx").write_text(HEAD + "1 1 1\n1 1 4\n")
    (tmp_path / "b.tsv").write_text("c\n")
    (tmp_path / "cut.gz").write_bytes(gz("c\n" * 9999)[:30])
    rows = [(s, str(tmp_path / "m.mtx"), str(tmp_path / b), str(tmp_path / "b.tsv")) for s, b in (("a", "b.tsv"), ("b", "none.tsv"), ("c", "cut.gz"))]
    matrix = read_mtx(spark, spark.createDataFrame(rows, "sample string, matrix string, barcodes string, genes string"))
    assert [(r["sample"], r["value"]) for r in label_matrix(matrix).collect()] == [("a", 4)]
    assert sorted((r["sample"], r["message"].split(":")[0]) for r in matrix.errors.collect()) == [("b", "not read"), ("c", "not read")]
