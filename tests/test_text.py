import random

from pyspark.sql import functions as F

from samplelake.functions.filetypes import file_type
from samplelake.functions.text import clean_summary, cut_line, format_key, text_lines, word_count
from samplelake.operators.chunks import pack_chunks


def packed(text, limit):
    """Greedy packing, spelled out."""
    import re

    parts = [p.strip() for p in re.split(r"\s*\n\s*\n\s*", text)]
    parts = [p for p in parts if p]
    chunks, current = [], []
    for part in parts:
        current.append(part)
        if limit is None or sum(len(p.split()) for p in current) > limit:
            chunks.append(current)
            current = []
    if current:
        chunks.append(current)
    return [("\n\n".join(c), sum(len(p.split()) for p in c)) for c in chunks]


def random_paper(rng):
    words = ["cell", "gene", "was", "é", "filtered.", "x"]
    paragraphs = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 7, 20]))) for _ in range(rng.randint(0, 12))]
    return rng.choice(["", "\n", "  "]) + rng.choice(["\n\n", "\n \n", "\n\n\n  "]).join(paragraphs) + rng.choice(["", "\n\n"])


def test_chunks_equal_a_plain_loop(spark):
    rng = random.Random(7)
    papers = [(i, random_paper(rng)) for i in range(150)]
    docs = spark.createDataFrame(papers, "doc_id int, text string")
    for limit in (0, 5, 12, 1000, None):
        got = {}
        for r in pack_chunks(docs, min_words=limit).orderBy("doc_id", "chunk_no").collect():
            got.setdefault(r["doc_id"], []).append((r["text"], r["n_words"]))
        assert got == {i: packed(t, limit) for i, t in papers if packed(t, limit)}


def test_only_a_last_chunk_is_short(spark):
    docs = spark.createDataFrame([(1, "a b c\n\nd e\n\nf g h i\n\nj")], "doc_id int, text string")
    got = [(r["chunk_no"], r["n_words"]) for r in pack_chunks(docs, min_words=5).collect()]
    # 5 words are not more than 5
    assert got == [(0, 9), (1, 1)]


def test_chunks_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a b\n\nc d")], "doc_id int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id int, text string").parquet(str(tmp_path / "in"))
    query = (
        pack_chunks(stream, min_words=1).writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    assert query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_small_columns(spark):
    row = spark.range(1).select(
        cut_line(F.lit("x" * 100)).alias("whole"),
        cut_line(F.lit("y" * 103)).alias("cut"),
        format_key(F.lit("Sample Count")).alias("key"),
        clean_summary(F.lit("(Submitter supplied) A study. more... Organism: mouse Organism")).alias("summary"),
        F.size(text_lines(F.lit("a\nb\n"))).alias("two"),
        F.size(text_lines(F.lit(""))).alias("none"),
        F.size(text_lines(F.lit("a\n\n"))).alias("blank"),
        word_count(F.lit("  a  b\tc ")).alias("words"),
        word_count(F.lit(" ")).alias("no_words"),
    ).first()
    assert row["whole"] == "x" * 100
    assert row["cut"] == "y" * 100 + "... [3 characters truncated]"
    assert (row["key"], row["summary"]) == ("sample_count", "A study.")
    assert (row["two"], row["none"], row["blank"], row["words"], row["no_words"]) == (2, 0, 2, 3, 0)


def test_file_types(spark):
    names = {
        "a.CSV": "TABLE", "b.tsv.gz": "TABLE", "x_matrix.mtx.gz": "MTX", "m.mtx.txt": "TABLE", "o.RData": "RDATA",
        "d.h5": "H5", "d.h5.gz": "H5", "d.h5ad": "H5AD", "e.bin": "UNKNOWN", "h5": "UNKNOWN", "counts.txt.h5": "H5",
    }
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", file_type(F.col("name")).alias("t"))
    assert {r["name"]: r["t"] for r in df.collect()} == names
