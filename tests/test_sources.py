from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fixtures import ALONE, FAMILY, LOST, RESULTS, gz, tar_bytes
from samplelake.operators.attrs import check_prefix, context_lines, long_lines, pair_series, ref_context, sample_text
from samplelake.queries import files as file_queries
from samplelake.sources import files as files_module
from samplelake.sources.papers import TASK, check_tasks, default_tasks, read_papers, read_tasks
from samplelake.sources.records import extract_records
from samplelake.sources.files import BLOCK_LINES, PIECE, read_files
from samplelake.sources.soft import read_path_list, read_soft
from samplelake.sources.supplementary import base_name, one_per_name, peek_files, sample_type, with_members


def write(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, content in files.items():
        path = folder / name.replace("__", ".")
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def attributes(soft):
    keep = soft.attr.filter("kind IN ('SAMPLE', 'SERIES')")
    return sorted((r["accession"], r["key"], r["pos"], r["value"]) for r in keep.collect())


def expected(text):
    entity, seen, out = None, {}, []
    for line in text.splitlines():
        if line.startswith("^"):
            entity = line.split(" = ")[1]
            seen = {}
        elif line.startswith("!") and "_table_" not in line:
            key, _, value = line.split("_", 1)[1].partition("=")
            key = key.strip()
            out.append((entity, key, seen.get(key, 0), value.strip()))
            seen[key] = seen.get(key, 0) + 1
    return sorted(r for r in out if r[0].startswith(("GSM", "GSE")))


def test_soft_plain_and_gzip(spark, tmp_path):
    plain = read_soft(spark, write(tmp_path / "p", family__soft=FAMILY))
    zipped = read_soft(spark, write(tmp_path / "z", family__soft__gz=gz(FAMILY)))
    assert attributes(plain) == attributes(zipped) == expected(FAMILY)
    order = [r["accession"] for r in plain.entity.orderBy("ord").collect()]
    assert order == ["Archive", "GSE1", "GPL1", "GSM1", "GSM2", "GSM3", "GSE2", "GSM4", "GSM5", "GSM6"]
    assert plain.errors.count() == zipped.errors.count() == 0


def test_soft_file_in_many_blocks(spark, tmp_path):
    folder = write(tmp_path, family__soft=FAMILY)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        soft = read_soft(spark, folder)
        assert attributes(soft) == expected(FAMILY)
        assert soft.entity.count() == 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_truncated_file_is_an_error_row(spark, tmp_path):
    whole = gz(FAMILY)
    folder = write(tmp_path, good__soft=ALONE, bad__soft__gz=whole[: len(whole) // 2], odd__soft="^PLATFORM = GPL1\n!Platform_title = x\n")
    soft = read_soft(spark, folder)
    assert {r["accession"] for r in soft.entity.filter("kind = 'SAMPLE'").collect()} == {"GSM9"}
    errors = {r["file"].rsplit("/", 1)[1]: r["stage"] for r in soft.errors.collect()}
    assert errors == {"bad.soft.gz": "read", "odd.soft": "parse"}
    only_bad = read_soft(spark, str(tmp_path / "bad.soft.gz"))
    assert only_bad.attr.count() == 0 and only_bad.errors.count() == 1


def test_gzip_files_are_read_in_many_blocks(spark, tmp_path):
    many = "".join(f"line {i}\n" for i in range(3 * BLOCK_LINES))
    whole = gz("".join(f"{i:x}" * 40 + "\n" for i in range(40_000)))
    folder = write(
        tmp_path, two__gz=gz("a\n") + gz("b\n"), empty__gz=gz(""), many__gz=gz(many), cut__gz=whole[: len(whole) - 9],
        tail__gz=gz("x\n") + b"\n", odd__gz=b"no gzip", ends__gz=gz("a\r\nb\rc\n\nlast"),
    )
    files = read_files(spark, folder)
    named = {r["file"].rsplit("/", 1)[1]: (r["n_lines"], r["n_full"]) for r in files.files.collect()}
    assert named == {"two.gz": (2, 2), "empty.gz": (0, 0), "many.gz": (3 * BLOCK_LINES,) * 2, "tail.gz": (1, 1), "ends.gz": (5, 4)}
    assert sorted(r["file"].rsplit("/", 1)[1] for r in files.errors.collect()) == ["cut.gz", "odd.gz"]
    rows = files.lines.filter(F.col("file").endswith("many.gz"))
    assert rows.select("block").distinct().count() >= 3 and rows.filter("value <> concat('line ', n) OR n <> full").count() == 0
    ends = files.lines.filter(F.col("file").endswith("ends.gz")).orderBy("n")
    assert [(r["value"], r["full"]) for r in ends.collect()] == [("a", 0), ("b", 1), ("c", 2), ("", 3), ("last", 3)]
    # One pass over the compressed bytes; lines are not shuffled.
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "Exchange hashpartitioning" not in plan


def test_lines_in_pieces():
    from samplelake.sources.files import _lines, inflated

    text = b"one\r\ntwo\rthree\n\n\rlast"
    for size in (1, 2, 3, 7, 100):
        pieces = [text[i : i + size] for i in range(0, len(text), size)]
        assert [x for some in _lines(pieces) for x in some] == text.splitlines()
    data = gz("x" * 100_000) + gz("y" * 10)
    for size in (1, 1000, PIECE):
        assert b"".join(inflated(data[i : i + size] for i in range(0, len(data), size))) == b"x" * 100_000 + b"y" * 10


def test_blocks_of_plain_files_are_numbered(spark, tmp_path):
    folder = write(tmp_path / "a [b] 50%", **{"many__txt": "".join(f"{i}\n" if i % 3 else " \n" for i in range(5000)), "none__txt": ""})
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        files = read_files(spark, folder.replace("[", "\\[").replace("]", "\\]"))
        rows = files.lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({r["block"] for r in rows}) > 5 and sorted(r["n"] for r in rows) == list(range(5000))
    assert all(r["value"] == (str(r["n"]) if r["n"] % 3 else " ") and r["full"] == r["n"] - (r["n"] + 2) // 3 for r in rows)
    assert sorted((r["n_lines"], r["n_full"]) for r in files.files.collect()) == [(0, 0), (5000, 3333)]


def test_paths_that_are_not_there_do_not_stop_others(spark, tmp_path):
    folder = write(tmp_path, a__soft=FAMILY, b__soft=ALONE)
    lists = write(tmp_path / "lists", l__txt=f"{folder}/a.soft\n{folder}/none.soft\n \n{folder}/b.soft\nodd://x/y.soft\n{folder}/z*.soft\n")
    soft = read_soft(spark, read_path_list(spark, lists))
    assert attributes(soft) == sorted(expected(FAMILY) + expected(ALONE))
    errors = {r["file"].rsplit("/", 1)[-1]: (r["stage"], r["message"]) for r in soft.errors.collect()}
    assert set(errors) == {"none.soft", "y.soft", "z*.soft"} and {stage for stage, _ in errors.values()} == {"list"}
    assert "does not exist" in errors["none.soft"][1]
    batched = read_files(spark, read_path_list(spark, lists), batch=1)
    assert batched.files.count() == 2 and batched.errors.count() == 3
    nothing = read_soft(spark, [f"{folder}/none.soft"])
    assert nothing.attr.count() == nothing.entity.count() == 0 and nothing.errors.count() == 1


def test_paths_that_are_not_there_are_told_at_once(spark, tmp_path, monkeypatch):
    folder = write(tmp_path / "a, b 50%", a__soft=ALONE, _hidden__soft=ALONE)
    (tmp_path / "empty").mkdir()
    lost = [f"{folder}/none{i}.soft" for i in range(100)] + [f"file:{folder}//x.soft", f"{folder}/$y.soft", f"{folder}/_z.soft", "odd://x/y"]
    paths = [path for some in zip([f"{folder}/a.soft"] * len(lost), lost) for path in some]
    paths += [f"{folder}/_hidden.soft", f"{tmp_path}/empty", f"file:{folder}/a.soft", f"{folder}/q*"]
    alone = [row for path in [*lost, f"{folder}/q*"] for row in files_module._listed(spark, [path])[1]]
    loads, loaded = [], files_module._loaded
    monkeypatch.setattr(files_module, "_loaded", lambda *given: loads.append(1) or loaded(*given))
    found, bad = files_module._listed(spark, list(dict.fromkeys(paths)))
    assert [name.rsplit("/", 1)[1] for name in found] == ["a.soft"] and sorted(bad) == sorted(alone) and len(bad) == len(lost) + 1
    # A load for each path that is not there took 200 of them and more.
    assert len(loads) < 40


def test_files_are_written_under_their_names(spark, monkeypatch):
    contents = {f"f{i}.gz": gz(f"{i}\n" * i) for i in range(20)}
    files = spark.createDataFrame(list(contents.items()), "name string, content binary")

    def written():
        folder = Path(file_queries._local_folder(spark, file_queries._write_named(files, "named")))
        return {name: (folder / name).read_bytes() for name in contents}

    renamed, listed = [], file_queries.listed_paths
    monkeypatch.setattr(file_queries, "listed_paths", lambda *given: renamed.append(1) or listed(*given))
    in_place = written()
    assert not renamed and in_place == {name: content + b"\n" for name, content in contents.items()}
    local = file_queries._local_folder
    monkeypatch.setattr(file_queries, "_local_folder", lambda spark, path: None)
    path = file_queries._write_named(files, "named")
    assert renamed and {name: (Path(local(spark, path)) / name).read_bytes() for name in contents} == in_place


def test_path_list(spark, tmp_path):
    folder = write(tmp_path, paths__txt=" /a/b.soft \n\n/c.soft.gz\n")
    assert sorted(r["path"] for r in read_path_list(spark, folder).collect()) == ["/a/b.soft", "/c.soft.gz"]


@pytest.fixture
def soft(spark, tmp_path):
    return read_soft(spark, write(tmp_path, family__soft=FAMILY, alone__soft=ALONE, lost__soft=LOST))


def test_pairs(soft):
    pairs = {r["sample"]: r["series"] for r in pair_series(soft.attr, soft.entity).collect()}
    assert pairs == {
        "GSM1": "GSE1", "GSM2": "GSE1", "GSM3": "GSE1", "GSM4": "GSE2", "GSM5": "GSE2", "GSM6": "GSE2", "GSM9": "GSE2", "GSM8": None,
    }


def test_sample_text_and_context(soft):
    texts = {r["accession"]: r["raw_metadata"] for r in sample_text(soft.attr).withColumnRenamed("sample", "accession").collect()}
    assert texts["GSM1"].split("\n") == [
        "!Sample_title = one", "!Sample_type = RNA", "!Sample_series_id = GSE1", "!Sample_series_id = GSE2", "!Sample_platform_id = GPL1",
        "!Sample_characteristics_ch1 = tissue: lung", "!Sample_characteristics_ch1 = age: 3 = old",
    ]
    dropped = long_lines(soft.attr).collect()
    assert [(r["accession"], r["stage"]) for r in dropped] == [("GSM1", "context")]
    pair = pair_series(soft.attr, soft.entity)
    contexts = {r["sample"]: r["context"] for r in context_lines(soft.attr, pair).collect()}
    assert contexts["GSM2"].endswith(
        "!Sample_relation = r2\n!Series_title = First study\n!Series_overall_design = two arms\n!Series_supplementary_file = a.tar;b.tar"
    )
    assert contexts["GSM9"].endswith("!Sample_series_id = GSE1\n!Series_title = Second study")
    assert contexts["GSM8"] == "!Sample_title = eight\n!Sample_series_id = GSE99"


def test_ref_context(soft):
    pair = pair_series(soft.attr, soft.entity)
    found = ref_context(soft.attr, pair, ["Series_title", "Sample_ch1", "Sample_id", "Other_x"])
    contexts = {r["sample"]: r["context"] for r in found.collect()}
    assert contexts["GSM1"].split("\n") == [
        "Series_title = First study", "Sample_ch1 = tissue: lung;age: 3 = old", "Sample_id = GSE1;GSE2", "Sample_id = GPL1",
    ]
    assert "GSM8" in contexts and contexts["GSM4"] == "Series_title = Second study"


def test_prefix(spark):
    good, bad = check_prefix(spark.createDataFrame([("GSM1",), ("GSE1",), (None,)], "sample string"))
    assert [r["sample"] for r in good.collect()] == ["GSM1"] and bad.count() == 2


def test_peeks(spark, tmp_path):
    long_line = "v" * 130
    folder = write(tmp_path, a__csv="h\n" + "".join(f"{i}\n" for i in range(20)), b__tsv__gz=gz(f"{long_line}\nx"), c__txt="")
    peeks = {r["file"].rsplit("/", 1)[1]: (r["lines"], r["total"]) for r in peek_files(spark, folder).collect()}
    assert peeks["a.csv"] == (["h"] + [str(i) for i in range(9)], 21)
    assert peeks["b.tsv.gz"] == (["v" * 100 + "... [30 characters truncated]", "x"], 2)
    assert peeks["c.txt"] == ([], 0)


@pytest.mark.parametrize("mode,name", [("w", "bundle.tar"), ("w:gz", "bundle.tar.gz"), ("w:gz", "bundle.tgz")])
def test_archives(spark, tmp_path, mode, name):
    cut = gz("".join(f"{i}\n" for i in range(9000)))
    members = [("top.csv", b"a,b\n1,2\n"), ("deep", None), ("deep/in.txt.gz", gz("l1\nl2\n")), ("bad.gz", cut[:2000]), ("deep/top.csv", b"later\n")]
    (tmp_path / name).write_bytes(tar_bytes(members, mode))
    peeks = {r["file"].split("!/")[1]: (r["lines"], r["total"]) for r in peek_files(spark, str(tmp_path / name)).collect()}
    assert peeks == {"top.csv": (["a,b", "1,2"], 2), "deep/in.txt.gz": (["l1", "l2"], 2), "deep/top.csv": (["later"], 1)}
    files = read_files(spark, str(tmp_path / name))
    assert [r["file"].split("!/")[1] for r in files.errors.collect()] == ["bad.gz"]
    supp = spark.createDataFrame([("s", name, str(tmp_path / name)), ("s", "own.txt", "/x/own.txt")], "sample string, name string, path string")
    found = with_members(supp, files)
    assert sorted(r["name"] for r in found.collect()) == ["in.txt.gz", "own.txt", "top.csv", "top.csv"]
    single, odd = one_per_name(found, files)
    assert sorted(r["name"] for r in single.collect()) == ["in.txt.gz", "own.txt"]
    assert [r["message"] for r in odd.collect()] == ["files of one name differ: top.csv"]


def test_one_file_per_name(spark, tmp_path):
    for folder, contents in {"a": ("same", "one"), "b": ("same", "two"), "c": ("same", "one")}.items():
        write(tmp_path / folder, x__txt=contents[0], y__txt=contents[1])
    rows = [("s", f"{n}.txt", str(tmp_path / f / f"{n}.txt")) for f in "abc" for n in "xy"] + [("t", "y.txt", str(tmp_path / "a" / "y.txt"))]
    rows += rows[:1]
    supp = spark.createDataFrame(rows, "sample string, name string, path string")
    single, odd = one_per_name(supp, read_files(spark, supp.select("path")))
    assert sorted((r["sample"], r["name"], r["path"][-7:]) for r in single.collect()) == [("s", "x.txt", "a/x.txt"), ("t", "y.txt", "a/y.txt")]
    assert [tuple(r) for r in odd.collect()] == [("s", "files of one name differ: y.txt")]


def test_a_cut_archive_does_not_stop_others(spark, tmp_path):
    members = [(f"{n}.txt", f"{n}\n".encode() * 9000) for n in "ab"]
    (tmp_path / "good.tar").write_bytes(tar_bytes(members))
    (tmp_path / "cut.tar").write_bytes(tar_bytes(members)[:30_000])
    files = read_files(spark, str(tmp_path))
    whole = sorted(r["file"].rsplit("/", 2)[-2:] for r in files.files.collect())
    assert whole == [["cut.tar!", "a.txt"], ["good.tar!", "a.txt"], ["good.tar!", "b.txt"]]
    assert [r["file"].rsplit("/", 1)[-1] for r in files.errors.collect()] == ["cut.tar"]
    assert files.lines.filter(F.col("file").contains("cut.tar")).filter("value <> 'a'").count() == 0


def test_peeks_of_empty_files(spark, tmp_path):
    folder = tmp_path / "a folder"
    folder.mkdir()
    (folder / "none.txt").write_text("")
    (folder / "some.txt").write_text("x\ny\n")
    got = {r["file"].rsplit("/", 1)[-1]: (r["lines"], r["total"]) for r in peek_files(spark, str(folder)).collect()}
    assert got == {"none.txt": ([], 0), "some.txt": (["x", "y"], 2)}


def test_a_deep_page(spark):
    pages = spark.createDataFrame([(1, "<div>" * 3000 + RESULTS), (2, RESULTS)], "page_id bigint, html string")
    counts = {r["page_id"]: r["count"] for r in extract_records(pages).groupBy("page_id").count().collect()}
    assert counts[1] == counts[2] > 0


def test_a_page_that_cannot_be_read_does_not_stop_others(spark):
    from samplelake.sources.records import read_pages

    pages = spark.createDataFrame([(1, "<![x[" + RESULTS), (2, RESULTS), (3, None)], "page_id bigint, html string")
    records, bad = read_pages(pages)
    assert {r["page_id"] for r in records.collect()} == {2} == {r["page_id"] for r in extract_records(pages).collect()}
    assert [(r["page_id"], r["stage"]) for r in bad.collect()] == [(1, "page")]


def test_end_tags_without_an_element_take_no_time(spark):
    import time

    from samplelake.sources.records import RESULT_PAGE, _records

    begun = time.time()
    assert len(_records("<div>" * 40_000 + "</b>" * 40_000 + RESULTS, RESULT_PAGE)) == len(_records(RESULTS, RESULT_PAGE))
    assert time.time() - begun < 3


def test_sample_type(spark):
    supp = spark.createDataFrame(
        [("s1", "m.mtx.gz"), ("s1", "z_barcodes.tsv"), ("s2", "a.csv"), ("s2", "z.bin"), ("s3", "x.bin"), ("s4", "a.csv"), ("s4", "b.rdata")],
        "sample string, name string",
    )
    assert {r[0]: r[1] for r in sample_type(supp).collect()} == {"s1": "MTX", "s2": "TABLE", "s3": "UNKNOWN", "s4": "RDATA"}
    assert {r[0]: r[1] for r in sample_type(supp, last_wins=True).collect()}["s1"] == "TABLE"
    assert spark.range(1).select(base_name(F.lit("/a/b/c.txt"))).first()[0] == "c.txt"


def test_papers_and_tasks(spark, tmp_path):
    folder = write(tmp_path / "papers", one__md="# T\n\nText\n", two__md="x")
    assert sorted(r["text"] for r in read_papers(spark, folder).collect()) == ["# T\n\nText\n", "x"]
    task = '[{"id": 1, "dep": [], "name": "A", "type": "input", "optional": false, "tool_required": false, "metadata": {}}, '
    write(tmp_path, good__json=task + '{"id": 2, "dep": [1], "name": "B", "type": "process", "optional": true, "tool_required": true, "metadata": {}}]')
    assert read_tasks(spark, str(tmp_path / "good.json")).count() == 2
    assert check_tasks(default_tasks(spark)).count() == 23
    bad = [(1, [], "A", "input", False, False, {}), (1, [7], "B", "odd", True, None, {})]
    with pytest.raises(ValueError) as told:
        check_tasks(spark.createDataFrame(bad, TASK))
    for text in ("a field is missing", "unknown type", "id given twice", "dependency not found"):
        assert text in str(told.value)


def test_records(spark):
    pages = spark.createDataFrame([(1, RESULTS), (2, "<p>none</p>"), (3, None)], "page_id int, html string")
    found = extract_records(pages).orderBy("rec_no").collect()
    assert [(r["page_id"], r["rec_no"]) for r in found] == [(1, 0), (1, 1), (1, 2)]
    first, second, third = found
    assert (first["title"], first["summary"]) == ("Lung atlas & more", "We looked at lungs.")
    assert first["details"] == {"organism": "Homo sapiens", "sample_count": "4", "accession": "GSE77"}
    assert first["links"] == {"full_record": "https://www.ncbi.nlm.nih.gov/geo/x?acc=GSE77", "elsewhere": "http://other/y"}
    assert first["url"] == "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=GSE77"
    assert (second["title"], second["summary"], second["details"], second["url"]) == ("No parts", None, {}, None)
    assert (third["title"], third["details"], third["url"]) == ("Third", {"id": "5"}, None)


def test_small_files_are_numbered_together():
    import pyarrow as pa

    from samplelake.sources import files as module

    def batch(rows):
        return pa.RecordBatch.from_pydict({
            "file": pa.array([r[0] for r in rows], pa.string()), "block": pa.array([r[1] for r in rows], pa.int64()),
            "value": pa.array([r[2] for r in rows], pa.string()),
        })

    rows = [(f"f{i // 5}", 0, "" if i % 3 else f"v{i}") for i in range(503)] + [("f100", 9, "x"), ("f100", 9, " "), ("f100", 9, "y")]
    cuts = [rows[:1], rows[1:202], [], rows[202:505], rows[505:]]
    got = list(module._numbered(iter([batch(c) for c in cuts])))
    assert len(got) <= 3 * len(cuts)  # not two for each file
    told = [r for b in got for r in b.to_pylist()]
    want, ends = [], {}
    for file, block, value in rows:
        n, full = ends.get((file, block), (0, 0))
        want.append((file, block, n, full, value))
        ends[file, block] = (n + 1, full + bool(value.strip(" ")))
    assert [(r["file"], r["block"], r["n"], r["full"], r["value"]) for r in told if r["mark"] is None] == want
    marks = [(r["file"], r["block"], r["n"], r["full"]) for r in told if r["mark"] == module.BLOCK]
    assert marks == [(*key, *n) for key, n in ends.items()]


def test_settings_are_lowered_for_a_while(spark):
    from samplelake.sources import files as module

    keys = (module._LISTING, module._OPENING)
    before = [spark.conf.get(k) for k in keys]
    for key in keys:
        with module._at_most(spark, key, 7):
            assert spark.conf.get(key).removesuffix("b") == "7"
    assert [spark.conf.get(k) for k in keys] == before


def test_many_small_files_are_written_by_many_tasks(spark):
    from samplelake.queries.matrices import write_lines, written_parts

    lines = spark.range(120).selectExpr("cast(id div 3 as string) AS part", "id AS at", "concat('v', id) AS value")
    files = [r["path"] for r in written_parts(spark, write_lines(lines, "small", "at"), "path").collect()]
    tasks = {f.rsplit("/", 1)[1].split("-")[1] for f in files}
    assert len(files) == 40 and len(tasks) > 4
