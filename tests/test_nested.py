import pytest
from pyspark.sql import types as T

from samplelake.operators.flatten import flatten_nested, typed_json
from samplelake.operators.search import search
from samplelake.operators.union import ragged_union, run_summary
from samplelake.sinks.tables import write_table


def test_flatten(spark, rows):
    data = [
        (1, {"n": 1, "in": [{"x": 1, "y": {"z": "a"}}, {"x": 2, "y": None}]}, ["p", "q"]),
        (2, {"n": 2, "in": []}, ["r"]),
        (3, None, None),
    ]
    schema = "id int, s struct<n:int,in:array<struct<x:int,y:struct<z:string>>>>, t array<string>"
    flat = flatten_nested(spark.createDataFrame(data, schema))
    assert not any(isinstance(f.dataType, (T.StructType, T.ArrayType)) for f in flat.schema.fields)
    got = rows(flat.select("id", "`s.n`", "t", "`s.in.x`", "`s.in.y.z`"))
    assert got == sorted(
        [(1, 1, t, x, z) for t in "pq" for x, z in ((1, "a"), (2, None))] + [(2, 2, "r", None, None), (3, None, None, None, None)], key=repr)
    assert "Exchange" not in flat._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="nested"):
        flatten_nested(spark.createDataFrame(data, schema), max_depth=1)


def test_json_text(spark, rows):
    df = spark.createDataFrame([(1, '{"a": 1, "b": [{"c": "x"}]}'), (2, '{"b": []}'), (3, "no json")], "id int, j string")
    flat = flatten_nested(typed_json(df, "j"))
    assert rows(flat.select("id", "`j.a`", "`j.b.c`")) == [(1, 1, "x"), (2, None, None), (3, None, None)]
    assert typed_json(df.filter("id = 3"), "j").first()["j"] is None


def test_search(spark):
    data = [(i, "Lung cancer lung" if i % 2 else "LUNG", "cancer" if i % 3 == 0 else None) for i in range(12)]
    records = spark.createDataFrame(data, "id int, title string, summary string")
    found = search(records, "lung CANCER", 3, key="id")
    assert [(r["id"], r["hits"]) for r in found.collect()] == [(3, 4), (9, 4), (1, 3)]
    assert "TakeOrderedAndProject" in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        search(records, "  ")


def test_union_and_summary(spark, rows):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2, 0.5)], "i int, d double")
    both = ragged_union([a, b])
    assert rows(both.select("i", "s", "d")) == [(1, "x", None), (2, None, 0.5)]
    assert rows(run_summary({"a": a, "none": a.filter("false")})) == [("a", 1), ("none", 0)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'é "q",\n中', None)], "i int, s string, n string")
    write_table(df, str(tmp_path / "j"), "json")
    assert [p for p in (tmp_path / "j").glob("*.json") if p.read_text().strip() == '{"i":1,"s":"é \\"q\\",\\n中","n":null}']
    write_table(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first()["s"] == 'é "q",\n中'
    with pytest.raises(ValueError):
        write_table(df, str(tmp_path / "x"), "xml")


def test_names_that_look_like_types(spark):
    from samplelake.operators.flatten import typed_json

    df = spark.createDataFrame([('{"AVOID": 3, "VOID": null, "a b": {"OBJECT": "x"}}',)], "j string")
    row = typed_json(df, "j").first()["j"]
    assert row["AVOID"] == 3 and row["VOID"] is None and row["a b"]["OBJECT"] == "x"
