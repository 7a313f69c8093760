import json

import pytest

from fixtures import ALONE, FAMILY, LOST, gz
from samplelake.fields import DEFAULT_FIELDS, Field, read_fields, split_fields
from samplelake.operators.prompts import response_format
from samplelake.plans.metadata import Vocabulary, extract_from_files, metadata_columns
from samplelake.sinks.tables import CSV_READ, write_table


def answer(prompt):
    if "= four" in prompt:
        raise TimeoutError("slow")
    if "= five" in prompt:
        return "I cannot say."
    return '```json\n{"condition": "lung cancr", "organ/tissue": null, "age": 40, "pair-end": ["a"], "extra": 1}\n```'


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "soft").mkdir()
    (tmp_path / "soft" / "family.soft.gz").write_bytes(gz(FAMILY))
    (tmp_path / "soft" / "alone.soft").write_text(ALONE)
    (tmp_path / "soft" / "lost.soft").write_text(LOST)
    (tmp_path / "soft" / "bad.soft.gz").write_bytes(gz(FAMILY)[:100])
    return str(tmp_path / "soft")


def test_default_fields():
    copied, groups = split_fields(DEFAULT_FIELDS)
    assert (len(DEFAULT_FIELDS), len(copied), len(groups), len(groups[0].fields)) == (30, 6, 1, 24)
    assert len(metadata_columns(DEFAULT_FIELDS)) == 36
    assert [f.name for f in DEFAULT_FIELDS if f.map_to_umls] == ["condition", "organ/tissue", "sampling site", "treatment"]


def test_groups_and_form(tmp_path):
    rows = [
        {"name": "a", "type": "str", "description": "first", "options": ["x", "y"], "ref": ["Sample_a"]},
        {"name": "b", "type": "int", "ref": ["Series_b", "Sample_a"]},
        {"name": "c", "type": "str", "ref": ["Sample_c", "Sample_d"], "copy_from_ref": True},
        {"name": "d", "type": "str", "ref": ["Sample_d"], "copy_from_ref": True},
    ]
    (tmp_path / "fields.json").write_text(json.dumps(rows))
    copied, groups = split_fields(read_fields(tmp_path / "fields.json"))
    assert [f.name for f in copied] == ["d"] and [[f.name for f in g.fields] for g in groups] == [["a", "b"], ["c"]]
    assert groups[0].refs() == ("Sample_a", "Series_b")
    assert json.loads(response_format(groups[0])) == {
        "type": "object",
        "properties": {"a": {"type": "string", "description": "first", "enum": ["x", "y"]}, "b": {"type": "integer"}},
        "required": ["a", "b"],
    }
    assert split_fields([Field("x"), Field("y", ref=("Sample_y",))])[1][0].refs() is None


def test_rows_of_files(spark, folder, tmp_path):
    vocabulary = Vocabulary(
        spark.createDataFrame([("C1", "Lung cancer", "d"), ("C2", "Lung", None)], "concept_id string, canonical_name string, definition string"),
        spark.createDataFrame([("C1", "lung cancer"), ("C2", "lung cancr")], "concept_id string, alias string"),
    )
    done = extract_from_files(spark, folder, DEFAULT_FIELDS, answer, vocabulary, per_series=2)
    assert done.rows.columns == metadata_columns(DEFAULT_FIELDS)
    rows = {r["gsm"]: r for r in done.rows.collect()}
    # two of each series, GSM9 coming first for its file's name; GSM8 has no series
    assert sorted(rows) == ["GSM1", "GSM2", "GSM4", "GSM8", "GSM9"]
    one = rows["GSM1"]
    assert (one["condition"], one["condition_umls"], one["organ/tissue"], one["organ/tissue_umls"]) == ("lung cancr", "Lung cancer [C1]", None, None)
    assert (one["age"], one["pair-end"], one["gender"]) == ("40", '["a"]', None)
    assert (one["title"], one["series_id"], one["pubmed_id"], one["relation"]) == ("one", "GSE1;GSE2", "11;12", None)
    assert rows["GSM2"]["relation"] == "r1;r2" and rows["GSM8"]["pubmed_id"] is None
    assert one["raw_metadata"].startswith("!Sample_title = one\n!Sample_type = RNA")

    path = str(tmp_path / "out.csv")
    write_table(done.rows, path, "csv")
    back = spark.read.options(**CSV_READ).schema(done.rows.schema).csv(path)
    assert {r["gsm"]: r["raw_metadata"] for r in back.collect()} == {g: r["raw_metadata"] for g, r in rows.items()}


def test_failures_keep_the_row(spark, folder):
    done = extract_from_files(spark, folder, DEFAULT_FIELDS, answer, per_series=None)
    rows = {r["gsm"]: r for r in done.rows.collect()}
    assert len(rows) == 8
    for gsm in ("GSM4", "GSM5"):
        assert rows[gsm]["condition"] is None and rows[gsm]["condition_umls"] is None and rows[gsm]["title"] is not None
    assert rows["GSM6"]["condition_umls"] == "lung cancr"
    errors = {(r["stage"], r["accession"]) for r in done.errors.collect()}
    assert errors == {("infer", "GSM4"), ("infer", "GSM5"), ("context", "GSM1"), ("pair", "GSM8"), ("read", None)}


def test_one_sample(spark, folder):
    done = extract_from_files(spark, folder, accession="GSM3")
    assert [(r["gsm"], r["title"], r["condition"]) for r in done.rows.collect()] == [("GSM3", "three", None)]


def test_groups_with_refs(spark, folder):
    spec = [Field("who", ref=("Sample_title",)), Field("kind", ref=("Series_title", "Sample_type"), copy_from_ref=True)]

    def echo(prompt):
        body = prompt.split("ATTRIBUTES\n", 1)[1].split("\nFORM\n", 1)[0]
        name = "who" if '"who"' in prompt else "kind"
        return json.dumps({name: body})

    rows = {r["gsm"]: r for r in extract_from_files(spark, folder, spec, echo, per_series=None).rows.collect()}
    assert rows["GSM1"]["who"] == "Sample_title = one"
    assert rows["GSM1"]["kind"] == "Series_title = First study\nSample_type = RNA"
    assert rows["GSM8"]["kind"] == "!Sample_title = eight\n!Sample_series_id = GSE99"
