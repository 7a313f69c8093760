import json
import random

import pytest

from samplelake.operators.chunks import with_chunks
from samplelake.operators.scan import ScanTask, scan_keywords, scan_tasks, task_prompt, valid_task_reply
from samplelake.plans.workflow import extract_workflow
from samplelake.sinks.tables import write_workflow
from samplelake.sources.papers import default_tasks

TASKS = (ScanTask(1, "Cut", keyword="Cut"), ScanTask(2, "Sew", keyword="sew"), ScanTask(3, "Dye", "cell_type_process", keyword="dye"), ScanTask(4, "Cut", keyword="cut"))


def text_of(prompt):
    return prompt.split("\nText:\n", 1)[1].rsplit("\nAnswer with one", 1)[0]


def task_of(prompt):
    return prompt.split("Task: ", 1)[1].split("\n", 1)[0]


def reply(found, name, prompt, tool="t"):
    info = {"tool_name": tool, "version": None, "description": None, "parameters": {"k": 1}}
    if "analyzed_cell_types" in prompt:
        info["analyzed_cell_types"] = ["T"]
    return json.dumps({"task_exists": found, "task_name": name, "tool_info": info if found else None})


def by_keyword(prompt):
    name = task_of(prompt)
    return reply(name.lower() in text_of(prompt).lower(), name, prompt, name.lower())


def scan_by_hand(chunks):
    cursor, out = 0, []
    for t in TASKS:
        hits = [i for i in range(cursor, len(chunks)) if t.keyword.lower() in chunks[i].lower()]
        if hits:
            cursor = hits[0]
            out.append((t.task_id, cursor))
    return out


def test_both_forms_equal_a_plain_loop(spark):
    rng = random.Random(3)
    papers = [(i, "\n\n".join(rng.choices(["We CUT it", "then sew", "dye", "nothing", "cut and sew"], k=rng.randint(0, 8)))) for i in range(80)]
    docs = with_chunks(spark.createDataFrame(papers, "doc_id int, text string"), min_words=None)
    want = {i: scan_by_hand(t.split("\n\n")) for i, t in papers}
    for found in (scan_keywords(docs, TASKS), scan_tasks(docs, TASKS, by_keyword, parallel=3)):
        got = {i: [] for i, _ in papers}
        for r in found.collect():
            got[r["doc_id"]].append((r["task_id"], r["chunk_no"]))
        order = [t.task_id for t in TASKS]
        assert {i: sorted(v, key=lambda x: order.index(x[0])) for i, v in got.items()} == want
        for v in got.values():
            places = [c for _, c in sorted(v, key=lambda x: order.index(x[0]))]
            assert places == sorted(places)


def test_tools_and_errors(spark):
    papers = [("p", "cut here\n\nsew there\n\ndye"), ("bad", "cut\n\nbroken sew"), ("name", "cut"), ("raise", "cut boom")]

    def model(prompt):
        text, name = text_of(prompt), task_of(prompt)
        if "broken" in text and name == "Sew":
            return '{"task_exists": true, "task_name": "Sew", "tool_info": {"tool_name": 5}}'
        if "boom" in text:
            raise ConnectionError("gone")
        if name == "Sew" and "Tools known so far" in prompt:
            return reply("sew" in text, name, prompt, "after " + prompt.split('"tool_name": "', 1)[1].split('"')[0])
        return by_keyword(prompt)

    docs = with_chunks(spark.createDataFrame(papers, "doc_id string, text string"), min_words=None)
    rows = scan_tasks(docs, TASKS[:3], model).collect()
    found = {(r["doc_id"], r["task_id"]): r for r in rows}
    tool = found["p", 2]["tool"]
    assert (tool["tool_name"], tool["version"], json.loads(tool["parameters"]), tool["analyzed_cell_types"]) == ("after cut", None, {"k": 1}, None)
    assert found["p", 3]["tool"]["analyzed_cell_types"] == ["T"] and found["p", 3]["chunk_no"] == 2
    assert "wrong type" in found["bad", 2]["error"] and found["bad", 1]["error"] is None
    assert found["raise", 1]["error"] == "ConnectionError: gone"
    with pytest.raises(ValueError, match="no tool"):
        scan_tasks(docs, [ScanTask(9, "x", "output")], model)
    with pytest.raises(ValueError, match="keyword"):
        scan_keywords(docs, [ScanTask(9, "x")])


def test_another_name_is_no_hit(spark):
    docs = with_chunks(spark.createDataFrame([(1, "cut")], "doc_id int, text string"), min_words=None)
    assert scan_tasks(docs, TASKS[:1], lambda p: reply(True, "Other", p)).count() == 0


def test_retry_of_an_unreadable_reply(spark, tmp_path):
    log = str(tmp_path / "log")

    def flaky(prompt):
        with open(log, "a") as f:
            f.write("x")
        with open(log) as f:
            return "hm" if len(f.read()) < 3 else by_keyword(prompt)

    docs = with_chunks(spark.createDataFrame([(1, "cut")], "doc_id int, text string").coalesce(1), min_words=None)
    found = scan_tasks(docs, TASKS[:1], flaky)
    assert found.count() == 1 and found.count() == 1
    assert open(log).read() == "xxx"


def test_reply_rules():
    whole = {"tool_name": None, "version": "1", "description": None, "parameters": None}
    assert valid_task_reply({"task_exists": False, "task_name": "x"}, "process")
    assert valid_task_reply({"task_exists": True, "task_name": "x", "tool_info": whole}, "process")
    assert not valid_task_reply({"task_exists": True, "task_name": "x", "tool_info": whole}, "cell_type_process")
    assert valid_task_reply({"task_exists": True, "task_name": "x", "tool_info": {**whole, "analyzed_cell_types": ["a"]}}, "cell_type_process")
    assert not valid_task_reply({"task_exists": True, "task_name": "x", "tool_info": {**whole, "parameters": [1]}}, "process")
    assert not valid_task_reply({"task_exists": True, "task_name": "x", "tool_info": None}, "process")
    assert not valid_task_reply({"task_name": "x"}, "process")
    text = task_prompt("body", ScanTask(1, "Cut", before=("A", "B")), [{"tool_name": "z"}])
    assert "A; B" in text and "nothing" in text and '{"tool_name": "z"}' in text


def test_workflow_of_papers(spark, tmp_path):
    papers = spark.createDataFrame([("p", "Quality Control was done.\n\nClustering with x. Normalization too.")], "doc_id string, text string")
    results = extract_workflow(papers, default_tasks(spark), by_keyword, min_words=2).cache()
    assert {r["task_id"]: r["chunk_no"] for r in results.collect()} == {3: 0, 4: 1, 8: 1}
    write_workflow(default_tasks(spark), results, papers, str(tmp_path / "out"), "json")
    nodes = spark.read.json(str(tmp_path / "out" / "nodes"))
    assert nodes.count() == 23 and nodes.filter("has_tool_info").count() == 3
    assert {r["id"]: r["layer"] for r in nodes.filter("id IN (1, 17)").collect()} == {1: 0, 17: 12}
    assert spark.read.json(str(tmp_path / "out" / "edges")).count() == 23


def test_a_second_run_asks_nothing(spark, tmp_path):
    papers = spark.createDataFrame([("p", "Quality Control was done.\n\nClustering with x."), ("q", "Nothing is here.")], "doc_id string, text string")
    store = str(tmp_path / "store")

    def scan(model, docs):
        rows = extract_workflow(docs, default_tasks(spark), model, min_words=2, store=store).collect()
        return sorted((r["doc_id"], r["task_id"], r["chunk_no"], r["error"]) for r in rows)

    def fail(prompt):
        raise AssertionError("asked again")

    first = scan(by_keyword, papers)
    assert first and all(error is None for *_, error in first)
    assert scan(fail, papers) == first
    more = papers.union(spark.createDataFrame([("r", "Clustering again.")], "doc_id string, text string"))
    assert {r[0] for r in scan(by_keyword, more)} == {"p", "r"}
    changed = spark.createDataFrame([("q", "Clustering, after all.")], "doc_id string, text string")
    assert [r[3] is not None for r in scan(fail, changed)] and [r[0] for r in scan(by_keyword, changed)] == ["q"]
