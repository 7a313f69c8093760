import random

import pytest
from pyspark.sql import functions as F

from samplelake.operators import graph
from samplelake.operators.graph import CycleError, attach_tools, bfs, edges, neighbour_labels, neighbours, topo_layers
from samplelake.plans.workflow import visit_plan
from samplelake.sources.papers import DEFAULT_TASKS, default_tasks

ORDER = [*range(1, 13), 14, 13, 15, 16, 17, 18, 19, 20, 22, 23, 21]


def layers_of(pairs, nodes):
    before = {n: [s for s, d in pairs if d == n] for n in nodes}
    done = {}
    while len(done) < len(nodes):
        for n in nodes:
            if n not in done and all(p in done for p in before[n]):
                done[n] = max((done[p] + 1 for p in before[n]), default=0)
    return done


def test_default_workflow(spark):
    tasks = default_tasks(spark)
    links = edges(tasks)
    assert links.count() == 23
    roots = tasks.filter("id = 1").select(F.col("id").cast("bigint").alias("id"))
    visits = bfs(links, roots).orderBy("ord").collect()
    assert [r["id"] for r in visits] == ORDER and [r["ord"] for r in visits] == list(range(23))
    required = {t[0] for t in DEFAULT_TASKS if t[5]}
    assert [t.task_id for t in visit_plan(tasks)] == [i for i in ORDER if i in required]
    layers = {r["id"]: r["layer"] for r in topo_layers(links).collect()}
    assert layers == layers_of([(r["src"], r["dst"]) for r in links.collect()], range(1, 24))
    levels = {r["id"]: r["level"] for r in visits}
    assert (levels[17], layers[17], layers[21]) == (11, 12, 14)

    labels = tasks.select(F.col("id").cast("bigint").alias("id"), F.col("name").alias("label"))
    before = {r["id"]: r["labels"] for r in neighbour_labels(links, labels).collect()}
    assert before[17] == ["Cell with different types", "Dimensionality Reduction"] and 1 not in before
    after = {r["id"]: r["labels"] for r in neighbour_labels(links, labels, "successors").collect()}
    assert after[9] == ["Malignant Cell Detection", "Compositional analysis", "Differential Gene Expression Analysis", "Cell-type Specificity Analysis"]
    assert neighbours(links, labels).count() == 23
    plan = {t.task_id: t for t in visit_plan(tasks)}
    assert list(plan[17].before) == before[17] and list(plan[9].after) == after[9]


@pytest.mark.parametrize("block", [1, 4, 1 << 16])
def test_random_graphs(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "ORDER_BLOCK", block)
    rng = random.Random(block)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randint(0, 40), rng.randint(0, 40)) for _ in range(70)) if a != b})
    pairs += [(0, n) for n in range(41, 61)]
    df = spark.createDataFrame([(s, d, rng.randint(0, 5)) for s, d in sorted(set(pairs))], "src bigint, dst bigint, ord bigint")
    ordered = sorted(((r["ord"], r["dst"], r["src"]) for r in df.collect()))

    seen, queue, level = [0, 3], [0, 3], {0: 0, 3: 0}
    for node in queue:
        for _, dst, src in ordered:
            if src == node and dst not in seen:
                seen.append(dst)
                queue.append(dst)
                level[dst] = level[node] + 1
    roots = spark.createDataFrame([(3,), (0,)], "id bigint")
    got = bfs(df, roots).orderBy("ord").collect()
    assert [r["id"] for r in got] == seen
    assert {r["id"]: r["level"] for r in got} == level

    nodes = sorted({n for p in pairs for n in p} | {99})
    extra = spark.createDataFrame([(99,)], "id bigint")
    assert {r["id"]: r["layer"] for r in topo_layers(df, extra).collect()} == layers_of(set(pairs), nodes)


def test_cycle(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4)], "src bigint, dst bigint")
    with pytest.raises(CycleError, match="3 nodes"):
        topo_layers(df)


def test_text_ids(spark):
    df = spark.createDataFrame([("a", "b", 1), ("a", "c", 0), ("b", "d", 0)], "src string, dst string, ord bigint")
    assert {r["id"]: r["layer"] for r in topo_layers(df).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_attach_tools(spark):
    tasks = default_tasks(spark).filter("id < 4")
    results = spark.createDataFrame([("p", 3, "tool"), ("p", 2, None)], "doc_id string, task_id bigint, tool string")
    papers = spark.createDataFrame([("p",), ("q",), ("p",)], "doc_id string")
    got = {(r["doc_id"], r["id"]): (r["tool"], r["has_tool_info"]) for r in attach_tools(tasks, results, papers).collect()}
    none = {(d, i): (None, False) for d in "pq" for i in (1, 2, 3)}
    assert got == {**none, ("p", 3): ("tool", True)}


def test_stored_workflow(spark, tmp_path):
    from samplelake.sinks.tables import write_workflow

    results = spark.createDataFrame([("p", 3, "tool"), ("p", 2, None)], "doc_id string, task_id bigint, tool string")
    papers = spark.createDataFrame([("p",), ("q",)], "doc_id string")
    write_workflow(default_tasks(spark), results, papers, str(tmp_path / "flow"))
    nodes = spark.read.parquet(str(tmp_path / "flow/nodes"))
    assert nodes.count() == 46 and nodes.filter("layer IS NULL").count() == 0
    assert [(r["doc_id"], r["id"]) for r in nodes.filter("has_tool_info").collect()] == [("p", 3)]
    assert spark.read.parquet(str(tmp_path / "flow/edges")).count() == 23
