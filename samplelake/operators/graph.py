"""Graph operators over an edge table ``src, dst, ord``, as frontier loops.

``ord`` is an integer that orders the edges leaving a node. Each round is written to the
shared folder, so plans stay short and a lost executor costs one round. There are as many
rounds as the graph has levels, which for a workflow or a lineage graph is few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplelake.operators.joins import join_dim
from samplelake.operators.ordered import running
from samplelake.session import materialise, new_table_path

ORDER_BLOCK = 1 << 16


class CycleError(ValueError):
    """The graph has a cycle, so its nodes have no layers."""


def edges(tasks: DataFrame) -> DataFrame:
    """``src, dst, ord`` from the dependency lists of a task table."""
    pairs = tasks.select(F.explode(F.col("dep").cast("array<bigint>")).alias("src"), F.col("id").cast("bigint").alias("dst"))
    return pairs.withColumn("ord", F.col("dst"))


def neighbours(links: DataFrame, labels: DataFrame, direction: str = "predecessors") -> DataFrame:
    """One row per node and neighbour: ``id, neighbour, label``, a form that a hub with any
    number of neighbours fits into. ``labels`` holds ``id, label``."""
    here, there = ("dst", "src") if direction == "predecessors" else ("src", "dst")
    pairs = links.select(F.col(here).alias("id"), F.col(there).alias("neighbour"))
    named = labels.select(F.col("id").alias("neighbour"), "label")
    return join_dim(pairs, named, "neighbour", "inner").select("id", "neighbour", "label")


def neighbour_labels(links: DataFrame, labels: DataFrame, direction: str = "predecessors") -> DataFrame:
    """``id, labels``: the neighbours' labels as one list, by neighbour id. For workflow graphs,
    whose lists go into a prompt; graphs with hubs use ``neighbours``."""
    rows = neighbours(links, labels, direction)
    ordered = F.array_sort(F.collect_list(F.struct("neighbour", "label")))
    return rows.groupBy("id").agg(F.transform(ordered, lambda r: r["label"]).alias("labels"))


def attach_tools(tasks: DataFrame, results: DataFrame, documents: DataFrame) -> DataFrame:
    """Every task with the tool found for it in each of ``documents(doc_id)``, and
    ``has_tool_info``; ``results`` holds ``doc_id, task_id, tool``. Rows of results without a
    tool, such as those of failed tasks, tell of none."""
    per_doc = documents.select("doc_id").distinct().withColumn("task", F.explode(_as_literals(tasks)))
    rows = per_doc.select("doc_id", "task.*")
    found = results.filter(F.col("task_id").isNotNull() & F.col("tool").isNotNull()).select(
        "doc_id", F.col("task_id").alias("id"), "tool"
    )
    return rows.join(found, ["doc_id", "id"], "left").withColumn("has_tool_info", F.col("tool").isNotNull())


def _as_literals(tasks: DataFrame):
    """A workflow's tasks (a few dozen rows) as one array literal."""
    return F.array(
        *[
            F.struct(F.lit(r["id"]).cast("bigint").alias("id"), F.lit(r["name"]).alias("name"))
            for r in tasks.select("id", "name").orderBy("id").collect()
        ]
    )


def _number_level(found: DataFrame, first: int) -> DataFrame:
    """``id, ord``: the level's nodes numbered from ``first`` by (parent, edge, id).

    Two running sums take the place of one window over the level: children before a parent,
    and children before a node under its own parent. So neither a wide level nor a hub sits in
    one task.
    """
    counts = found.groupBy("parent").agg(F.count("*").alias("n"))
    counts = counts.select(
        "*", F.lit(0).alias("__all"), F.floor(F.col("parent") / ORDER_BLOCK).alias("__block")
    )
    upto = running(counts, ["__all"], ["__block"], ["parent"], sums={"upto": F.col("n")})
    before = upto.select("parent", (F.col("upto") - F.col("n")).alias("before"))

    cut = found.withColumn("__block", F.floor(F.col("edge") / ORDER_BLOCK))
    own = running(cut, ["parent"], ["__block"], ["edge", "id"], sums={"own": F.lit(1).cast("bigint")})
    return own.join(before, "parent").select(
        "id", (F.col("before") + F.col("own") - 1 + first).alias("ord")
    )


def bfs(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Breadth-first visit from ``roots(id)``: ``id, level, ord``. ``ord`` counts the visits:
    roots by id, then by the parent's ``ord`` and the edge's ``ord``."""
    spark = links.sparkSession
    fixed = materialise(
        links.groupBy("src", "dst").agg(F.min("ord").cast("bigint").alias("ord")), "edges"
    )
    id_type = fixed.schema["dst"].dataType.simpleString()
    path = new_table_path(spark, "visits")
    schema = f"id {id_type}, ord bigint, level int"

    found = roots.select(F.col("id").cast(id_type).alias("id")).distinct()
    found = found.select("id", F.lit(0).cast("bigint").alias("parent"), F.col("id").cast("bigint").alias("edge"))
    level, seen = 0, 0
    while True:
        found = materialise(found, "level")
        size = found.count()
        if size == 0:
            break
        here = f"{path}/level={level}"
        _number_level(found, seen).write.parquet(here)
        seen, level = seen + size, level + 1
        visited = spark.read.schema(schema).parquet(path)
        frontier = spark.read.schema(f"id {id_type}, ord bigint").parquet(here)
        reached = fixed.join(frontier.select(F.col("id").alias("src"), F.col("ord").alias("parent")), "src")
        found = (
            reached.groupBy(F.col("dst").alias("id"))
            .agg(F.min(F.struct("parent", F.col("ord").alias("edge"))).alias("m"))
            .select("id", "m.parent", "m.edge")
            .join(visited.select("id"), "id", "left_anti")
        )
    if level == 0:
        return spark.createDataFrame([], f"id {id_type}, level int, ord bigint")
    return spark.read.schema(schema).parquet(path).select("id", "level", "ord")


def topo_layers(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``id, layer``: the longest distance from a node without predecessors.

    A round takes the nodes all of whose predecessors have a layer; only nodes that the last
    round's nodes point at are looked at. ``nodes(id)`` adds nodes without edges.
    """
    spark = links.sparkSession
    fixed = materialise(links.select("src", "dst").distinct(), "edges")
    id_type = fixed.schema["dst"].dataType.simpleString()
    ids = fixed.select(F.col("src").alias("id")).union(fixed.select("dst"))
    if nodes is not None:
        ids = ids.union(nodes.select(F.col("id").cast(id_type)))
    ids = materialise(ids.distinct(), "nodes")
    total = ids.count()
    path = new_table_path(spark, "layers")
    schema = f"id {id_type}, layer int"

    # A hub is one row once its ids are made distinct, which sums before it shuffles.
    frontier = ids.join(fixed.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    layer, seen = 0, 0
    while seen < total:
        here = f"{path}/layer={layer}"
        frontier.write.parquet(here)
        latest = spark.read.schema(f"id {id_type}").parquet(here)
        size = latest.count()
        if size == 0:
            raise CycleError(f"{total - seen} nodes lie on or behind a cycle")
        seen, layer = seen + size, layer + 1
        done = spark.read.schema(schema).parquet(path).select(F.col("id").alias("src"))
        pointed = fixed.join(latest.select(F.col("id").alias("src")), "src", "left_semi").select("dst").distinct()
        pointed = materialise(pointed, "pointed")
        waiting = fixed.join(pointed, "dst", "left_semi").join(done, "src", "left_anti")
        frontier = pointed.join(waiting.select("dst").distinct(), "dst", "left_anti").select(F.col("dst").alias("id"))
    if layer == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
