"""Graph operators on the lineage of the tables: region > nation > customer > order > part,
and nation > supplier > part. Parts are reached over ways of different length, so their
layer differs from their visit level, and nations and parts are hubs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplelake.functions.text import BLANK_LINE
from samplelake.operators.chunks import with_chunks
from samplelake.operators.graph import attach_tools, bfs, neighbours, topo_layers
from samplelake.operators.scan import TOOL_TYPE, scan_keywords
from samplelake.plans.workflow import visit_plan
from samplelake.queries.registry import query, table
from samplelake.queries.texts import LIMIT
from samplelake.session import spread
from samplelake.sources.papers import DEFAULT_TASKS, default_tasks

STEP = 10_000_000_000
KINDS = ("region", "nation", "customer", "supplier", "orders", "part")


def _node(kind: str, key: str):
    return (F.lit(KINDS.index(kind) * STEP) + F.col(key)).cast("bigint")


def lineage(spark: SparkSession, folder: str) -> DataFrame:
    def links(name: str, src, dst) -> DataFrame:
        return table(spark, folder, name).select(src.alias("src"), dst.alias("dst"))

    items = table(spark, folder, "lineitem")
    pairs = (
        links("nation", _node("region", "n_regionkey"), _node("nation", "n_nationkey"))
        .union(links("customer", _node("nation", "c_nationkey"), _node("customer", "c_custkey")))
        .union(links("supplier", _node("nation", "s_nationkey"), _node("supplier", "s_suppkey")))
        .union(links("orders", _node("customer", "o_custkey"), _node("orders", "o_orderkey")))
        .union(items.select(_node("orders", "l_orderkey"), _node("part", "l_partkey")))
        .union(items.select(_node("supplier", "l_suppkey"), _node("part", "l_partkey")))
    )
    return pairs.withColumn("ord", F.col("dst"))


def _id_sql(kind: str, key: str) -> str:
    return f"({KINDS.index(kind) * STEP} + {key})"


LINEAGE_SQL = f"""
links(src, dst) AS (
  SELECT {_id_sql('region', 'n_regionkey')}, {_id_sql('nation', 'n_nationkey')} FROM nation
  UNION SELECT {_id_sql('nation', 'c_nationkey')}, {_id_sql('customer', 'c_custkey')} FROM customer
  UNION SELECT {_id_sql('nation', 's_nationkey')}, {_id_sql('supplier', 's_suppkey')} FROM supplier
  UNION SELECT {_id_sql('customer', 'o_custkey')}, {_id_sql('orders', 'o_orderkey')} FROM orders
  UNION SELECT {_id_sql('orders', 'l_orderkey')}, {_id_sql('part', 'l_partkey')} FROM lineitem
  UNION SELECT {_id_sql('supplier', 'l_suppkey')}, {_id_sql('part', 'l_partkey')} FROM lineitem
)
"""


@query(
    f"""
    WITH RECURSIVE {LINEAGE_SQL},
    walk AS (
      SELECT DISTINCT src AS id, 0 AS layer FROM links WHERE src NOT IN (SELECT dst FROM links)
      UNION
      SELECT l.dst, w.layer + 1 FROM walk w JOIN links l ON l.src = w.id
    )
    SELECT id, max(layer) AS layer FROM walk GROUP BY id
    """
)
def lineage_layers(spark: SparkSession, folder: str) -> DataFrame:
    return topo_layers(lineage(spark, folder))


def _bfs_sql(levels: int = 6) -> str:
    parts = [
        f"""
        v0 AS (SELECT r_regionkey AS id, 0 AS level, row_number() OVER (ORDER BY r_regionkey) - 1 AS ord FROM region),
        s0 AS (SELECT * FROM v0)
        """
    ]
    for n in range(1, levels):
        parts.append(
            f"""
            r{n} AS (
              SELECT l.dst AS id, min((v.ord, l.dst)) AS m FROM v{n - 1} v JOIN links l ON l.src = v.id
              WHERE l.dst NOT IN (SELECT id FROM s{n - 1}) GROUP BY l.dst
            ),
            v{n} AS (
              SELECT id, {n} AS level, row_number() OVER (ORDER BY m, id) - 1 + (SELECT count(*) FROM s{n - 1}) AS ord FROM r{n}
            ),
            s{n} AS (SELECT * FROM s{n - 1} UNION ALL SELECT * FROM v{n})
            """
        )
    return f"WITH {LINEAGE_SQL}, {', '.join(parts)} SELECT id, level, ord FROM s{levels - 1}"


@query(_bfs_sql())
def lineage_visits(spark: SparkSession, folder: str) -> DataFrame:
    roots = table(spark, folder, "region").select(_node("region", "r_regionkey").alias("id"))
    return bfs(lineage(spark, folder), roots)


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    def named(name: str, key: str, label: str) -> DataFrame:
        return table(spark, folder, name).select(_node(name, key).alias("id"), F.col(label).alias("label"))

    return (
        named("region", "r_regionkey", "r_name")
        .union(named("nation", "n_nationkey", "n_name"))
        .union(named("customer", "c_custkey", "c_name"))
        .union(named("supplier", "s_suppkey", "s_name"))
        .union(named("orders", "o_orderkey", "o_orderpriority"))
        .union(named("part", "p_partkey", "p_name"))
    )


LABELS_SQL = f"""
labels(id, label) AS (
  SELECT {_id_sql('region', 'r_regionkey')}, r_name FROM region
  UNION ALL SELECT {_id_sql('nation', 'n_nationkey')}, n_name FROM nation
  UNION ALL SELECT {_id_sql('customer', 'c_custkey')}, c_name FROM customer
  UNION ALL SELECT {_id_sql('supplier', 's_suppkey')}, s_name FROM supplier
  UNION ALL SELECT {_id_sql('orders', 'o_orderkey')}, o_orderpriority FROM orders
  UNION ALL SELECT {_id_sql('part', 'p_partkey')}, p_name FROM part
)
"""


@query(f"WITH {LINEAGE_SQL}, {LABELS_SQL} SELECT l.dst AS id, l.src AS neighbour, n.label FROM links l JOIN labels n ON n.id = l.src")
def lineage_predecessors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours(lineage(spark, folder).distinct(), _labels(spark, folder), "predecessors")


@query(f"WITH {LINEAGE_SQL}, {LABELS_SQL} SELECT l.src AS id, l.dst AS neighbour, n.label FROM links l JOIN labels n ON n.id = l.dst")
def lineage_successors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours(lineage(spark, folder).distinct(), _labels(spark, folder), "successors")


# Words of the documents for tasks of the default workflow.
DEFAULT_WORDS = {
    3: "the ", 4: "and ", 5: "of", 6: "ing ", 7: "die ", 8: "und", 9: "que", 10: "ß", 13: "ion", 16: "è", 17: "er ",
    18: "re ", 20: "in ", 21: "par ", 22: "los ", 23: "1",
}


def _workflow_sql() -> str:
    rows = ", ".join(f"({i}, '{name}')" for i, _, name, *_ in DEFAULT_TASKS)
    return f"""
    WITH tasks(id, name) AS (VALUES {rows}),
    trimmed AS (SELECT doc_id, trim(text, E' \\t\\n\\r\\f\\v') AS t, lower(text) AS lowered FROM documents),
    words(id, word) AS (VALUES {", ".join(f"({i}, '{w.strip()}')" for i, w in DEFAULT_WORDS.items())}),
    found AS (SELECT d.doc_id, w.id, w.word FROM trimmed d JOIN words w ON t <> '' AND contains(lowered, w.word))
    SELECT d.doc_id, t.id, t.name, f.word AS tool_name, f.id IS NOT NULL AS has_tool_info
    FROM (SELECT DISTINCT doc_id FROM documents) d CROSS JOIN tasks t LEFT JOIN found f ON f.doc_id = d.doc_id AND f.id = t.id
    """


@query(_workflow_sql())
def workflow_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The default workflow over all documents, each taken as one chunk (no blank lines)."""
    tasks = default_tasks(spark)
    plan = visit_plan(tasks, keywords={i: w.strip() for i, w in DEFAULT_WORDS.items()})
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    hits = scan_keywords(with_chunks(docs, min_words=LIMIT, sep=BLANK_LINE), plan)
    tool = F.from_json(F.to_json(F.struct("tool_name")), TOOL_TYPE).alias("tool")
    nodes = attach_tools(tasks, hits.select("doc_id", "task_id", tool), docs)
    return nodes.select("doc_id", "id", "name", F.col("tool.tool_name").alias("tool_name"), "has_tool_info")


