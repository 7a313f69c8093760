"""Papers in markdown, and task graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK = (
    "id int, dep array<int>, name string, type string, optional boolean, tool_required boolean, "
    "metadata map<string,string>"
)
# The kinds of task.
TASK_TYPES = ("input", "output", "process", "cell_type_process")


def read_papers(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``doc_id, text``: one row per paper, its path being the id."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")
    )


def check_tasks(tasks: DataFrame) -> DataFrame:
    """The task table, if it is sound: all fields set, known types, no id twice, no dependency
    on a task that is not there. Raises ``ValueError`` with the ids otherwise."""
    required = [c for c in tasks.columns if c != "metadata"]
    empty = F.lit(False)
    for c in required:
        empty = empty | F.col(c).isNull()
    problems = {
        "a field is missing": tasks.filter(empty).select("id"),
        "unknown type": tasks.filter(~F.col("type").isin(*TASK_TYPES)).select("id"),
        "id given twice": tasks.groupBy("id").count().filter("count > 1").select("id"),
        "dependency not found": tasks.select("id", F.explode("dep").alias("d"))
        .join(tasks.select(F.col("id").alias("d")), "d", "left_anti")
        .select("id"),
    }
    found = [
        f"{text}: {sorted({str(r['id']) for r in rows.limit(20).collect()})} of {rows.count()}"
        for text, rows in problems.items()
        if rows.take(1)
    ]
    if found:
        raise ValueError("; ".join(found))
    return tasks


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """A task table from a JSON array; the schema is given, since an empty object has none."""
    return check_tasks(spark.read.schema(TASK).option("multiLine", True).json(path))


# The default single-cell workflow. Names decide whether a reply is a hit and
# ids the order, so both are data: (id, dependencies, name, type, optional, tool required).
DEFAULT_TASKS = (
    (1, (), "Raw Data", "input", False, False),
    (2, (1,), "Sample Metadata Alignment", "process", False, False),
    (3, (2,), "Quality Control", "process", False, True),
    (4, (3,), "Normalization", "process", False, True),
    (5, (4,), "Feature selection", "process", False, True),
    (6, (5,), "Data integration", "process", True, True),
    (7, (6,), "Dimensionality Reduction", "process", False, True),
    (8, (7,), "Clustering", "process", False, True),
    (9, (8,), "Cell-type Annotation", "process", False, True),
    (10, (9,), "Malignant Cell Detection", "process", True, True),
    (11, (9,), "Compositional analysis", "process", True, False),
    (12, (9,), "Differential Gene Expression Analysis", "process", True, False),
    (13, (12,), "Enrichment and Pathway Analysis", "process", True, True),
    (14, (9,), "Cell-type Specificity Analysis", "process", False, False),
    (15, (14,), "Cell with different types", "output", True, False),
    (16, (15,), "Dimensionality Reduction", "cell_type_process", True, True),
    (17, (15, 16), "Subtype Explorations and Annotation", "cell_type_process", False, True),
    (18, (17,), "Trajectory Analysis", "cell_type_process", False, True),
    (19, (17,), "Compositional analysis", "cell_type_process", False, False),
    (20, (17,), "Differential Gene Expression Analysis", "cell_type_process", False, True),
    (21, (20,), "Enrichment and Pathway Analysis", "cell_type_process", False, True),
    (22, (17,), "Gene Regulatory Networks", "cell_type_process", False, True),
    (23, (17,), "Cell-Cell Communication", "cell_type_process", False, True),
)


def default_tasks(spark: SparkSession) -> DataFrame:
    rows = [(i, list(dep), name, kind, optional, tool, {}) for i, dep, name, kind, optional, tool in DEFAULT_TASKS]
    return spark.createDataFrame(rows, TASK)
