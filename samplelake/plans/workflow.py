"""Which tool did each paper use for each task of a workflow?"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from samplelake.functions.text import BLANK_LINE
from samplelake.operators.chunks import with_chunks
from samplelake.operators.infer import Responder
from samplelake.operators.scan import ScanTask, scan_tasks


def visit_plan(tasks: DataFrame, root: int = 1, keywords: dict[int, str] | None = None) -> list[ScanTask]:
    """The tasks that need a tool, in breadth-first order from ``root``, with the names of
    their neighbours. A workflow is a specification of a few dozen tasks, so its plan is a
    list of the driver; documents never are. ``operators.graph.bfs`` visits graphs that are
    data, in the same order."""
    rows = {r["id"]: r for r in tasks.orderBy("id").collect()}
    after = {i: [j for j, r in rows.items() if i in r["dep"]] for i in rows}
    order = [root]
    for i in order:
        order.extend(j for j in after[i] if j not in order)

    def names(ids: Iterable[int]) -> tuple[str, ...]:
        return tuple(rows[i]["name"] for i in ids)

    words = keywords or {}
    return [
        ScanTask(i, rows[i]["name"], rows[i]["type"], names(sorted(rows[i]["dep"])), names(after[i]), words.get(i))
        for i in order
        if rows[i]["tool_required"]
    ]


def extract_workflow(
    papers: DataFrame,
    tasks: DataFrame,
    responder: Responder,
    *,
    key: str = "doc_id",
    text: str = "text",
    min_words: int = 200,
    sep: str = BLANK_LINE,
    retries: int = 3,
    parallel: int | None = None,
    store: str | None = None,
) -> DataFrame:
    """Task results of all ``papers(key, text)``: chunks of more than ``min_words`` words are
    scanned for the tasks in visit order. A ``store`` keeps what was found for later runs."""
    chunked = with_chunks(papers.select(key, text), text, min_words, sep)
    return scan_tasks(chunked, visit_plan(tasks), responder, key=key, retries=retries, parallel=parallel, store=store)
