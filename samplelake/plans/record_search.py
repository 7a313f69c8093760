"""Keyword search over stored result pages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from samplelake.operators.search import search
from samplelake.sources.records import RESULT_PAGE, Rules, extract_records


def search_pages(pages: DataFrame, query: str, k: int = 10, rules: Rules = RESULT_PAGE, *, key: str = "page_id") -> DataFrame:
    """The ``k`` best records of all pages for ``query``."""
    return search(extract_records(pages, rules=rules, key=key), query, k, key=key)
