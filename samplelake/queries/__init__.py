"""Queries over the driver's tables, each with the SQL that gives the same result.

The tables stand in for an archive: a document is a sample whose lines are its description,
its source is the series; a conversation is a sample with one attribute per role; orders,
parts and suppliers give matrices, file names and a lineage graph.
"""

from samplelake.queries import attributes, files, graphs, matrices, nested, records, replies, texts
from samplelake.queries.registry import QUERIES

__all__ = ["QUERIES", "attributes", "graphs", "matrices", "nested", "records", "replies", "texts"]
