"""Type of a supplementary file from its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The file types, and the marks that give a name away. A later row wins
# over an earlier one.
FILE_TYPES = ("RDATA", "MTX", "TABLE", "H5", "H5AD", "UNKNOWN")
NAME_MARKS = (
    ("MTX", r"mtx"),
    ("TABLE", r"csv|txt|tsv"),
    ("RDATA", r"rdata"),
    ("H5", r"\.h5(\.|$)"),
    ("H5AD", r"\.h5ad(\.|$)"),
)


def file_type(name: Column) -> Column:
    """One of ``FILE_TYPES``; null name is UNKNOWN."""
    lowered = F.lower(name)
    kind = F.lit("UNKNOWN")
    for label, mark in NAME_MARKS:
        kind = F.when(lowered.rlike(mark), F.lit(label)).otherwise(kind)
    return kind
