"""Flattening of nested frames: structs become columns, arrays become rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def _nested(df: DataFrame, kind: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]


def flatten_nested(df: DataFrame, max_depth: int = 100) -> DataFrame:
    """Expand every struct to ``column.field`` columns and every array to rows, until none is
    left. Several arrays of a row give their product; an empty or null array gives one row
    with null. The schema decides, so no data is looked at and nothing is shuffled.
    """
    for _ in range(max_depth):
        structs, arrays = _nested(df, T.StructType), _nested(df, T.ArrayType)
        if not structs and not arrays:
            return df
        if structs:
            columns = []
            for f in df.schema.fields:
                if f.name not in structs:
                    columns.append(_column(f.name))
                    continue
                for sub in f.dataType.fieldNames():
                    columns.append(_column(f.name).getField(sub).alias(f"{f.name}.{sub}"))
            df = df.select(*columns)
        for name in arrays:
            others = [_column(c) for c in df.columns if c != name]
            df = df.select(*others, F.explode_outer(_column(name)).alias(name))
    raise ValueError(f"still nested after {max_depth} levels")


def typed_json(df: DataFrame, name: str) -> DataFrame:
    """Give a JSON text column its own type, merged over all rows in one aggregation; text that
    is no JSON becomes null."""
    column = _column(name)
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).first()["s"]
    if found is None or found == "VOID":
        return df.withColumn(name, F.lit(None).cast("string"))
    # A name, which a colon follows, stays as it is.
    types = {"OBJECT<": "STRUCT<", "VOID": "STRING"}
    ddl = re.sub(r"(`(?:[^`]|``)*`\s*:|\w+\s*:)|\bOBJECT<|\bVOID\b", lambda m: m[1] or types[m[0]], found)
    return df.withColumn(name, F.from_json(column, ddl))
