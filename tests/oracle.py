"""Run queries against their SQL: ``python tests/oracle.py [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value.is_integer() else round(value, 9))
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, folder: str, name: str, run, sql: str | None) -> tuple[str, int, float, float]:
    start = time.time()
    df = run(spark, folder)
    got = rows_of(df.columns, df.collect())
    took, start = time.time() - start, time.time()
    if sql is None:
        return "no sql", len(got), took, 0.0
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    other = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}", len(got), took, other
    if got == want:
        return "equal", len(got), took, other
    extra = [r for r in got if r not in set(want)][:2] if len(got) < 20000 else got[:1]
    lacking = [r for r in want if r not in set(got)][:2] if len(want) < 20000 else want[:1]
    return f"DIFFERS {len(got)}/{len(want)}\n   spark {extra}\n   sql   {lacking}"[:1500], len(got), took, other


if __name__ == "__main__":
    import __spark_entry__ as driver
    from samplelake.session import build_session

    place = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(driver.queries())
    session, connection = build_session(cores=8), connect(place)
    sqls, runs = driver.oracle_sql(), driver.queries()
    bad = 0
    for query_name in chosen:
        try:
            verdict, n, t, o = compare(session, connection, place, query_name, runs[query_name], sqls.get(query_name))
        except Exception as error:
            verdict, n, t, o = f"FAILED {type(error).__name__}: {str(error)[:700]}", 0, 0.0, 0.0
        bad += verdict not in ("equal", "no sql")
        print(f"{query_name:28s} {n:8d} rows {t:7.2f}s sql {o:6.2f}s  {verdict}", flush=True)
    print(f"{bad} of {len(chosen)} not equal")
