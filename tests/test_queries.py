"""Every registered query against its SQL, on whole tables, and the shape of its plan."""

from pathlib import Path

import pytest

import __spark_entry__ as driver
from oracle import compare, connect, rows_of
from samplelake.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frames = []

    def run(session, folder):
        frames.append(driver.queries()[name](session, folder))
        return frames[0]

    verdict, n, _, _ = compare(spark, con, FOLDER, name, run, driver.oracle_sql().get(name))
    assert verdict == "equal" and n > 0
    plan = plan_of(frames[0])
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["source", "task_name", "n_documents", "first_chunk"]
    assert len(rows_of(df.columns, df.collect())) > 0


def test_every_query_has_sql():
    assert set(QUERIES) <= set(driver.oracle_sql()) <= set(driver.queries())


def test_scans_read_what_they_need(spark):
    found = plan_of(QUERIES["document_search"].run(spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in found and "TakeOrderedAndProject" in found
    orders = plan_of(QUERIES["first_orders"].run(spark, FOLDER))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in orders
    assert orders.count("WindowGroupLimit") >= 2
    aligned = plan_of(QUERIES["aligned_rows"].run(spark, FOLDER))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in aligned


def test_row_local_work_is_not_shuffled(spark):
    from samplelake.operators.chunks import pack_chunks, with_chunks
    from samplelake.operators.scan import scan_keywords
    from samplelake.queries.texts import TASKS

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for df in (pack_chunks(docs, sep="\n"), scan_keywords(with_chunks(docs, sep="\n"), TASKS)):
        plan = plan_of(df)
        assert "Exchange" not in plan and "Python" not in plan
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
