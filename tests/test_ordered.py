import random

import pytest
from pyspark.sql import functions as F

from samplelake.operators.joins import hot_keys, join_dim, measured_bytes
from samplelake.operators.ordered import first_n, make_unique, ordinal, running


def unique_names(names):
    """The rule, spelled out: the k-th later holder takes the next number that is free."""
    known, used, seen, out = set(names), {}, set(), []
    for name in names:
        if name not in seen:
            seen.add(name)
            out.append(name)
            continue
        n = used.get(name, 0) + 1
        while f"{name}-{n}" in known:
            n += 1
        used[name] = n
        out.append(f"{name}-{n}")
    return out


def test_make_unique_by_hand(spark):
    names = ["A", "A", "A-1", "A", "A-3", "B", "A-01", None, None]
    df = spark.createDataFrame(list(enumerate(names)), "ix int, name string")
    got = [r["name"] for r in make_unique(df, "name", "ix").orderBy("ix").collect()]
    assert got == ["A", "A-2", "A-1", "A-4", "A-3", "B", "A-01", None, None]


@pytest.fixture(params=["1", "4", "13"])
def ranges(spark, request):
    """Ranges of rows, as many as are asked for."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield int(request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_make_unique_equals_a_plain_loop(spark, ranges):
    rng = random.Random(ranges)
    pool = ["A", "A", "A", "A-1", "A-2", "A-2-1", "A-5", "B", "B-1", "C", "A-99999999999999999999", "B-"]
    groups = {g: [rng.choice(pool) for _ in range(60)] for g in ("s", "t")}
    data = [(g, i, n) for g, names in groups.items() for i, n in enumerate(names)]
    df = spark.createDataFrame(data, "g string, ix bigint, name string")
    for g, names in groups.items():
        got = make_unique(df, "name", "ix", by=["g"]).filter(F.col("g") == g)
        got = [r["name"] for r in got.orderBy("ix").collect()]
        assert got == unique_names(names)
        assert len(set(got)) == len(got)


def test_ordinal_of_a_hot_group(spark, ranges):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"))
    numbered = ordinal(df, ["k"], "id", "n")
    wrong = numbered.filter(F.col("n") != F.when(F.col("k") == "cold", F.col("id") / 3).otherwise(
        F.floor(F.col("id") / 3) * 2 + F.col("id") % 3 - 1))
    assert wrong.count() == 0 and numbered.count() == 5000


def test_ordinal_by_several_columns(spark, ranges):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None, f"c{i}"]), rng.choice([None, 1, 2]), f"{rng.random()}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x int, y string, __part int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["__part"]: r["n"] for r in ordinal(df, ["g"], ["x", "y"], "n").collect()}
        every = {r["__part"]: r["n"] for r in ordinal(df, [], ["x", "y"], "n").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = sorted(rows, key=lambda r: (r[1] or 0, r[2]))
    assert got == {r[3]: [q[3] for q in by if q[0] == r[0]].index(r[3]) for r in rows}
    assert every == {r[3]: i for i, r in enumerate(by)}
    assert ordinal(df.limit(0), ["g"], "y", "n").count() == 0


def test_running_values_cross_blocks(spark):
    data = [("f", b, i, v) for b, i, v in [(0, 0, "x"), (0, 1, None), (7, 2, None), (7, 3, "y"), (9, 4, None)]]
    df = spark.createDataFrame(data, "f string, b int, i int, v string")
    out = running(df, ["f"], ["b"], ["i"], sums={"n": F.lit(1)}, lasts={"l": F.col("v")}, firsts={"h": F.col("v")})
    got = [tuple(r) for r in out.orderBy("i").select("n", "l", "h").collect()]
    assert got == [(1, "x", "x"), (2, "x", "x"), (3, "x", "x"), (4, "y", "x"), (5, "y", "x")]


def test_first_n(spark, rows):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9)], "k string, v int")
    assert rows(first_n(df, "k", "v", 2)) == [("a", 1), ("a", 2), ("b", 9)]
    assert first_n(df, "k", "v", 0).count() == 4
    plan = first_n(df, "k", "v", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, rows, how):
    key = F.when(F.col("id") < 400, 1).when(F.col("id") < 600, None).otherwise(F.col("id") % 50)
    big = spark.range(1000).select("id", key.alias("k"))
    assert rows(hot_keys(big, ["k"], 4)) == [(1,)]
    dim = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "k bigint, name string")
    plain = rows(big.join(dim, "k", how))
    assert rows(join_dim(big, dim, "k", how)) == plain
    assert rows(join_dim(big, dim, "k", how, limit=0, salts=5)) == plain
    assert rows(join_dim(big, dim, "k", how, limit=0, salts=3, share=2)) == plain


def test_size_is_measured(spark):
    small = measured_bytes(spark.range(10))
    assert 0 < small < measured_bytes(spark.range(1000))
    assert measured_bytes(spark.range(0)) == 0
