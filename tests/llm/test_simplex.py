"""Clustering against plain rounds over all pairs."""

import hashlib
import math

import numpy as np
import pytest

from samplelake.llm import simplex
from samplelake.llm.simplex import Pivots, nearest

COLUMNS = "vec_id long, embedding array<double>, cluster string, own string, apex int, `a.b` int"


def _plain(rows, k, rounds, dims, scale=256):
    """``vec_id, cluster, distance`` and the centroids."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]

    def place(pair):
        return (pair[0] is None, hashlib.sha256(f"2:{pair[0]}".encode()).hexdigest() if pair[0] is not None else "", pair[1])

    centroids = [v for _, v in sorted(kept, key=place)[:k]]

    def assign():
        out = []
        for i, v in kept:
            out.append((i, v, *min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))))
        return out

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            own = [v for _, v, _, m in found if m == n]
            if own:
                centroids[n] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    return sorted([(i, n, d) for i, _, d, n in assign()], key=repr), centroids


def _vectors(seed, n, dims, spread=1.0):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(5, dims)) * spread
    return [(i, (middles[i % 5] + draw.normal(size=dims) * 0.3).tolist()) for i in range(n)]


def _rows(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("n", "dims", "k", "spread"), [(400, 8, 12, 1.0), (300, 64, 40, 0.2), (30, 4, 40, 1.0), (200, 2, 6, 0.01)])
def test_rounds(spark, n, dims, k, spread):
    rows = _vectors(n, n, dims, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, centroids = simplex.cluster(df, k=k, rounds=4, dims=dims)
    want, middles = _plain(rows, k, 4, dims)
    assert _rows(found) == want and centroids.tolist() == middles


def test_odd_vectors(spark):
    good = [(i, [float(i % 3), 1.0, -0.5]) for i in range(9)]
    odd = [
        (20, None), (21, []), (22, [1.0, 2.0]), (23, [1.0, None, 2.0]), (24, [float("nan"), 1.0, 1.0]), (25, [float("inf")] * 3),
        (26, [1.0] * 4), (None, [3.0, 3.0, 3.0]), (None, [1.0, 1.0, 1.0]), (1, [9.0, 9.0, 9.0]), (2, good[2][1]), (2, good[2][1]),
    ]
    rows = [(i, v, "x", "y", 7, 8) for i, v in good + odd]
    df = spark.createDataFrame(rows, COLUMNS)
    for k in (1, 3, 40):
        found, centroids = simplex.cluster(df, k=k, rounds=3, dims=3)
        want, middles = _plain([r[:2] for r in rows], k, 3, 3)
        assert _rows(found) == want and centroids.tolist() == middles
        told = simplex.with_inertia(found, centroids).collect()
        assert {r["inertia"] for r in told} == {sum(w[2] for w in want)}
        for r in told:
            assert r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"])
            line = ",".join(map(str, middles[r["cluster"]]))
            assert r["centroid_sha256"] == hashlib.sha256(line.encode()).hexdigest()


def test_no_vectors(spark):
    for rows in ([], [(1, [1.0], "x", "y", 7, 8)]):
        found, centroids = simplex.cluster(spark.createDataFrame(rows, COLUMNS))
        assert found.collect() == [] and len(centroids) == 0
        assert simplex.with_inertia(found, centroids).collect() == []


def test_equal_vectors_only(spark):
    df = spark.createDataFrame([(i, [0.5] * 64) for i in range(50)], "vec_id long, embedding array<double>")
    found, centroids = simplex.cluster(df)
    assert {(r["cluster"], r["distance"]) for r in found.collect()} == {(0, 0)} and len(centroids) == 40


def test_components_too_large_for_squares(spark):
    df = spark.createDataFrame([(1, [1e300] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a component of"):
        simplex.cluster(df)


def test_bounds_hold_and_filter():
    draw = np.random.default_rng(5)
    middles = draw.normal(size=(20, 32)) * 300
    rows = (middles[draw.integers(0, 20, 2000)] + draw.normal(size=(2000, 32)) * 40).astype(np.int64)
    centroids = rows[:40]
    pivots = Pivots.choose(centroids, 12)
    own, apexes = pivots.apexes(centroids), pivots.apexes(rows)
    true = np.sqrt(simplex._squares(rows, centroids))
    flat = ((apexes[:, None, :-1] - own[None, :, :-1]) ** 2).sum(2)
    lower = np.sqrt(flat + (apexes[:, None, -1] - own[None, :, -1]) ** 2)
    upper = np.sqrt(flat + (apexes[:, None, -1] + own[None, :, -1]) ** 2)
    assert (lower <= true + 1e-3).all() and (true <= upper + 1e-3).all()
    number, squares, compared = nearest(rows, apexes, centroids, own)
    assert (number == simplex._squares(rows, centroids).argmin(1)).all() and (squares == simplex._squares(rows, centroids).min(1)).all()
    assert compared < 0.5 * true.size


def test_pivots_in_one_plane():
    flat = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 0], [10, 10, 0], [5, 5, 0]])
    assert len(Pivots.choose(flat, 5).vectors) == 3
    assert len(Pivots.choose(flat[:1].repeat(3, 0), 5).vectors) == 1
