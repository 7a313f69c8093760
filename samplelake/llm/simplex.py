"""Clustering of whole-number vectors around centroids, with distances bounded from apexes.

A few pivots span a simplex. The distances of any vector to the pivots are the edges of one more
vertex, the apex, whose coordinates follow from them: all but the last lie in the space that the
pivots span, the last is the height over it and not negative. The Euclidean distance of two
apexes is no more than that of their vectors; with one of the heights turned down it is no less.
So a vector's apex, found once and kept, tells which centroids cannot be its nearest: those
whose lower bound is over the least upper bound. The rest are compared in whole numbers.

Centroids and pivots are few, whatever the number of vectors, and are all that passes through
the driver. Each task adds up its vectors by cluster before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplelake.session import materialise

PIVOTS = 24
#: A pivot is at least this share of the first one's distance over the simplex of those before,
#: which bounds the rounding of apexes far below ``SLACK``.
LEAST_HEIGHT = 0.02
#: By how much of the largest square a bound may be off.
SLACK = 1e-7
#: Larger components would not leave room for their squares.
LARGEST = 1 << 27
#: Numbers that a task compares at once, and vectors whose bounds it holds.
EXACT, ROWS = 1 << 19, 1 << 12


@dataclass(frozen=True)
class Pivots:
    """``vectors`` of whole numbers, the coordinates ``base`` of their simplex, one row each,
    the first at the origin and each other with one coordinate more than the one before."""

    vectors: np.ndarray
    base: np.ndarray

    @classmethod
    def choose(cls, candidates: np.ndarray, most: int = PIVOTS) -> Pivots:
        """The first candidate, then again and again the one highest over the simplex."""
        vectors, base = candidates[:1], np.zeros((1, 0))
        first = 0.0
        while len(vectors) < most:
            apexes = cls(vectors, base).apexes(candidates)
            best = int(np.argmax(apexes[:, -1]))
            height = apexes[best, -1]
            first = first or height
            if height <= LEAST_HEIGHT * first:
                break
            vectors = np.concatenate((vectors, candidates[best : best + 1]))
            base = np.concatenate((np.pad(base, ((0, 0), (0, 1))), apexes[best : best + 1]))
        return cls(vectors, base)

    def squares(self, rows: np.ndarray) -> np.ndarray:
        """Squared distances of the rows to the pivots."""
        return _squares(rows, self.vectors)

    def apexes(self, rows: np.ndarray) -> np.ndarray:
        """One row of coordinates each, the height last."""
        squares = self.squares(rows).astype(np.float64)
        sides = self.base[1:]
        if not len(sides):
            return np.sqrt(squares)
        # By the difference of two pivots' equations the apex is on a plane for each side.
        planes = (squares[:, :1] + (sides**2).sum(1) - squares[:, 1:]) / 2
        flat = np.linalg.solve(sides, planes.T).T
        height = np.sqrt(np.maximum(squares[:, 0] - (flat**2).sum(1), 0))
        return np.column_stack((flat, height))


def _squares(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to a few others."""
    out = np.empty((len(rows), len(others)), np.int64)
    for i, other in enumerate(others):
        apart = rows - other
        out[:, i] = np.einsum("ij,ij->i", apart, apart)
    return out


def nearest(rows: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row, the first of equals, its squared distance, and how many
    pairs were compared in full. ``own`` are the apexes of the centroids."""
    flat = (apexes[:, None, :-1] - own[None, :, :-1]) ** 2
    flat = flat.sum(2)
    lower = flat + (apexes[:, None, -1] - own[None, :, -1]) ** 2
    upper = flat + (apexes[:, None, -1] + own[None, :, -1]) ** 2
    # No number that goes into a bound is larger.
    slack = SLACK * (upper.max(1, initial=0) + 1)
    row, number = np.nonzero(lower <= (upper.min(1) + slack)[:, None])
    squares = np.empty(len(row), np.int64)
    for at in range(0, len(row), step := max(1, EXACT // rows.shape[1])):
        apart = rows[row[at : at + step]] - centroids[number[at : at + step]]
        squares[at : at + step] = np.einsum("ij,ij->i", apart, apart)
    by = np.lexsort((number, squares, row))
    first = by[np.concatenate(([True], row[by][1:] != row[by][:-1]))] if len(by) else by
    return number[first], squares[first], len(row)


def _matrix(column: pa.Array) -> np.ndarray:
    size = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), size)


def _parts(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, own: np.ndarray):
    """Of some rows at a time: the batch, the vectors, their clusters and squared distances."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            rows = _matrix(batch.column("own"))
            apexes = batch.column("apex").flatten().to_numpy().reshape(len(rows), -1)
            cluster, squares, _ = nearest(rows, apexes, centroids, own)
            yield batch, rows, cluster, squares


def whole_vectors(vectors: DataFrame, column: Column, scale: int, dims: int) -> DataFrame:
    """``vec_id, own`` of the rows whose vector has ``dims`` components, none of them null or
    not finite: floor(``scale`` x) of each. Components of ``LARGEST`` or more raise an error."""
    double = F.transform(column, lambda x: x.cast("double"))
    sound = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(double, lambda x: F.floor(x * scale))
    fits = F.forall(double, lambda x: F.abs(x * scale) < LARGEST)
    checked = F.when(fits, scaled.cast("array<int>")).otherwise(
        F.raise_error(F.lit(f"a component of {LARGEST // scale} or more")).cast("array<int>")
    )
    some = vectors.filter((F.size(column) == dims) & F.coalesce(sound, F.lit(False)))
    return some.select(F.col("vec_id").cast("bigint").alias("vec_id"), checked.alias("own"))


def _with_apexes(kept: DataFrame, pivots: Pivots) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                apexes = pivots.apexes(_matrix(batch.column("own")))
                ends = np.arange(0, apexes.size + 1, apexes.shape[1])
                apex = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(apexes.ravel()))
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "own": batch.column("own"), "apex": apex})

    return kept.mapInArrow(run, "vec_id bigint, own array<int>, apex array<double>")


def _sums(stored: DataFrame, centroids: np.ndarray, own: np.ndarray) -> list:
    """Number and componentwise sums of the vectors of each cluster."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, rows, cluster, _ in _parts(batches, centroids, own):
            counts += np.bincount(cluster, minlength=len(counts))
            by = np.argsort(cluster, kind="stable")
            some, starts = np.unique(cluster[by], return_index=True)
            sums[some] += np.add.reduceat(rows[by], starts)
        some = np.flatnonzero(counts)
        places = np.tile(np.arange(dims), len(some))
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(np.repeat(some, dims), pa.int32()), "place": pa.array(places, pa.int32()),
            "n": np.repeat(counts[some], dims), "total": sums[some].ravel(),
        })

    rows = stored.mapInArrow(run, "cluster int, place int, n bigint, total bigint")
    # A row for each component of each cluster.
    return rows.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


SCHEMA = "vec_id bigint, cluster int, distance bigint"


def cluster(
    vectors: DataFrame, column: str = "embedding", *, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256,
    seed: str = "2:", pivots: int = PIVOTS,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every vector, as a stored table, and the centroids.

    Vectors with another number of components than ``dims``, or with null or non-finite ones,
    are left out; the others become floor(``scale`` x). The centroids start as the ``k``
    vectors with the smallest sha256 of ``seed`` and ``vec_id`` (rows that share an id by their
    components, null ids last), or fewer if there are fewer. In each of ``rounds`` rounds every vector goes to
    the nearest (squared Euclidean distance; ties: the smaller number), and every centroid that
    has vectors becomes their mean, rounded down. ``distance`` is squared. Repeated rows all
    count. Without any vector both results are empty.
    """
    kept = whole_vectors(vectors, F.col(f"`{column}`"), scale, dims)
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), "own").limit(k).collect()
    if not first:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), np.zeros((0, dims), np.int64)
    centroids = np.array([r["own"] for r in first], np.int64)
    chosen = Pivots.choose(centroids, pivots)
    stored = materialise(_with_apexes(kept, chosen), "apexes")
    for _ in range(rounds):
        moved = centroids.copy()
        for r in _sums(stored, centroids, chosen.apexes(centroids)):
            moved[r["cluster"], r["place"]] = r["total"] // r["n"]
        centroids = moved
    own = chosen.apexes(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, number, squares in _parts(batches, centroids, own):
            yield pa.RecordBatch.from_pydict(
                {"vec_id": batch.column("vec_id"), "cluster": pa.array(number, pa.int32()), "distance": squares}
            )

    return materialise(stored.mapInArrow(assign, SCHEMA), "clusters"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows of ``cluster``, with ``cluster_inertia`` and ``inertia``, the distances summed
    over the cluster and over all, and ``centroid_sha256`` of the centroid's components."""
    # One row per centroid.
    sums = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    every = sum(sums.values())
    rows = [(i, sums.get(i, 0), every, digest(c)) for i, c in enumerate(centroids)]
    told = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select(*found.columns, *told.columns[1:])
