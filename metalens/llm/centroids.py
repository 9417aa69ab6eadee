"""Centroid clustering of vectors in whole numbers, with Ptolemaic lower bounds on distances.

Components become integers, so distances, sums and means are exact and do not
depend on how rows are spread. Some of the first centroids are pivots, and each
vector's distances to them are computed once and kept with it. For a vector x, a
centroid c and pivots p, q, Ptolemy's inequality

    d(x, c) * d(p, q) >= |d(x, p) * d(c, q) - d(x, q) * d(c, p)|

bounds the distance from below by cached numbers alone. The bound over all pivot
pairs is rounded down by more than the arithmetic can be off; the centroid of
least bound is measured, and every other one whose bound does not exceed that
distance is measured too, so the nearest is exact, ties included.

A round is a map over the vectors that gives each task's sums by centroid and
component, and one aggregate of those; the driver gets ``k * (dims + 1)`` numbers,
whatever the number of vectors. Nothing else is shuffled.

Cases: vectors of another length, null ones and those with a null or non-finite
component take no part; repeated ids and equal vectors are vectors of their own;
of fewer vectors than ``k`` each is a centroid; null ids come last in the choice
of the first centroids; a centroid without vectors stays where it is; an empty
table gives an empty result. Components beyond ``LIMIT`` after scaling raise, as
their distances would not fit a long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

N_CENTROIDS, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
#: Pivots, of which all pairs give bounds.
N_PIVOTS = 6
#: Largest absolute value of a scaled component: 64 squared differences of such fit a long.
LIMIT = 1 << 27
#: Vectors compared at once inside a task.
SLICE_ROWS = 1024
#: Relative error that a bound allows for, well above that of a few double operations.
_SLACK = 1e-13


def whole_vectors(batch: pa.RecordBatch, dims: int, scale: float) -> tuple[pa.Array, np.ndarray]:
    """Ids and scaled integer components of the batch's vectors (id, list of doubles of length ``dims``) without null or non-finite components."""
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls turn into NaN
    kept = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * x[kept])
    if scaled.size and np.abs(scaled).max() > LIMIT:
        raise ValueError(f"components over {LIMIT / scale:g} are not supported")
    return batch.column(0).filter(pa.array(kept)), scaled.astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of vectors in the last axis, exact."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


@dataclass(frozen=True)
class Pivots:
    """Fixed points, and the pairs of them that give bounds."""

    points: np.ndarray
    pairs: tuple[tuple[int, int], ...]

    @staticmethod
    def chosen(centroids: np.ndarray, n: int = N_PIVOTS) -> Pivots:
        """Up to ``n`` distinct centroids, each farthest from those before it."""
        picked = [0]
        least = squared(centroids, centroids[0])
        while len(picked) < min(n, len(centroids)) and least.max() > 0:
            picked.append(int(least.argmax()))
            least = np.minimum(least, squared(centroids, centroids[picked[-1]]))
        return Pivots(centroids[picked], tuple(combinations(range(len(picked)), 2)))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(squared(x[:, None, :], self.points[None]).astype(float))

    def bounds(self, of_x: np.ndarray, of_c: np.ndarray) -> np.ndarray:
        """Lower bound of the squared distance of each x to each c, from their distances to the pivots."""
        low = np.zeros((len(of_x), len(of_c)))
        for p, q in self.pairs:
            one, other = np.multiply.outer(of_x[:, p], of_c[:, q]), np.multiply.outer(of_x[:, q], of_c[:, p])
            apart = np.sqrt(float(squared(self.points[p], self.points[q])))
            low = np.maximum(low, (np.abs(one - other) - _SLACK * (one + other)) / apart)
        return low * low * (1 - _SLACK)


def nearest(x: np.ndarray, of_x: np.ndarray, centroids: np.ndarray, of_c: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, its squared distance, distances measured); of equally near ones the first."""
    low, rows = pivots.bounds(of_x, of_c), np.arange(len(x))
    guess = low.argmin(axis=1)
    best = squared(x, centroids[guess])
    left = low <= best[:, None].astype(float) * (1 + _SLACK)
    left[rows, guess] = False
    row, c = np.nonzero(left)
    measured = np.full(low.shape, np.iinfo(np.int64).max)
    measured[rows, guess] = best
    measured[row, c] = squared(x[row], centroids[c])
    own = measured.argmin(axis=1)
    return own, measured[rows, own], len(x) + len(row)


@dataclass
class Clustering:
    """``assigned``: (vec_id, cluster, distance) of each vector taken; ``centroids``: the final ones."""

    assigned: DataFrame
    centroids: list[list[int]]

    def centroid_sha256(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]

    def with_inertia(self) -> DataFrame:
        """``assigned`` with cluster_inertia, inertia and centroid_sha256."""
        sums = {r["cluster"]: int(r["s"]) for r in self.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
        rows = [(c, sums.get(c, 0), sum(sums.values()), sha) for c, sha in enumerate(self.centroid_sha256())]
        table = self.assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return self.assigned.join(F.broadcast(table), "cluster")  # a row per centroid


def cluster(vectors: DataFrame, k: int = N_CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: int = 2,
            n_pivots: int = N_PIVOTS, id_col: str = "vec_id", vec_col: str = "embedding") -> Clustering:
    """Lloyd's rounds from the ``k`` vectors with the smallest sha256 of ``seed:id``, and a last assignment."""
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")).filter(F.size("x") == dims)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = whole_vectors(batch, dims, scale)
            yield pa.RecordBatch.from_arrays([ids, _lists(x)], names=["vec_id", "x"])

    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    first = source.mapInArrow(scaled, "vec_id long, x array<long>").orderBy(order, "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, dims)
    if not len(centroids):
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), [])
    pivots = Pivots.chosen(centroids, n_pivots)

    def cached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = whole_vectors(batch, dims, scale)
            for at in range(0, len(x), SLICE_ROWS):
                part = x[at:at + SLICE_ROWS]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), _lists(part), _lists(pivots.distances(part))], names=["vec_id", "x", "to_pivots"])

    kept = written(source.mapInArrow(cached, "vec_id long, x array<long>, to_pivots array<double>"), "clustered-vectors")

    def slices(batch: pa.RecordBatch, now: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        x, of_x = (batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (1, 2))
        of_c = pivots.distances(now)
        for at in range(0, len(x), SLICE_ROWS):
            part = x[at:at + SLICE_ROWS]
            yield at, part, *nearest(part, of_x[at:at + SLICE_ROWS], now, of_c, pivots)[:2]

    def summed(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(now), dims + 1), np.int64)  # a task's; the last column counts
            for batch in batches:
                for _, part, own, _ in slices(batch, now):
                    np.add.at(sums, own, np.concatenate((part, np.ones((len(part), 1), np.int64)), axis=1))
            c, component = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(component.astype(np.int32)), pa.array(sums[c, component])], names=["cluster", "component", "total"])
        return run

    for _ in range(rounds):
        totals = kept.mapInArrow(summed(centroids), "cluster int, component int, total long").groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        found = {(r["cluster"], r["component"]): int(r["total"]) for r in totals.collect()}  # at most k * (dims + 1) rows
        moved = [[found.get((c, i), 0) // found[c, dims] for i in range(dims)] if (c, dims) in found else row for c, row in enumerate(centroids.tolist())]
        centroids = np.array(moved, np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part, own, distance in slices(batch, centroids):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(own.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return Clustering(written(kept.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters"), centroids.tolist())


def _lists(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32) if values.shape[1] else np.zeros(len(values) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel()))
