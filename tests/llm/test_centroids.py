import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metalens.llm import centroids as ce

DIMS = 4


def brute(rows, k, rounds, dims=DIMS, scale=256, seed=2):
    """Sorted (id, cluster, distance), and the final centroids."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]

    def own(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(own(v)[1], []).append(v)
        cs = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(cs)]
    return sorted(((i, n, d) for i, v in kept for d, n in [own(v)]), key=str), cs


def awkward_vectors():
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) + (i % 5) for _ in range(DIMS)]) for i in range(300)]
    rows += [(1000 + i, [0.5, -0.25, 0.0, -1.0]) for i in range(150)]  # copies
    rows += [(2000 + i, [float(x) for x in (i % 2, 0, 0, 0)]) for i in range(20)]  # ties
    return rows + [(1, [0.0] * DIMS), (1, [0.0] * DIMS), (None, [1.0] * DIMS), (None, [2.0] * DIMS), (3001, None), (3002, []), (3003, [1.0] * 3), (3004, [1.0] * 5),
                   (3005, [1.0, None, 1.0, 1.0]), (3006, [1.0, float("nan"), 1.0, 1.0]), (3007, [1.0, float("inf"), 1.0, 1.0]), (3008, [1.0, 1.0, float("-inf"), 1.0])]


def frame(spark, rows):
    out = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("x", "to_pivots", "cluster", "distance", "component", "total", "label"):
        out = out.withColumn(name, F.lit("own"))
    return out


@pytest.mark.parametrize(("k", "rounds"), [(12, 5), (1, 1), (40, 0)])
def test_clusters_equal_brute_force(spark, k, rounds):
    rows = awkward_vectors()
    got = ce.cluster(frame(spark, rows).repartition(5), k=k, rounds=rounds, dims=DIMS)
    want, cs = brute(rows, k, rounds)
    assert got.centroids == cs
    out = got.with_inertia().collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in out), key=str) == want
    assert {r.inertia for r in out} == {sum(d for _, _, d in want)}
    assert {(r.cluster, r.cluster_inertia) for r in out} == {(n, sum(d for _, m, d in want if m == n)) for _, n, _ in want}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[r.cluster])).encode()).hexdigest() for r in out)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(5, [1.0, 2.0, 3.0, 4.0]), (6, [1.0, 2.0, 3.0, 4.0]), (7, [-1.0, 0.0, 0.0, 0.0])]
    got = ce.cluster(frame(spark, rows), dims=DIMS)
    want, cs = brute(rows, 40, 5)
    assert got.centroids == cs and len(cs) == 3  # one of the equal ones stays without vectors
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got.assigned.collect()) == want
    assert ce.cluster(frame(spark, []), dims=DIMS).with_inertia().count() == 0
    assert ce.cluster(frame(spark, [(1, None), (2, [1.0])]), dims=DIMS).with_inertia().count() == 0


def test_components_whose_distances_do_not_fit_raise(spark):
    with pytest.raises(Exception, match="not supported"):
        ce.cluster(frame(spark, [(1, [1e30, 0.0, 0.0, 0.0])]), dims=DIMS)


@pytest.mark.parametrize("spread", [3, 300, 1 << 26])
def test_bounds_never_exceed_distances_and_spare_work(spread):
    rng = np.random.default_rng(spread)
    centers = rng.integers(-spread, spread, (12, 16))
    x = np.concatenate((rng.integers(-spread, spread, (400, 16)), centers[rng.integers(0, 12, 400)] + rng.integers(-2, 3, (400, 16)), centers))
    pivots = ce.Pivots.chosen(centers)
    to_x, to_c = pivots.distances(x), pivots.distances(centers)
    real = np.array([[sum(int(d) ** 2 for d in a - b) for b in centers] for a in x], dtype=object)
    assert all(low <= int(r) for low, r in zip(pivots.bounds(to_x, to_c).ravel().tolist(), real.ravel(), strict=True))
    own, distance, measured = ce.nearest(x, to_x, centers, to_c, pivots)
    want = [min((d, n) for n, d in enumerate(r)) for r in real.tolist()]
    assert [(d, n) for n, d in zip(own.tolist(), distance.tolist(), strict=True)] == want
    if spread > 3:
        assert measured < 0.75 * real.size
