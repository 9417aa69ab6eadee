import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metalens.llm import neighbour_graph as ng
from metalens.sources.tables import table

SF = "/root/testdata/sf0.1"


def brute(rows, k):
    """{row number of a query: [(score, vec_id), ...]} for rows (vec_id, vector)."""
    taken = [(n, i, v) for n, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, i, v in taken:
        if i is not None and i % 20 == 0:
            others = [(-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j) for m, j, w in taken if m != n and len(w) == len(v)]
            out[n] = [(-s, j) for s, _, j in sorted(others, key=lambda o: (o[0], o[1], o[2] or 0))[:k]]
    return out


def awkward_vectors():
    """Whole-number components, so that inner products are exact and ties are real."""
    rng = random.Random(21)
    rows = [(i, [float(rng.randrange(-9, 10)) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [3.0, 0.0, -2.0, 1.0, 0.0, 5.0]) for i in range(200)]  # copies
    rows += [(2000 + i, [float(rng.randrange(-3, 4)) for _ in range(3)]) for i in range(60)]  # another length
    rows += [(20, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (20, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (None, [9.0] * 6), (None, [3.0, 0.0, -2.0, 1.0, 0.0, 5.0]), (3000, [7.0] * 5), (3020, [-0.0, 0.0, 1.0, 0, 0, 0])]
    return rows + [(4000, None), (4020, []), (4040, [0.0] * 6), (4060, [1.0, None, 1, 1, 1, 1]), (4080, [1.0, float("nan"), 1, 1, 1, 1]), (4100, [float("inf")] * 6)]


def frame(spark, rows):
    out = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    for name in ("x", "key", "query", "score", "rank", "place", "shard", "dims", "node", "links", "members", "label"):
        out = out.withColumn(name, F.lit("own"))
    return out


def results(out):
    by = {}
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    return by


def test_awkward_vectors_equal_brute_force(spark):
    rows = awkward_vectors()
    got = ng.nearest(frame(spark, rows).repartition(5), lambda i: i % 20 == 0, 20, min_shards=3, search_beam=500)
    want = {}
    for n, found in brute(rows, 20).items():
        want.setdefault(rows[n][0], []).extend((rank, s, j) for rank, (s, j) in enumerate(found, 1))
    got = results(got)
    assert {i: sorted(v, key=str) for i, v in got.items()} == {i: sorted(v, key=str) for i, v in want.items() if v}
    assert all([r for r, _, _ in v] == list(range(1, len(v) + 1)) for i, v in got.items() if i != 20)


def test_empty_and_tiny_tables(spark):
    assert ng.nearest(frame(spark, []), lambda i: i % 20 == 0).count() == 0
    assert ng.nearest(frame(spark, [(20, [1.0, 2.0])]), lambda i: i % 20 == 0).count() == 0
    assert results(ng.nearest(frame(spark, [(20, [1.0, 2.0]), (21, [3.0, 1.0]), (40, None)]), lambda i: i % 20 == 0)) == {20: [(1, 5.0, 21)]}


@pytest.mark.parametrize("min_shards", [1, 16])
def test_recall_against_all_rows(spark, min_shards):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = results(ng.nearest(table(spark, SF, "embeddings"), lambda i: i % 20 == 0, 20, min_shards=min_shards))
    hits = total = 0
    for n in np.flatnonzero(ids % 20 == 0):
        score = x @ x[n]
        score[n] = -np.inf
        best = set(ids[np.argsort(-score)[:20]].tolist())
        own = got[ids[n]]
        assert [r for r, _, _ in own] == list(range(1, 21)) and [s for _, s, _ in own] == sorted((s for _, s, _ in own), reverse=True)
        assert all(abs(s - score[np.flatnonzero(ids == j)[0]]) < 1e-12 for _, s, j in own)
        hits, total = hits + len(best & {j for _, _, j in own}), total + 20
    assert hits / total > 0.97


@pytest.mark.parametrize("kind", ["spread", "clusters", "norms", "one line"])
def test_graph_reaches_every_node_and_finds_the_nearest(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    if kind == "clusters":
        x = rng.normal(size=(6, 16))[rng.integers(0, 6, 1500)] + 0.02 * x
    if kind == "norms":
        x *= rng.exponential(size=(1500, 1)) + 0.01
    if kind == "one line":
        x = np.arange(1, 1501)[:, None] * np.ones((1, 16))
    x = x[ng.by_norm(x)]
    graph = ng.Graph(x)
    front = ng.entries(1500).tolist()
    reached = set(front)
    while front:
        front = [j for i in front for j in graph.neighbours()[i].tolist() if j not in reached and not reached.add(j)] if len(reached) < 1500 else []
    assert len(reached) == 1500
    again = ng.Graph.of_links(x, graph.neighbours())
    q = x[::30]
    found = again.query(q, 128)
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(best.tolist(), found[:, :20].tolist(), strict=True)]) > 0.9


def test_pruning_keeps_the_nearest_and_drops_what_it_covers():
    graph = ng.Graph(np.array([[1.0, 0.0], [0.0, 1.0], [0.99, 0.1], [0.98, 0.15], [-1.0, 0.0]]), degree=4)
    others = np.arange(1, 5)
    graph._relink(np.array([0]), np.zeros(4, int), others, np.einsum("ij,ij->i", graph.x[others], graph.x[[0] * 4]))
    kept = graph.links[0][graph.links[0] >= 0].tolist()
    assert kept[0] == 2 and 3 not in kept and 1 in kept
