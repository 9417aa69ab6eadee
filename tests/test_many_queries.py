"""Similarity of many query datasets, and leave-one-out of the learners that use it."""

import math
import random

import pytest
from pyspark.sql import functions as F

from metalens.operators.similarity import many_vs_all, most_similar, one_vs_all
from metalens.plans import lodo, recommend

VECTORS = "dataset_id long, embedding array<double>"
EVALS = "eval_id long, dataset_id long, pipeline_id long, score double, metric string"


def vectors(n=90, seed=1):
    rng = random.Random(seed)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(n)]
    return rows + [(200, None), (220, [0.0] * 4), (240, [1.0, None, 1.0, 1.0]), (260, [1.0, 2.0]), (261, [2.0, 1.0]), (262, [1.0, float("nan"), 0.0, 0.0]), (280, [])]


def brute(rows, by, n):
    def value(a, b):
        if by == "cosine":
            return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
        d = math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))
        return d if by == "euclidean" else math.exp(-d)

    ok = {i: v for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and (by != "cosine" or any(v))}
    out = {}
    for q in (i for i in ok if i % 20 == 0):
        found = [(value(ok[q], v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])]
        out[q] = sorted(found, key=lambda f: (round(f[0] if by == "euclidean" else -f[0], 9), f[1]))[:n]
    return {q: f for q, f in out.items() if f}


@pytest.mark.parametrize("by", ["cosine", "euclidean", "kernel"])
def test_many_queries_equal_brute_force(spark, by):
    frame = spark.createDataFrame(vectors(), VECTORS).repartition(3)
    got = {}
    for r in many_vs_all(frame, lambda i: i % 20 == 0, None, by, shard_rows=2).collect():
        got.setdefault(r.query_id, {})[r.dataset_id] = r.value
    want = brute(vectors(), by, None)
    assert {q: set(f) for q, f in got.items()} == {q: {i for _, i in f} for q, f in want.items()}
    assert all(got[q][i] == pytest.approx(v) for q, f in want.items() for v, i in f)
    top = many_vs_all(frame, lambda i: i % 20 == 0, 3, by).collect()
    for q, f in want.items():
        own = sorted((r.rank, r.value) for r in top if r.query_id == q)
        assert [r for r, _ in own] == list(range(1, len(f[:3]) + 1)) and [v for _, v in own] == pytest.approx([v for v, _ in f[:3]])


def test_many_queries_equal_one_at_a_time(spark):
    rows = [r for r in vectors() if r[1] and len(r[1]) == 4 and None not in r[1] and any(r[1]) and all(math.isfinite(x) for x in r[1])]
    frame = spark.createDataFrame(rows, VECTORS)
    many = {(r.query_id, r.rank): r.value for r in many_vs_all(frame, lambda i: i == 40, 4).collect()}
    one = most_similar(one_vs_all(frame.filter("dataset_id <> 40"), frame.filter("dataset_id = 40")), 4).collect()
    assert [many[40, r.rank] for r in sorted(one, key=lambda r: r.rank)] == pytest.approx([r.cosine for r in sorted(one, key=lambda r: r.rank)])
    assert many_vs_all(frame.limit(0), lambda i: i == 40, 4).count() == 0
    with pytest.raises(ValueError):
        many_vs_all(frame, lambda i: i == 40, 4, "jaccard")


@pytest.fixture(scope="module")
def evals(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(12), rng.randrange(15), rng.choice([None, float("nan")]) if i % 29 == 0 else round(rng.random(), 3), "neg_log_loss") for i in range(400)]
    return spark.createDataFrame(rows, EVALS)


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(6)
    return spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(12)], VECTORS)


def test_leave_one_out_top_similarity_equals_separate_runs(spark, evals, stored):
    near = many_vs_all(stored, lambda i: i % 4 == 0, 3)
    got = {(r.held_out_id, r.rank): (r.pipeline_id, r.dataset_id) for r in lodo.lodo_top_similarity(evals, near, 7).collect()}
    want = {}
    usable = evals.filter("score IS NOT NULL AND NOT isnan(score)")
    for h in (0, 4, 8):
        own = most_similar(one_vs_all(stored.filter(F.col("dataset_id") != h), stored.filter(F.col("dataset_id") == h)), 3)
        for r in recommend.top_similarity(usable.filter(F.col("dataset_id") != h), own, 7).collect():
            want[h, r["rank"]] = r.pipeline_id, r.dataset_id
    assert got == want


def test_leave_one_out_utility_equals_separate_runs(spark, evals, stored):
    pipes = evals.select("pipeline_id").distinct()
    sims = many_vs_all(stored, lambda i: i % 4 == 0)
    got = {(r.held_out_id, r.rank): (r.pipeline_id, r.utility) for r in lodo.lodo_utility(evals, sims, 6).collect()}
    for h in (0, 4, 8):
        rest = evals.filter(F.col("dataset_id") != h)
        own = one_vs_all(stored.filter(F.col("dataset_id") != h), stored.filter(F.col("dataset_id") == h))
        for r in recommend.utility_online(recommend.utility_scores(rest, pipes, own), 6).collect():
            assert got[h, r["rank"]] == (r.pipeline_id, pytest.approx(r.utility, abs=1e-9))


def test_leave_one_out_utility_of_vectors_equals_that_of_similarities_without_rows_for_them(spark):
    rng = random.Random(5)
    rows = [*vectors(), (8, [1.0, 2.0, 0.0, -1.0]), (20, [1.0, 1.0, 0.0, 2.0]), (40, [2.0, 3.0]), (None, [1.0] * 4)]  # ids that come twice, also of two lengths
    stored = spark.createDataFrame(rows, VECTORS).repartition(3)
    cells = [(i, rng.choice([*range(90), 240, 260, 261, 500, None]), rng.choice([1, 1, 2, 3, *range(4, 20), None]), rng.choice([None, *[rng.random()] * 9]), rng.choice(["neg_log_loss"] * 4 + ["other"]))
             for i in range(1500)]
    evals = spark.createDataFrame(cells, EVALS)

    def is_held(i):
        return i % 20 == 0

    sims = many_vs_all(stored.filter("dataset_id IS NOT NULL"), is_held).withColumn("value", F.round("value", 10))
    want = sorted(map(tuple, lodo.lodo_utility(evals, sims, 6).collect()), key=lambda r: (r[0], r[2]))
    for sizes in ({}, {"held_block": 2, "stream_rows": 400, "chunk": 7}):
        out = lodo.lodo_utility_of_vectors(evals, stored, is_held, 6, **sizes)
        got = sorted(map(tuple, out.collect()), key=lambda r: (r[0], r[2]))
        assert [(r[0], r[2], r[1], r[4]) for r in got] == [(r[0], r[2], r[1], r[4]) for r in want]
        assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-10) and [r[5] for r in got] == [r[5] for r in want]


@pytest.mark.parametrize(("seed", "density"), [(1, 0.9), (2, 0.4), (3, 0.15)])
def test_leave_one_out_portfolios_equal_separate_greedy_runs(spark, seed, density):
    from metalens.operators.portfolio import greedy_portfolio, lodo_portfolios

    rng = random.Random(seed)
    cells = [(d, p, rng.choice([0.0, 0.25, 0.5, 0.75, round(rng.random(), 2)])) for d in range(9) for p in range(8) if rng.random() < density]
    matrix = spark.createDataFrame(cells, "dataset_id long, pipeline_id long, regret double")
    held = spark.createDataFrame([(0,), (3,), (6,), (99,)], "held_out_id long")
    got = {}
    for r in lodo_portfolios(matrix, held, 3).collect():
        got.setdefault(r.held_out_id, []).append((r.position, r.pipeline_id, round(r.gain, 9), round(r.total_regret, 9)))
    for h in (0, 3, 6, 99):
        own = greedy_portfolio(matrix.filter(F.col("dataset_id") != h), 3).collect()
        assert sorted(got[h]) == [(r.position, r.pipeline_id, round(r.gain, 9), round(r.total_regret, 9)) for r in own]
