"""One null, NaN or infinite score must not win, and must not spoil the others; signed-rank tests."""

import math
import random

import pytest
from pyspark.sql import functions as F

from metalens.operators import analysis, store
from metalens.operators.portfolio import greedy_portfolio
from metalens.plans import rankml, recommend

EVALS = "eval_id long, dataset_id long, pipeline_id long, score double, metric string"
ODD = [None, float("nan"), float("inf"), float("-inf")]


@pytest.fixture(params=ODD, ids=str)
def evals(request, spark):
    rows = [(1, 1, 10, 0.9), (2, 1, 11, 0.5), (3, 1, 12, 0.1), (4, 2, 10, 0.2), (5, 2, 11, 0.8), (6, 1, 13, request.param), (7, 2, 13, request.param)]
    return spark.createDataFrame([(*r, "neg_log_loss") for r in rows], EVALS)


def test_top_lists_hold_usable_scores_only(evals):
    top = store.top_n_per_dataset(evals, 1, "neg_log_loss").collect()
    assert sorted((r.dataset_id, r.pipeline_id) for r in top) == [(1, 10), (2, 11)]
    assert [r.eval_id for r in store.top_n_global(evals, 9, "neg_log_loss").collect()] == [1, 5, 2, 4, 3]
    assert {r.pipeline_id for r in store.candidate_set(evals, 5, "neg_log_loss").collect()} == {10, 11, 12}
    labels = store.relevance_labels(evals, 5, "neg_log_loss").collect()
    assert sorted((r.dataset_id, r.pipeline_id, r.relevance) for r in labels) == [(1, 10, 3), (1, 11, 2), (1, 12, 1), (2, 10, 1), (2, 11, 2)]


def test_matrix_portfolio_and_gaps(evals):
    matrix = recommend.results_matrix(evals, 5).collect()
    assert {(r.dataset_id, r.pipeline_id): round(r.regret, 9) for r in matrix} == {(1, 10): 0.0, (1, 11): 0.5, (1, 12): 1.0, (2, 10): 1.0, (2, 11): 0.0}
    turned = recommend.results_matrix(evals, 1, higher_is_better=False).collect()
    assert {(r.dataset_id, r.pipeline_id): round(r.regret, 9) for r in turned} == {(1, 12): 0.0, (1, 10): 1.0, (2, 10): 0.0}
    gaps = {r.pipeline_id: round(r.gap, 9) for r in rankml.mean_gap_to_best(evals).collect()}
    assert gaps == {10: 0.3, 11: 0.2, 12: 0.8}
    near = evals.sparkSession.createDataFrame([(1, 1)], "dataset_id long, rank long")
    assert [r.pipeline_id for r in recommend.top_similarity(evals, near, 4).orderBy("rank").collect()] == [10, 11, 12]


def test_portfolio_takes_a_missing_regret_as_failure(spark):
    cells = spark.createDataFrame([(1, 1, float("nan")), (2, 1, None), (1, 2, 0.2), (2, 2, 0.9)], "dataset_id long, pipeline_id long, regret double")
    picks = greedy_portfolio(cells, 2).collect()
    assert [(p.pipeline_id, round(p.gain, 9), round(p.total_regret, 9)) for p in picks] == [(2, 0.9, 1.1), (1, 0.0, 1.1)]


def brute_signed_ranks(pairs):
    d = [a - b for a, b in pairs if a != b]
    order = sorted(map(abs, d))
    rank = {v: sum(i for i, x in enumerate(order, 1) if x == v) / order.count(v) for v in set(order)}
    return len(d), sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0), sum(order.count(v) ** 3 - order.count(v) for v in set(order))


def test_signed_rank_sums_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [("control", i, rng.randrange(12) / 4) for i in range(300)]
    rows += [(name, i, None if i % 41 == 0 else rng.randrange(12) / 4 - shift) for name, shift in (("a", 0), ("b", 1), ("same", 0)) for i in range(300) if name != "same"]
    rows += [("same", i, s) for n, i, s in rows if n == "control"]
    frame = spark.createDataFrame(rows, "metalearner_name string, dataset_id long, score double")
    control = {i: s for n, i, s in rows if n == "control"}
    got = {r[0]: tuple(r)[1:] for r in analysis.signed_rank_sums(frame, "control", blocks=7).collect()}
    for name in ("a", "b"):
        assert got[name] == brute_signed_ranks([(control[i], s) for n, i, s in rows if n == name and s is not None])
    tests = {r.metalearner_name: r for r in analysis.signed_rank_tests(frame, "control").collect()}
    assert tests["b"].differs and not tests["same"].differs and tests["same"].n == 0 and tests["same"].p == 1.0


def test_counted_tails_equal_all_sign_choices(spark):
    for n in (1, 4, 7):
        sums = [sum(i + 1 for i in range(n) if s >> i & 1) for s in range(2**n)]
        assert all(analysis.signed_rank_tail(n, w) == sum(x <= w for x in sums) / 2**n for w in range(n * (n + 1) // 2 + 1))
    assert analysis.signed_rank_tail(8, 3) * 2 == pytest.approx(0.0390625)  # published: 3 is the critical value for n = 8 at 0.05
    rows = [("c", i, float(i)) for i in range(8)] + [("d", i, float(i) - (i + 1)) for i in range(8)]
    out = analysis.signed_rank_tests(spark.createDataFrame(rows, "metalearner_name string, dataset_id long, score double"), "c").first()
    assert out.w_plus == 36 and out.p == pytest.approx(2 / 256) and math.isclose(out.p_adjusted, out.p)
