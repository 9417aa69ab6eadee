"""Property checks on random small tables (few examples: each runs Spark jobs)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metalens.operators.analysis import tie_averaged_rank
from metalens.operators.sequence import running_max
from metalens.plans.recommend import with_regret

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.floats(-5, 0, allow_nan=False)),
                min_size=1, max_size=40))
def test_regret_in_unit_interval_and_zero_at_best(spark, rows):
    df = spark.createDataFrame([(i, d, p, s, "m", "r") for i, (d, p, s) in enumerate(rows)],
                               "eval_id long, dataset_id long, pipeline_id long, score double, metric string, logs_name string")
    out = with_regret(df, "m").collect()
    best = {}
    for _, d, _, s, _, _ in [(i, d, p, s, "m", "r") for i, (d, p, s) in enumerate(rows)]:
        best[d] = max(best.get(d, s), s)
    for r in out:
        assert 0.0 <= r["regret"] <= 1.0
        if r["score"] == best[r["dataset_id"]]:
            assert r["regret"] == 0.0


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 4), st.sampled_from([0.1, 0.2, 0.3, 0.5])), min_size=1, max_size=30))
def test_tie_averaged_ranks_sum_per_group(spark, rows):
    df = spark.createDataFrame([(g, float(s)) for g, s in rows], "dataset_id long, score double")
    sums = {r[0]: (r[1], r[2]) for r in tie_averaged_rank(df, "dataset_id", "score")
            .groupBy("dataset_id").agg(F.sum("rank"), F.count(F.lit(1))).collect()}
    for s, n in sums.values():
        assert s == n * (n + 1) / 2


@SETTINGS
@given(st.lists(st.floats(-1, 1, allow_nan=False), min_size=1, max_size=60), st.sampled_from([1, 3, 8, 1024]))
def test_running_max_any_block_size(spark, values, block):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "k long, i long, v double")
    got = [r["best_so_far"] for r in running_max(df, "k", "i", "v", block_size=block).orderBy("i").collect()]
    want, cur = [], None
    for v in values:
        cur = v if cur is None else max(cur, v)
        want.append(cur)
    assert got == want
