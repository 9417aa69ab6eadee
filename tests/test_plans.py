"""Physical-plan properties that the scale design relies on."""

import pytest

from metalens.plans.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_limits_before_the_shuffle(spark):
    plan = REGISTRY["topn_per_dataset"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = REGISTRY["get_df_filters"](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "o_orderdate" not in plan


@pytest.mark.parametrize("name", ["lodo_avg_regret", "utility_topk", "similarity_all", "top_similarity_slice",
                                  "grid_fill_missing", "portfolio_k3", "node_landmarkers", "mf_full"])
def test_no_nested_loop_or_cartesian_join(spark, name):
    plan = _plan(REGISTRY[name](spark, SF_DIR))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
