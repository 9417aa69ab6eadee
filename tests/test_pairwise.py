"""Pairwise ranking against pairs formed one by one, and on planted preferences."""

import math
import random

import pytest
from pyspark.sql import functions as F

from metalens.plans import pairwise
from metalens.plans.rankml import fit_ranker, score_candidates


def test_gradients_equal_those_of_all_pairs(spark):
    rng = random.Random(2)
    rows = [(q, i, float(rng.randrange(4)), rng.gauss(0, 2)) for q in range(6) for i in range(rng.randrange(1, 12))]
    rows += [(9, 0, None, 1.0), (9, 1, 2.0, None), (9, 2, 1.0, 0.5), (9, 3, 3.0, float("nan")), (10, 0, 1.0, 0.0)]
    got = pairwise.pair_gradients(spark.createDataFrame(rows, "qid long, i long, relevance double, score double")).collect()
    usable = {(q, i): (y, s) for q, i, y, s in rows if y is not None and s is not None and not math.isnan(s)}
    for r in got:
        g = h = 0.0
        for (q, i), (y, s) in usable.items():
            if q == r.qid and (r.qid, r.i) in usable and y != r.relevance:
                term = math.exp(r.score - s) if y > r.relevance else math.exp(s - r.score)
                g, h = g + (term if y > r.relevance else -term), h + term
        assert r.gradient == pytest.approx(g, abs=1e-9) and r.curvature == pytest.approx(h, abs=1e-9)


def planted(n_queries, seed):
    """Within a dataset order comes from one number and one category; the labels' level comes from the dataset."""
    rng, rows = random.Random(seed), []
    for q in range(n_queries):
        level = rng.choice([0, 40, 80, 120, 160])
        items = [(rng.random(), rng.choice(["good", "fair", "poor"])) for _ in range(8)]
        order = sorted(range(8), key=lambda i: items[i][0] + {"good": 1.0, "fair": 0.4, "poor": 0.0}[items[i][1]])
        rows += [(q, q * 8 + i, float(level + order.index(i)), [level / 10 + rng.random(), items[i][0]], items[i][1]) for i in range(8)]
    return rows


def pair_accuracy(rows, scores):
    by, good, total = {}, 0, 0
    for q, i, y, *_ in rows:
        by.setdefault(q, []).append((y, scores[i]))
    for items in by.values():
        for y, s in items:
            for z, t in items:
                if y > z:
                    good, total = good + (s > t) + 0.5 * (s == t), total + 1
    return good / total


def test_pairwise_beats_pointwise_and_a_constant_on_planted_preferences(spark):
    schema = "qid long, pipeline_id long, relevance double, features array<double>, hash_0 string"
    train, test = planted(60, 1), planted(30, 2)
    frame = spark.createDataFrame(train, schema)
    held = spark.createDataFrame(test, schema)
    ranker = pairwise.fit_pairwise(frame, ["hash_0"], rounds=6, depth=4)
    own = {r.pipeline_id: r.predicted for r in ranker.score(held).collect()}
    coded = F.concat("features", F.array(F.when(F.col("hash_0") == "good", 2.0).when(F.col("hash_0") == "fair", 1.0).otherwise(0.0)))
    pointwise = fit_ranker(frame.withColumn("features", coded), max_iter=6, step_size=0.3, max_depth=4)
    other = {r.pipeline_id: r.predicted for r in score_candidates(pointwise, held.withColumn("features", coded)).collect()}
    mine, theirs = pair_accuracy(test, own), pair_accuracy(test, other)
    assert mine > 0.85 and mine > theirs + 0.1 and pair_accuracy(test, dict.fromkeys(own, 0.0)) == 0.5


def test_rare_categories_are_one_and_unknown_ones_are_scored(spark):
    schema = "qid long, pipeline_id long, relevance double, features array<double>, hash_0 string"
    rows = [(q, 10 * q + i, float(i), [float(i)], f"c{i}" if i < 2 else f"rare{q}{i}") for q in range(8) for i in range(5)]
    ranker = pairwise.fit_pairwise(spark.createDataFrame(rows, schema), ["hash_0"], rounds=2, depth=2, max_categories=2)
    assert ranker.known == {"hash_0": ["c0", "c1"]}
    new = spark.createDataFrame([(0, 1, None, [4.0], "never seen"), (0, 2, None, [0.0], None)], schema)
    out = {r.pipeline_id: r.predicted for r in ranker.score(new).collect()}
    assert out[1] > out[2]


def test_frames_without_pairs(spark):
    schema = "qid long, pipeline_id long, relevance double, features array<double>"
    alone = spark.createDataFrame([(q, q, 1.0, [float(q)]) for q in range(5)], schema)
    ranker = pairwise.fit_pairwise(alone, rounds=2)
    assert ranker.trees == [] and {r.predicted for r in ranker.score(alone).collect()} == {0.0}


def test_a_round_reads_its_gradients_from_memory(spark, monkeypatch):
    schema = "qid long, pipeline_id long, relevance double, features array<double>, hash_0 string"
    plans, own = [], pairwise.DecisionTreeRegressor.fit

    def fit(self, rows, *rest):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return own(self, rows, *rest)

    monkeypatch.setattr(pairwise.DecisionTreeRegressor, "fit", fit)
    ranker = pairwise.fit_pairwise(spark.createDataFrame(planted(20, 1), schema), ["hash_0"], rounds=2, depth=2)
    assert len(ranker.trees) == len(plans) == 2
    assert all("InMemoryTableScan" in p for p in plans)


def test_pointwise_ranker_fits_alike_rows_as_one_with_the_same_result(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    rng = random.Random(5)
    rows = [([float(i % 7), float(i % 3)], float(i % 7) + rng.gauss(0, 1)) for i in range(400)]
    frame = spark.createDataFrame(rows, "features array<double>, relevance double")
    seen, own = [], GBTRegressor.fit

    def fit(self, data, *rest):
        seen.append(data.count())
        return own(self, data, *rest)

    monkeypatch.setattr(GBTRegressor, "fit", fit)
    model = fit_ranker(frame, max_iter=8, step_size=0.3, max_depth=3)
    assert seen == [21]  # not 400
    data = frame.select(array_to_vector("features").alias("features"), F.col("relevance").alias("label"))
    plain = own(GBTRegressor(maxIter=8, stepSize=0.3, maxDepth=3, seed=0), data)
    asked = frame.select("features").distinct().withColumn("pipeline_id", F.col("features")[0] * 10 + F.col("features")[1])
    got, want = ({r.pipeline_id: r.predicted for r in score_candidates(m, asked).collect()} for m in (model, plain))
    assert len(got) == 21 and got == pytest.approx(want, abs=1e-9)
