"""Fitting and scoring pipelines with pyspark.ml.

A pipeline's steps table (algorithm, params) becomes a ``pyspark.ml.Pipeline``
for the algorithms that have a pyspark.ml counterpart. Rows are encoded
by their training part alone (``operators.encoding``). Scoring is negative
log loss from ``MulticlassClassificationEvaluator`` on a hold-out split or
averaged over k folds. Labels are indexed on the whole dataset, so a class
missing from the test part keeps its index (the reference re-encoded the test
labels on their own).
"""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metalens.operators.encoding import Encoding, with_vectors
from metalens.session import materialize

# Algorithm names of the stand-in notation mapped to pyspark.ml stages.
ALGORITHMS = ("Tree", "Forest", "Bayes", "Scaler", "Pca")
#: The deepest tree that pyspark.ml grows.
MAX_DEPTH = 30


def encoded_splits(cells: DataFrame, labels: DataFrame, dataset_id: int, folds: int | None = None, train_fraction: float = 0.8, seed: int = 0) -> DataFrame:
    """One dataset encoded for each of ``folds`` hash folds, or for one hold-out split.

    Returns (held, in_test, row_id, label, size, features): every row once per
    held fold, encoded by what that fold's training rows teach. Written once,
    as each fit and each evaluation reads it.
    """
    from metalens.operators.landmarkers import hash_folds
    from metalens.operators.views import holdout_split

    own = labels.filter((F.col("dataset_id") == dataset_id) & F.col("y").isNotNull())
    if folds:
        split, held = hash_folds(own, folds, seed), list(range(folds))
    else:
        split, held = holdout_split(own, "row_id", train_fraction, seed).withColumn("fold", F.col("is_train").cast("int")).drop("is_train"), [0]
    frame = with_vectors(Encoding(cells.filter(F.col("dataset_id") == dataset_id), split, held).encoded())
    frame = StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc").fit(own).transform(frame)
    return materialize(frame.select("held", "in_test", "row_id", "label", "size", "features"))


def build_pipeline(steps: list[tuple[str, dict[str, str]]], n_features: int) -> Pipeline:
    """Stages for the steps in execution order; unknown algorithms and values that pyspark.ml has not raise."""
    stages, col = [], "features"
    for i, (algo, params) in enumerate(steps):
        out = f"f{i}"
        if algo == "Scaler":
            stages.append(StandardScaler(inputCol=col, outputCol=out, withMean=True, withStd=True))
        elif algo == "Pca":
            k = int(params.get("k", n_features))
            if not 1 <= k <= n_features:
                raise ValueError(f"{k} components of {n_features} features")
            stages.append(PCA(k=k, inputCol=col, outputCol=out))
            n_features = k
        elif algo == "Tree":
            depth = int(params.get("depth", 5))
            if not 0 <= depth <= MAX_DEPTH:
                raise ValueError(f"a tree of depth {depth}")
            stages.append(DecisionTreeClassifier(featuresCol=col, maxDepth=depth, seed=0))
            out = col
        elif algo == "Forest":
            stages.append(RandomForestClassifier(featuresCol=col, numTrees=int(params.get("n", 20)), seed=0))
            out = col
        elif algo == "Bayes":
            stages.append(NaiveBayes(featuresCol=col, modelType="gaussian"))
            out = col
        else:
            raise ValueError(f"no pyspark.ml stage for algorithm {algo}")
        col = out
    return Pipeline(stages=stages)


def neg_log_loss(model, test: DataFrame) -> float:
    pred = model.transform(test)
    ev = MulticlassClassificationEvaluator(metricName="logLoss", labelCol="label", probabilityCol="probability")
    return -float(ev.evaluate(pred))


def split_score(frame: DataFrame, pipeline: Pipeline, held: list[int]) -> float | None:
    """Mean negative log loss over the held folds of an ``encoded_splits`` frame; None if any of them fails."""
    scores = []
    try:
        for h in held:
            own = frame.filter(F.col("held") == h)
            scores.append(neg_log_loss(pipeline.fit(own.filter(~F.col("in_test"))), own.filter("in_test")))
    except IllegalArgumentException:  # a pipeline that can't be fitted scores None; Spark's own failures surface
        return None
    return sum(scores) / len(scores) if scores else None


def steps_of(steps: DataFrame, params: DataFrame, pipeline_ids: list[int]) -> dict[int, list[tuple[str, dict]]]:
    """Steps with parameters for a bounded list of pipelines (the recommendations)."""
    s = steps.filter(F.col("pipeline_id").isin(pipeline_ids)).collect()
    p = params.filter(F.col("pipeline_id").isin(pipeline_ids)).collect()
    out: dict[int, list[tuple[str, dict]]] = {}
    for r in sorted(s, key=lambda r: (r["pipeline_id"], r["pos"])):
        kv = {q["param"]: q["value"] for q in p if q["pipeline_id"] == r["pipeline_id"] and q["step_no"] == r["step_no"]}
        out.setdefault(int(r["pipeline_id"]), []).append((r["algorithm"], kv))
    return out


def score_recommendations(spark, recs: list[int], frame: DataFrame, steps: DataFrame, params: DataFrame, parallelism: int = 4) -> DataFrame:
    """(rank, pipeline_id, neg_log_loss) for each recommended pipeline; null when it fails.

    ``frame`` comes from ``encoded_splits``. The fits are independent Spark jobs;
    they are submitted from a small thread pool so that several run at once on
    the cluster (Spark schedules concurrent jobs from different driver threads).
    """
    from concurrent.futures import ThreadPoolExecutor

    plans = steps_of(steps, params, recs)
    sizes = {r["held"]: r["size"] for r in frame.groupBy("held").agg(F.min("size").alias("size")).collect()}  # a row per fold

    def one(item):
        rank, pid = item
        try:
            score = split_score(frame, build_pipeline(plans.get(pid, []), min(sizes.values(), default=0)), sorted(sizes))
        except ValueError:
            score = None
        return rank, pid, score

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(recs)))) as pool:
        rows = list(pool.map(one, enumerate(recs, start=1)))
    return spark.createDataFrame(rows, "rank long, pipeline_id long, neg_log_loss double")
