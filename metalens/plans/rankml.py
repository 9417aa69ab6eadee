"""Learned ranking of pipelines (RankML): training frame, ranker, ranked top-k.

Training rows are each dataset's best ``n_models`` evaluations with relevance
labels n..1 (query id = dataset); features are the dataset's characterization
vector followed by the pipeline's characterization vector. pyspark.ml has no
pairwise ranker, so a pointwise gradient-boosted regressor is fit on the
relevance labels with the reference's settings (150 rounds, step 0.1, depth 8).
Its loss is squared, so rows with equal features teach it what one row of their
mean relevance and their number as weight does; they are fitted as that row.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metalens.functions.regret import valid_score
from metalens.operators.store import relevance_labels, top_n_per_dataset
from metalens.session import ensure_checkpoint_dir, materialize


def training_frame(evals: DataFrame, dataset_vecs: DataFrame, pipe_vecs: DataFrame, n_models: int,
                   metric: str = "neg_log_loss") -> DataFrame:
    """(qid, dataset_id, pipeline_id, relevance, features array<double>).

    Two equi-joins: the per-dataset and per-pipeline vectors are one row per
    key, so AQE broadcasts them when small and shuffles by key otherwise.
    """
    lab = relevance_labels(evals, n_models, metric)
    dv = dataset_vecs.select("dataset_id", F.col("values").cast("array<double>").alias("dvec"))
    pv = pipe_vecs.select("pipeline_id", F.col("values").cast("array<double>").alias("pvec"))
    return (lab.join(dv, "dataset_id").join(pv, "pipeline_id")
            .select("qid", "dataset_id", "pipeline_id", F.col("relevance").cast("double").alias("relevance"),
                    F.concat("dvec", "pvec").alias("features")))


# Ranker settings (rounds, step size, depth).
RANKER_ROUNDS, RANKER_STEP, RANKER_DEPTH = 150, 0.1, 8
#: Rows that a task of a ranker holds: one task per core between these. Every task sends on the sums of all nodes in every level.
MIN_TASK_ROWS, MAX_TASK_ROWS = 8_192, 1_000_000


def task_count(spark: SparkSession, n_rows: int) -> int:
    """Tasks among which a ranker deals its rows."""
    return max(1, -(-n_rows // MAX_TASK_ROWS), min(spark.sparkContext.defaultParallelism, -(-n_rows // MIN_TASK_ROWS)))


def alike_rows(frame: DataFrame) -> DataFrame:
    """(features, relevance, weight): rows with equal features as one, their mean relevance and their number."""
    n = F.count(F.lit(1))
    mean = F.when(F.count("relevance") == n, F.avg("relevance"))  # a missing relevance stays missing
    return frame.groupBy("features").agg(mean.alias("relevance"), n.cast("double").alias("weight"))


def fit_ranker(frame: DataFrame, max_iter: int = RANKER_ROUNDS, step_size: float = RANKER_STEP,
               max_depth: int = RANKER_DEPTH,
               seed: int = 0, checkpoint_interval: int = 10):
    """Pointwise GBT regressor on relevance labels, alike rows as one.

    Uses the session's reliable checkpoint folder for the boosting lineage.
    """
    ensure_checkpoint_dir(frame.sparkSession)
    rows = materialize(alike_rows(frame))
    dealt = rows.repartition(task_count(frame.sparkSession, rows.count()), "features").sortWithinPartitions("features")  # the same places for the same rows
    data = dealt.select(array_to_vector("features").alias("features"), F.col("relevance").alias("label"), "weight")
    gbt = GBTRegressor(maxIter=max_iter, stepSize=step_size, maxDepth=max_depth, seed=seed, weightCol="weight",
                       checkpointInterval=checkpoint_interval)
    return gbt.fit(data)


def candidate_frame(evals: DataFrame, pipe_vecs: DataFrame, query_vec: list[float], n_models: int | None,
                    metric: str = "neg_log_loss") -> DataFrame:
    """The new dataset's vector next to every candidate pipeline's vector.

    Candidates: every pipeline of a dataset's top ``n_models`` (or all
    characterized pipelines when None). The query vector is one bounded row,
    passed as a literal array, so no join of the candidates with it is needed.
    """
    if n_models is None:
        cands = pipe_vecs.select("pipeline_id")
    else:
        cands = top_n_per_dataset(evals, n_models, metric).select("pipeline_id").distinct()
    q = F.array(*[F.lit(float(x)) for x in query_vec])
    pv = pipe_vecs.select("pipeline_id", F.col("values").cast("array<double>").alias("pvec"))
    return cands.join(pv, "pipeline_id").select("pipeline_id", F.concat(q, "pvec").alias("features"))


def score_candidates(model, cands: DataFrame) -> DataFrame:
    scored = model.transform(cands.withColumn("features", array_to_vector("features")))
    return scored.select("pipeline_id", F.col("prediction").alias("predicted"))


def mean_gap_to_best(evals: DataFrame, metric: str = "neg_log_loss") -> DataFrame:
    """Per pipeline: mean over its evaluations with a usable score of (its dataset's best score - score)."""
    e = evals.filter((F.col("metric") == metric) & valid_score("score"))
    best = e.groupBy("dataset_id").agg(F.max("score").alias("best"))
    return (e.join(best, "dataset_id").groupBy("pipeline_id")
            .agg(F.avg(F.col("best") - F.col("score")).alias("gap")))


def ranked_top_k(scored: DataFrame, evals: DataFrame, k: int, score_col: str = "predicted",
                 metric: str = "neg_log_loss") -> DataFrame:
    """Top ``k`` by dense rank of ``score_col`` (best first); ties inside a rank
    go to the smaller mean gap to each dataset's best score, then smaller id.

    The best ``k`` rows hold every distinct score above their last one, so
    ranks among them are the global ones.
    """
    ranked = scored.join(mean_gap_to_best(evals, metric), "pipeline_id", "left")
    order = [F.col(score_col).desc(), F.col("gap").asc_nulls_last(), F.col("pipeline_id").asc()]
    top = ranked.orderBy(*order).limit(k)
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "pipeline_id",
                      F.dense_rank().over(Window.orderBy(F.col(score_col).desc())).cast("long").alias("dense_rank"), score_col, "gap")
