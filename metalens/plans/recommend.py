"""Recommenders: offline statistics and online top-k, each one Spark plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metalens.functions.regret import normalized_regret, ranking_score, regret_or_one, rnd, valid_score
from metalens.operators.store import dataset_bounds
from metalens.session import materialize


def with_regret(evals: DataFrame, metric: str | None = "neg_log_loss", bounds: DataFrame | None = None) -> DataFrame:
    """Evaluations of ``metric`` with their per-dataset normalised regret.

    Bounds come from usable scores; a score that isn't usable (null, NaN,
    infinite) has regret 1.

    Per-dataset bounds are a hash aggregate (one row per dataset) joined back
    on ``dataset_id``. AQE broadcasts the bounds when they are small, so the
    raw evaluations are never shuffled by dataset; when they are not small the
    sort-merge join's skew handling splits a hot dataset.

    ``bounds``: those of the datasets to keep, taken before (any further
    columns come along); without it the bounds of all are computed here.
    """
    e = evals if metric is None else evals.filter(F.col("metric") == metric)
    return (e.join(dataset_bounds(e) if bounds is None else bounds, "dataset_id")
            .withColumn("regret", regret_or_one(F.when(valid_score("score"), normalized_regret("score", "min_score", "max_score")))))


def average_regret_offline(evals: DataFrame, pipelines: DataFrame, metric: str = "neg_log_loss",
                           higher_is_better: bool = True) -> DataFrame:
    """Per pipeline: mean ranking score (``1 - regret`` when higher is better)
    over all its evaluations and the number of evaluations. Pipelines of the
    lookup without evaluations get 0 and 0.
    """
    per_pipe = (with_regret(evals, metric)
                .groupBy("pipeline_id")
                .agg(F.avg(ranking_score("regret", higher_is_better)).alias("ranking_score"),
                     F.count(F.lit(1)).alias("n_evals")))
    return (pipelines.select("pipeline_id").join(per_pipe, "pipeline_id", "left")
            .select("pipeline_id",
                    rnd(F.coalesce("ranking_score", F.lit(0.0))).alias("ranking_score"),
                    F.coalesce("n_evals", F.lit(0)).cast("long").alias("n_evals")))


def top_k(scored: DataFrame, k: int, score_col: str, id_col: str = "pipeline_id") -> DataFrame:
    """The ``k`` best rows by ``score_col`` (ties: smaller id), with rank 1..k.

    ``orderBy(...).limit(k)`` is a TakeOrdered: each partition keeps its own k
    best, the driver merges k x partitions rows.
    """
    top = scored.orderBy(F.col(score_col).desc(), F.col(id_col).asc()).limit(k)
    w = Window.orderBy(F.col(score_col).desc(), F.col(id_col).asc())
    return top.withColumn("rank", F.row_number().over(w).cast("long"))


def average_regret_online(offline: DataFrame, total_n_configs: int = 25, min_evals: int = 10) -> DataFrame:
    """Top ``total_n_configs`` pipelines having at least ``min_evals`` evaluations."""
    eligible = offline.filter(F.col("n_evals") >= min_evals)
    return top_k(eligible, total_n_configs, "ranking_score").select("rank", "pipeline_id", "ranking_score", "n_evals")


def known_vectors(vectors: DataFrame, evals: DataFrame, id_col: str = "dataset_id") -> DataFrame:
    """Stored characterizations restricted to datasets present in the evaluations."""
    return vectors.join(evals.select(id_col), id_col, "left_semi")


def utility_scores(evals: DataFrame, pipelines: DataFrame, sims: DataFrame, metric: str = "neg_log_loss",
                   higher_is_better: bool = True, sim_col: str = "cosine") -> DataFrame:
    """Per pipeline: mean over its evaluations of ``similarity * (1 - regret)``.

    Only datasets with a similarity take part (inner join of the evaluations
    with the one-row-per-dataset similarity table); lookup pipelines without
    such evaluations get utility 0.

    Joins on ``dataset_id`` need no shuffle between them, so Spark would run all
    of them in one stage, whose tasks hold every side at once. The similarities
    and then the datasets' bounds beside them are written first (one row per
    dataset): each stage has one join, and evaluations meet one small table.
    """
    e = evals if metric is None else evals.filter(F.col("metric") == metric)
    sims = materialize(sims.select("dataset_id", sim_col))
    r = with_regret(evals, metric, materialize(dataset_bounds(e).join(sims, "dataset_id")))
    per_pipe = (r.groupBy("pipeline_id")
                .agg(F.avg(F.col(sim_col) * ranking_score("regret", higher_is_better)).alias("utility"),
                     F.count(F.lit(1)).alias("n_evals")))
    return (pipelines.select("pipeline_id").join(per_pipe, "pipeline_id", "left")
            .select("pipeline_id", rnd(F.coalesce("utility", F.lit(0.0))).alias("utility"),
                    F.coalesce("n_evals", F.lit(0)).cast("long").alias("n_evals")))


def utility_online(scores: DataFrame, total_n_configs: int = 25) -> DataFrame:
    return top_k(scores, total_n_configs, "utility").select("rank", "pipeline_id", "utility")


def top_similarity(evals: DataFrame, nearest: DataFrame, total_n_configs: int = 25, metric: str = "neg_log_loss",
                   score_col: str = "score") -> DataFrame:
    """Recommendations taken in turn from the most similar datasets.

    ``nearest`` holds (dataset_id, rank) of the ``n`` most similar datasets.
    Each takes ``c = total // n`` pipelines per round from its own ranking
    (distinct pipelines by best score), rounds advance the offset, and a
    pipeline already taken is skipped; the first ``total`` picks are kept. A
    dataset never needs more than ``ceil(total / c) * c`` of its own pipelines,
    so each ranking is cut there (partial window limit before the shuffle).
    """
    n = nearest.count()  # bounded by the requested number of datasets
    if n == 0:
        return evals.sparkSession.createDataFrame([], "rank long, pipeline_id long, dataset_id long")
    c = max(total_n_configs // n, 1)
    depth = -(-total_n_configs // c) * c
    near = F.broadcast(nearest.select("dataset_id", F.col("rank").alias("sim_rank")))
    best = (evals.filter((F.col("metric") == metric) & valid_score(score_col)).join(near.select("dataset_id"), "dataset_id", "left_semi")
            .groupBy("dataset_id", "pipeline_id").agg(F.max(score_col).alias("best")))
    w = Window.partitionBy("dataset_id").orderBy(F.col("best").desc(), F.col("pipeline_id").asc())
    ranked = (best.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= depth)
              .join(near, "dataset_id")
              .withColumn("round", F.floor((F.col("pos") - 1) / F.lit(c))))
    first = (ranked.groupBy("pipeline_id")
             .agg(F.min(F.struct("round", "sim_rank", "pos", "dataset_id")).alias("k")))
    order = [F.col("k.round"), F.col("k.sim_rank"), F.col("k.pos")]
    picked = first.orderBy(*order).limit(total_n_configs)
    return picked.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"),
                         "pipeline_id", F.col("k.dataset_id").alias("dataset_id"))


def results_matrix(evals: DataFrame, n_pipes: int, metric: str = "neg_log_loss",
                   higher_is_better: bool = True) -> DataFrame:
    """Regret of each candidate pipeline on each dataset (long form).

    Candidates are the union of every dataset's top ``n_pipes`` pipelines. A
    candidate's score on a dataset is the mean of its evaluations there (the
    stored stand-in for a fresh k-fold fit, of usable scores only); regret is
    normalised by the dataset's min and max over candidate scores. Cells without
    a score are absent and mean regret 1 (failure). For a metric whose low scores
    are good, scores are turned round first.
    """
    from metalens.operators.store import candidate_set
    e = evals.filter((F.col("metric") == metric) & valid_score("score"))
    if not higher_is_better:
        e = e.withColumn("score", -F.col("score"))
    cands = candidate_set(e, n_pipes, metric)
    perf = (e.join(cands, "pipeline_id", "left_semi")
            .groupBy("dataset_id", "pipeline_id").agg(F.avg("score").alias("score")))
    r = perf.join(dataset_bounds(perf), "dataset_id").withColumn(
        "regret", regret_or_one(normalized_regret("score", "min_score", "max_score")))
    return r.select("dataset_id", "pipeline_id", "regret")
