"""Recommender classes: ``fit(view)`` does the offline phase, ``recommend(...)``
the online phase; both return DataFrames (rank, pipeline_id, score).

A learner is a thin holder of lazy plans: fitting stores DataFrames (or, for
the portfolio and the ranker, a small computed result), recommending composes
the online plan on top (the utility learner writes the small tables that several
joins need). Nothing is collected except bounded outputs.
"""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metalens.operators.portfolio import greedy_portfolio
from metalens.operators.similarity import most_similar, one_vs_all
from metalens.operators.views import MetaView
from metalens.plans import recommend
from metalens.session import materialize


class Learner:
    """Base class: subclasses implement ``fit`` and ``recommend``."""

    def fit(self, view: MetaView, **kwargs) -> Learner:
        raise NotImplementedError

    def recommend(self, **kwargs) -> DataFrame:
        raise NotImplementedError


def call_with_supported(fn, **kwargs):
    """Call ``fn`` with only the keyword arguments its signature accepts."""
    params = inspect.signature(fn).parameters
    if any(p.kind == p.VAR_KEYWORD for p in params.values()):
        return fn(**kwargs)
    return fn(**{k: v for k, v in kwargs.items() if k in params})


@dataclass
class AverageRegretLearner(Learner):
    metric: str = "neg_log_loss"
    higher_is_better: bool = True
    offline: DataFrame | None = field(default=None, repr=False)

    def fit(self, view: MetaView, **_) -> AverageRegretLearner:
        self.offline = recommend.average_regret_offline(view.evaluations, view.pipelines, self.metric,
                                                        self.higher_is_better)
        return self

    def recommend(self, total_n_configs: int = 25, min_evals: int = 10, **_) -> DataFrame:
        out = recommend.average_regret_online(self.offline, total_n_configs, min_evals)
        return out.select("rank", "pipeline_id", F.col("ranking_score").alias("score"))


@dataclass
class UtilityEstimateLearner(Learner):
    metric: str = "neg_log_loss"
    higher_is_better: bool = True
    similarity: str = "cosine"
    vec_col: str = "embedding"  # "values" for characterizations read from a MetaStore
    view: MetaView | None = field(default=None, repr=False)

    def fit(self, view: MetaView, **_) -> UtilityEstimateLearner:
        self.view = view
        return self

    def recommend(self, query_vector: DataFrame, total_n_configs: int = 25, **_) -> DataFrame:
        """``query_vector``: one row with the vector column (the new dataset)."""
        stored = recommend.known_vectors(self.view.dataset_chars, self.view.evaluations)
        sims = one_vs_all(stored, query_vector, vec_col=self.vec_col)
        pipelines = materialize(self.view.pipelines.select("pipeline_id"))  # their join ends before that with the scores
        scores = recommend.utility_scores(self.view.evaluations, pipelines, sims, self.metric,
                                          self.higher_is_better, self.similarity)
        return recommend.utility_online(scores, total_n_configs).withColumnRenamed("utility", "score")


@dataclass
class TopSimilarityLearner(Learner):
    metric: str = "neg_log_loss"
    n_datasets: int = 5
    similarity: str = "cosine"
    vec_col: str = "embedding"
    view: MetaView | None = field(default=None, repr=False)

    def fit(self, view: MetaView, **_) -> TopSimilarityLearner:
        self.view = view
        return self

    def recommend(self, query_vector: DataFrame, total_n_configs: int = 25, **_) -> DataFrame:
        stored = recommend.known_vectors(self.view.dataset_chars, self.view.evaluations)
        nearest = most_similar(one_vs_all(stored, query_vector, vec_col=self.vec_col), self.n_datasets,
                               self.similarity)
        out = recommend.top_similarity(self.view.evaluations, nearest, total_n_configs, self.metric)
        return out.withColumn("score", F.lit(None).cast("double")).select("rank", "pipeline_id", "score")


@dataclass
class PortfolioLearner(Learner):
    """Greedy portfolio over the kept datasets' candidates (no held-out leak)."""

    metric: str = "neg_log_loss"
    portfolio_size: int = 25
    n_pipes: int = 5
    portfolio: DataFrame | None = field(default=None, repr=False)

    def fit(self, view: MetaView, results_matrix: DataFrame | None = None, **_) -> PortfolioLearner:
        m = results_matrix if results_matrix is not None else recommend.results_matrix(
            view.evaluations, self.n_pipes, self.metric)
        self.portfolio = greedy_portfolio(m, self.portfolio_size)
        return self

    def recommend(self, total_n_configs: int = 25, **_) -> DataFrame:
        if total_n_configs > self.portfolio_size:
            raise ValueError(f"total_n_configs {total_n_configs} exceeds the portfolio size {self.portfolio_size}")
        return (self.portfolio.filter(F.col("position") <= total_n_configs)
                .select(F.col("position").alias("rank"), "pipeline_id",
                        F.col("total_regret").alias("score")))


@dataclass
class RankMLLearner(Learner):
    metric: str = "neg_log_loss"
    n_models: int = 10
    max_iter: int = 150
    step_size: float = 0.1
    max_depth: int = 8
    model: object = field(default=None, repr=False)
    view: MetaView | None = field(default=None, repr=False)

    def fit(self, view: MetaView, **_) -> RankMLLearner:
        from metalens.plans.rankml import fit_ranker, training_frame
        self.view = view
        frame = training_frame(view.evaluations, view.dataset_chars, view.pipeline_chars, self.n_models, self.metric)
        self.model = fit_ranker(frame, self.max_iter, self.step_size, self.max_depth)
        return self

    def recommend(self, query_vector: list[float], total_n_configs: int = 25, max_n_models: int | None = None,
                  **_) -> DataFrame:
        from metalens.plans.rankml import candidate_frame, ranked_top_k, score_candidates
        cands = candidate_frame(self.view.evaluations, self.view.pipeline_chars, query_vector, max_n_models,
                                self.metric)
        out = ranked_top_k(score_candidates(self.model, cands), self.view.evaluations, total_n_configs,
                           "predicted", self.metric)
        return out.select("rank", "pipeline_id", F.col("predicted").alias("score"))


def top_configurations(recs: DataFrame, n: int | None = None) -> DataFrame:
    """Recommendations by score, unscored ones last (stable by rank)."""
    out = recs.orderBy(F.col("score").desc_nulls_last(), F.col("rank").asc())
    return out.limit(n) if n is not None else out
