"""Pairwise learned ranking: boosted trees on within-dataset pairs, none of which is formed.

For scores s and relevances y the loss of a dataset is the sum of exp(s_j - s_i)
over its pairs with y_i > y_j. It separates: with L_i the sum of exp(s_j) over
the dataset's less relevant rows and M_i that of exp(-s_k) over the more relevant
ones, row i has gradient exp(s_i) M_i - exp(-s_i) L_i and curvature exp(s_i) M_i +
exp(-s_i) L_i. Both sums are running sums in the order of relevance. A round fits
one tree to (-gradient / curvature) weighted by the curvature, so that each leaf
holds its Newton step.

A round deals the rows by dataset once, keeps them with their gradients while its
tree is grown, and is checkpointed in the shared folder; a dataset has at most
``n_models`` rows. Pipelines' step hashes are categorical dimensions of the
trees: the ``max_categories`` most frequent ones of a position are told apart,
all others are one category (a bound on the size of the model).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metalens.plans.rankml import task_count
from metalens.session import ensure_checkpoint_dir, materialize

ROUNDS, STEP, DEPTH = 12, 0.3, 5
MAX_CATEGORIES = 200
#: Differences of scores inside a dataset count up to this.
_FAR = 30.0


def hash_columns(hashes: DataFrame, positions: Sequence[int]) -> DataFrame:
    """(pipeline_id, hash_0, ...) from the long form (pipeline_id, pos, hash)."""
    wide = hashes.groupBy("pipeline_id").pivot("pos", list(positions)).agg(F.first("hash"))
    return wide.select("pipeline_id", *[F.col(f"`{p}`").alias(f"hash_{p}") for p in positions])


def pair_gradients(rows: DataFrame) -> DataFrame:
    """``rows`` (qid, relevance, score, ...) with ``gradient`` and ``curvature`` of the pairwise loss.

    A missing relevance or score takes part in no pair; equal relevances make no pair.
    """
    scores = F.when(F.col("relevance").isNotNull() & F.col("score").isNotNull() & ~F.isnan("relevance") & ~F.isnan("score"), F.col("score"))
    query = Window.partitionBy("qid")
    apart = scores - F.avg(scores).over(query)
    near = F.when(apart.isNotNull(), F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), apart)))
    rows = rows.withColumn("_up", F.exp(near)).withColumn("_down", F.exp(-near)).withColumn("_level", F.dense_rank().over(query.orderBy("relevance")))
    order = query.orderBy("_level")
    lower = F.coalesce(F.sum("_up").over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    higher = F.coalesce(F.sum("_down").over(order.rangeBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    rows = rows.withColumn("_lower", lower).withColumn("_higher", higher)
    worse, better = F.coalesce(F.col("_down") * F.col("_lower"), F.lit(0.0)), F.coalesce(F.col("_up") * F.col("_higher"), F.lit(0.0))
    return rows.withColumn("gradient", better - worse).withColumn("curvature", better + worse).drop("_up", "_down", "_level", "_lower", "_higher")


@dataclass
class PairwiseRanker:
    """Features as the trees take them, and the trees."""

    features: PipelineModel | None
    category_cols: list[str]
    known: dict[str, list[str]]
    trees: list
    step: float

    def prepared(self, rows: DataFrame) -> DataFrame:
        return self.features.transform(_common(rows, self.known)).drop(*[f"_i_{c}" for c in self.category_cols], "_numbers")

    def score(self, cands: DataFrame) -> DataFrame:
        """(pipeline_id, predicted) for candidates with the columns that the ranker was fitted on."""
        if not self.trees:
            return cands.select("pipeline_id", F.lit(0.0).alias("predicted"))
        rows = self.prepared(cands).withColumn("predicted", F.lit(0.0))
        for tree in self.trees:
            rows = tree.transform(rows).withColumn("predicted", F.col("predicted") + self.step * F.col("_leaf")).drop("_leaf")
        return rows.select("pipeline_id", "predicted")


_OTHER = ""


def _common(rows: DataFrame, known: dict[str, list[str]]) -> DataFrame:
    """Numbers as a vector; categories outside ``known`` are one."""
    for c, names in known.items():
        rows = rows.withColumn(c, F.when(F.col(c).isin(names), F.col(c)).otherwise(F.lit(_OTHER)))
    return rows.withColumn("_numbers", array_to_vector(F.col("features").cast("array<double>")))


def fit_pairwise(frame: DataFrame, category_cols: Sequence[str] = (), rounds: int = ROUNDS, step: float = STEP, depth: int = DEPTH,
                 max_categories: int = MAX_CATEGORIES, min_rows: int = 5, seed: int = 0) -> PairwiseRanker:
    """Ranker from (qid, relevance, features array<double>, category columns).

    Without any pair of different relevance the ranker has no trees and scores 0.
    """
    ensure_checkpoint_dir(frame.sparkSession)
    frame = materialize(frame.select("qid", "relevance", "features", *category_cols, F.lit(0.0).alias("score")))
    tasks = task_count(frame.sparkSession, frame.count())
    known = {c: [r[c] for r in frame.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(max_categories).collect()] for c in category_cols}
    ranker = PairwiseRanker(None, list(category_cols), known, [], step)
    if frame.isEmpty():
        return ranker
    rows, stages = _common(frame, known), []
    for c in category_cols:
        stages.append(StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc").fit(rows))
    stages.append(VectorAssembler(inputCols=["_numbers", *[f"_i_{c}" for c in category_cols]], outputCol="_x"))
    ranker.features = PipelineModel(stages)
    data = ranker.prepared(frame).select("qid", "relevance", "score", "_x").checkpoint()
    grower = DecisionTreeRegressor(featuresCol="_x", labelCol="_target", weightCol="curvature", predictionCol="_leaf", maxDepth=depth, maxBins=max(64, max_categories + 2),
                                   minInstancesPerNode=min_rows, seed=seed)
    for _ in range(rounds):
        judged = pair_gradients(data.repartition(tasks, "qid")).persist()  # a tree reads its rows several times
        pairs = judged.filter("curvature > 0").withColumn("_target", -F.col("gradient") / F.col("curvature"))
        if ranker.trees or not pairs.isEmpty():
            tree = grower.fit(pairs)
            ranker.trees.append(tree)
            data = tree.transform(judged).withColumn("score", F.col("score") + step * F.col("_leaf")).select("qid", "relevance", "score", "_x").checkpoint()
        judged.unpersist()
        if not ranker.trees:
            break
    return ranker
