"""Greedy portfolio over a long results matrix (dataset_id, pipeline_id, regret).

Missing (dataset, pipeline) cells, and those whose regret is null or NaN, are
failures with regret 1. Since every
dataset's best-so-far starts at 1, a missing cell can never improve it, so the
matrix stays sparse: a round only touches present cells.

Each round is one Spark job: the present cells meet the current best-per-
dataset vector (one row per dataset) in an equi-join, the improvement
``max(0, best - regret)`` is summed per candidate (partial aggregation), and
the single best candidate id comes back to the driver. The best vector is
then updated and checkpointed to the reliable checkpoint folder, so the plan
does not grow with the rounds and a lost executor recomputes one round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metalens.functions.regret import ROUND_DIGITS, regret_or_one
from metalens.session import ensure_checkpoint_dir, materialize


def greedy_portfolio(matrix: DataFrame, k: int, candidates: DataFrame | None = None,
                     checkpoint_every: int = 1) -> DataFrame:
    """Pick ``k`` pipelines minimising the sum over datasets of the best regret.

    Per round the candidate with the largest total improvement wins; ties go
    to the smaller pipeline id, and when nothing improves the smallest
    remaining id is taken (same choice as the first-candidate rule when the
    candidates are in id order). Returns (position, pipeline_id, gain,
    total_regret) in pick order.
    """
    spark = matrix.sparkSession
    ensure_checkpoint_dir(spark)
    m = matrix.select("dataset_id", "pipeline_id", regret_or_one("regret").alias("regret")).checkpoint()
    cands = (candidates if candidates is not None else m.select("pipeline_id")).select("pipeline_id").distinct()
    n_cands = cands.count()
    if k > n_cands:
        raise ValueError(f"portfolio size {k} is larger than the number of candidates {n_cands}")
    best = m.select("dataset_id").distinct().withColumn("best", F.lit(1.0)).checkpoint()
    total = float(best.count())
    picks: list[tuple[int, int, float, float]] = []
    chosen: list[int] = []
    for position in range(1, k + 1):
        gains = (m.join(best, "dataset_id")
                 .groupBy("pipeline_id")
                 .agg(F.sum(F.greatest(F.col("best") - F.col("regret"), F.lit(0.0))).alias("gain")))
        scored = (cands.filter(~F.col("pipeline_id").isin(chosen)) if chosen else cands)
        scored = (scored.join(gains, "pipeline_id", "left")
                  .select("pipeline_id", F.round(F.coalesce("gain", F.lit(0.0)), ROUND_DIGITS).alias("gain")))
        top = scored.orderBy(F.col("gain").desc(), F.col("pipeline_id").asc()).first()
        pid, gain = int(top["pipeline_id"]), float(top["gain"])
        total = total - gain
        picks.append((position, pid, gain, round(total, ROUND_DIGITS)))
        chosen.append(pid)
        cells = m.filter(F.col("pipeline_id") == pid).select("dataset_id", F.col("regret").alias("_r"))
        best = (best.join(cells, "dataset_id", "left")
                .select("dataset_id", F.least(F.col("best"), F.coalesce(F.col("_r"), F.lit(1.0))).alias("best")))
        if position % checkpoint_every == 0:
            best = best.checkpoint()
    return spark.createDataFrame(picks, "position long, pipeline_id long, gain double, total_regret double")


def lodo_portfolios(matrix: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """A greedy portfolio of ``k`` for every held-out dataset (``held``: held_out_id), its own cells left out.

    Held-out datasets that have picked the same pipelines so far share one state:
    the best regrets, and the gain of every candidate over all datasets. For a
    held-out one only candidates that it has cells for differ, each by its own
    improvement there; all others keep the shared gain, and the best of them is the
    first of the shared ranking that it has no cell for. So a state splits only
    where leaving a dataset out changes the pick, and work grows with the
    states, not with the held-out datasets.

    Ties and picks are those of ``greedy_portfolio``. A held-out dataset with fewer
    than ``k`` candidates elsewhere gets what there is. Returns (held_out_id,
    position, pipeline_id, gain, total_regret).
    """
    ensure_checkpoint_dir(matrix.sparkSession)
    m = materialize(matrix.select("dataset_id", "pipeline_id", regret_or_one("regret").alias("regret")))
    held = held.select("held_out_id").distinct()
    own = materialize(m.join(held, m["dataset_id"] == held["held_out_id"]).select("held_out_id", "pipeline_id", "regret"))
    most = own.groupBy("held_out_id").count().agg(F.max("count")).first()[0] or 0
    members = materialize(held.withColumn("state", F.lit(0).cast("long")))
    best = materialize(m.select("dataset_id").distinct().select(F.lit(0).cast("long").alias("state"), "dataset_id", F.lit(1.0).alias("best")))
    taken, picks = None, None
    for position in range(1, k + 1):
        gains = m.join(best, "dataset_id").groupBy("state", "pipeline_id").agg(F.sum(F.greatest(F.col("best") - F.col("regret"), F.lit(0.0))).alias("gain"), F.count(F.lit(1)).alias("cells"))
        gains = materialize(gains.join(taken, ["state", "pipeline_id"], "left_anti") if taken is not None else gains)
        shared = F.round("gain", ROUND_DIGITS)
        order = Window.partitionBy("state").orderBy(shared.desc(), F.col("pipeline_id").asc())
        # a held-out dataset passes over its own pipelines only, so this many places are enough
        ranked = materialize(gains.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most + 1).select("state", "place", "pipeline_id", "gain"))
        mine = members.join(own, "held_out_id").join(best.select("state", F.col("dataset_id").alias("held_out_id"), "best"), ["state", "held_out_id"]).join(gains, ["state", "pipeline_id"])
        adjusted = mine.filter("cells > 1").select("held_out_id", "state", "pipeline_id", (F.col("gain") - F.greatest(F.col("best") - F.col("regret"), F.lit(0.0))).alias("gain"))
        places = mine.select("held_out_id", "state", "pipeline_id").join(ranked, ["state", "pipeline_id"])
        nth = F.row_number().over(Window.partitionBy("held_out_id").orderBy("place"))  # over a dataset's own cells
        gaps = places.withColumn("nth", nth).groupBy("held_out_id").agg(F.coalesce(F.min(F.when(F.col("place") != F.col("nth"), F.col("nth"))), F.count(F.lit(1)) + 1).alias("place"))
        free = members.join(gaps, "held_out_id", "left").withColumn("place", F.coalesce("place", F.lit(1))).join(ranked, ["state", "place"]).select("held_out_id", "state", "pipeline_id", "gain")
        both = free.unionByName(adjusted).withColumn("gain", shared)
        chosen = both.groupBy("held_out_id").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "pipeline_id", "state")).alias("c"))
        chosen = materialize(chosen.select("held_out_id", F.col("c.state").alias("was"), F.xxhash64("c.state", "c.pipeline_id").alias("state"), F.col("c.pipeline_id").alias("pipeline_id"), (-F.col("c.loss")).alias("gain")))
        one = chosen.select("held_out_id", F.lit(position).cast("long").alias("position"), "pipeline_id", "gain")
        picks = one if picks is None else picks.unionByName(one)
        members, steps = chosen.select("held_out_id", "state"), chosen.select("was", "state", "pipeline_id").distinct()
        now = best.withColumnRenamed("state", "was").join(steps, "was").join(m, ["dataset_id", "pipeline_id"], "left")
        best = materialize(now.select("state", "dataset_id", F.least("best", F.coalesce("regret", F.lit(1.0))).alias("best")))
        new = steps.select("state", "pipeline_id")
        if taken is not None:
            new = new.unionByName(taken.withColumnRenamed("state", "was").join(steps.select("was", "state"), "was").select("state", "pipeline_id"))
        taken = materialize(new)
    if picks is None:
        return matrix.sparkSession.createDataFrame([], "held_out_id long, position long, pipeline_id long, gain double, total_regret double")
    n = m.select("dataset_id").distinct().count()
    others = held.join(own.select("held_out_id").distinct().withColumn("own", F.lit(1)), "held_out_id", "left").select("held_out_id", (F.lit(n) - F.coalesce("own", F.lit(0))).alias("others"))
    so_far = F.sum("gain").over(Window.partitionBy("held_out_id").orderBy("position"))
    return picks.join(others, "held_out_id").select("held_out_id", "position", "pipeline_id", "gain", F.round(F.col("others") - so_far, ROUND_DIGITS).alias("total_regret"))
