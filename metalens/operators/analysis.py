"""Result analysis: processed score grid, regret summary, ranks, Friedman test.

Input is a results table (metalearner_name, dataset_id, slot, score) where
``slot`` is the position of a recommendation in the learner's list; Spark has
no row order, so "first five" / "first 25" are slot predicates.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metalens.functions.regret import normalized_regret, valid_score

LEARNER = "metalearner_name"


def dataset_fill_values(results: DataFrame, score_col: str = "score", offset: float = 0.01) -> DataFrame:
    """Per dataset: smallest valid score of any learner minus ``offset``."""
    return (results.filter(valid_score(score_col)).groupBy("dataset_id")
            .agg((F.min(score_col) - F.lit(offset)).alias("fill_value")))


def best_of_first(results: DataFrame, n: int = 5, score_col: str = "score") -> DataFrame:
    """Best valid score among each (learner, dataset)'s first ``n`` slots.

    Pairs whose first ``n`` slots hold no valid score are absent.
    """
    return (results.filter((F.col("slot") <= n) & valid_score(score_col))
            .groupBy(LEARNER, "dataset_id").agg(F.max(score_col).alias(score_col)))


def processed_scores(results: DataFrame, n: int = 5, score_col: str = "score", offset: float = 0.01) -> DataFrame:
    """One score per (learner, dataset): best of the first ``n`` slots, or the
    dataset's minimum valid score minus ``offset`` when the pair has no rows or
    only invalid ones. ``filled`` marks the substituted pairs.

    Every (learner, dataset) pair must appear, so the best scores are pivoted
    to one row per dataset with a column per learner (the learner names are a
    small vocabulary: the pivot's value list), missing cells are filled from
    the dataset's fill value, and the row is unpivoted back to long form. No
    join builds the grid.
    """
    learners = [r[0] for r in results.select(LEARNER).distinct().orderBy(LEARNER).collect()]
    if not learners:
        return results.sparkSession.createDataFrame(
            [], f"{LEARNER} string, dataset_id long, {score_col} double, filled boolean")
    best = best_of_first(results, n, score_col)
    datasets = results.select("dataset_id").distinct()
    wide = (datasets.join(best.groupBy("dataset_id").pivot(LEARNER, learners).agg(F.first(score_col)),
                          "dataset_id", "left")
            .join(dataset_fill_values(results, score_col, offset), "dataset_id", "left"))
    cells = F.array(*[F.struct(F.lit(name).alias(LEARNER), F.col(f"`{name}`").alias("best"))
                      for name in learners])
    long = wide.select("dataset_id", "fill_value", F.explode(cells).alias("c"))
    return long.select(F.col(f"c.{LEARNER}").alias(LEARNER), "dataset_id",
                       F.coalesce(F.col("c.best"), F.col("fill_value")).alias(score_col),
                       F.col("c.best").isNull().alias("filled"))


def regret_summary(results: DataFrame, n_slots: int = 25, score_col: str = "score") -> DataFrame:
    """Per learner: mean over datasets of the mean and sample std of regret over
    exactly ``n_slots`` slots per dataset.

    Regret uses each dataset's valid-score min and max over all learners.
    Slots without a row, and rows without a valid score, count as regret 1.
    Padding is algebraic: a pair with ``m`` present slots adds ``n_slots - m``
    ones to the mean and to the centred second moment, and a learner with no
    rows for a dataset contributes mean 1 and std 0; no padding rows are made.
    """
    bounds = (results.filter(valid_score(score_col)).groupBy("dataset_id")
              .agg(F.min(score_col).alias("lo"), F.max(score_col).alias("hi")))
    r = (results.filter(F.col("slot") <= n_slots).join(bounds, "dataset_id", "left")
         .withColumn("regret", F.when(valid_score(score_col), normalized_regret(score_col, "lo", "hi"))
                     .otherwise(F.lit(1.0))))
    n = float(n_slots)
    sums = r.groupBy(LEARNER, "dataset_id").agg(F.sum("regret").alias("s"), F.count(F.lit(1)).alias("m"))
    sums = sums.withColumn("mean", (F.col("s") + (F.lit(n) - F.col("m"))) / F.lit(n))
    sq = (r.join(sums.select(LEARNER, "dataset_id", "mean"), [LEARNER, "dataset_id"])
          .groupBy(LEARNER, "dataset_id").agg(F.sum((F.col("regret") - F.col("mean")) ** 2).alias("ss")))
    per_pair = (sums.join(sq, [LEARNER, "dataset_id"])
                .withColumn("ss", F.col("ss") + (F.lit(n) - F.col("m")) * (F.lit(1.0) - F.col("mean")) ** 2)
                .withColumn("std", F.sqrt(F.col("ss") / F.lit(n - 1.0))))
    # The dataset count is one bounded scalar.
    d = float(results.select(F.count_distinct("dataset_id")).first()[0] or 0)
    per_learner = per_pair.groupBy(LEARNER).agg(F.sum("mean").alias("sm"), F.sum("std").alias("sd"),
                                                F.count(F.lit(1)).alias("present"))
    # Absent pairs: regret mean 1, std 0.
    return per_learner.select(LEARNER,
                              ((F.col("sm") + (F.lit(d) - F.col("present"))) / F.lit(d)).alias("regret_mean"),
                              (F.col("sd") / F.lit(d)).alias("regret_std"))


def tie_averaged_rank(df: DataFrame, group_col: str, score_col: str, higher_is_better: bool = True,
                      out: str = "rank") -> DataFrame:
    """Rank within ``group_col``, best = 1, tied scores share their mean rank.

    Used on processed grids, whose groups hold one row per learner.
    """
    order = F.col(score_col).desc() if higher_is_better else F.col(score_col).asc()
    w = Window.partitionBy(group_col).orderBy(order)
    ties = Window.partitionBy(group_col, score_col)
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))


def average_ranks(processed: DataFrame, score_col: str = "score") -> DataFrame:
    """Average tie-averaged rank per learner over datasets."""
    ranked = tie_averaged_rank(processed, "dataset_id", score_col)
    return ranked.groupBy(LEARNER).agg(F.avg("rank").alias("avg_rank"),
                                      F.count(F.lit(1)).alias("n_datasets"))


def learner_positions(processed: DataFrame, score_col: str = "score") -> DataFrame:
    """Position 1..k of each learner per dataset, best first, ties by name."""
    w = Window.partitionBy("dataset_id").orderBy(F.col(score_col).desc(), F.col(LEARNER).asc())
    return processed.withColumn("position", F.row_number().over(w))


def friedman_statistic(processed: DataFrame, score_col: str = "score") -> DataFrame:
    """Friedman chi-square with tie correction, aligned by ``dataset_id``.

    One row: n (datasets), k (learners), statistic. The two one-row summaries
    (rank sums, tie counts) are unioned and folded in a single aggregate.
    """
    ranked = tie_averaged_rank(processed, "dataset_id", score_col)
    rank_sums = (ranked.groupBy(LEARNER).agg(F.sum("rank").alias("r"))
                 .agg(F.sum(F.col("r") ** 2).alias("ssbn"), F.count(F.lit(1)).alias("k")))
    ties = (processed.groupBy("dataset_id", score_col).agg(F.count(F.lit(1)).alias("t"))
            .agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("tie"), F.count_distinct("dataset_id").alias("n")))
    one = rank_sums.unionByName(ties, allowMissingColumns=True).agg(
        F.max("ssbn").alias("ssbn"), F.max("k").alias("k"), F.max("tie").alias("tie"), F.max("n").alias("n"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    c = F.lit(1.0) - F.col("tie") / (n * k * (k * k - 1))
    stat = (F.lit(12.0) / (n * k * (k + 1)) * F.col("ssbn") - F.lit(3.0) * n * (k + 1)) / c
    return one.select(F.col("n").cast("long").alias("n_datasets"), F.col("k").cast("long").alias("n_learners"),
                      stat.alias("statistic"))


def chi2_sf(x: float, dof: float) -> float:
    """Upper tail of the chi-square distribution (regularised gamma Q(dof/2, x/2))."""
    if x <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    if z < a + 1.0:  # series for P, then Q = 1 - P
        term = total = 1.0 / a
        ap = a
        for _ in range(1000):
            ap += 1.0
            term *= z / ap
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return max(0.0, 1.0 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    # continued fraction for Q (modified Lentz)
    tiny = 1e-300
    b = z + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return math.exp(-z + a * math.log(z) - math.lgamma(a)) * h


def friedman_test(processed: DataFrame, score_col: str = "score") -> DataFrame:
    """Friedman statistic plus its p-value (chi-square, k - 1 degrees of freedom).

    The statistic is one row; its tail probability is computed on the driver
    and attached as a literal, so no Python worker is involved.
    """
    s = friedman_statistic(processed, score_col)
    row = s.first()
    if row is None or row["statistic"] is None:
        return s.withColumn("p_value", F.lit(None).cast("double"))
    p = chi2_sf(float(row["statistic"]), float(row["n_learners"] - 1))
    return s.withColumn("p_value", F.lit(p))


def pivot_learners(processed: DataFrame, learners: list[str], score_col: str = "score") -> DataFrame:
    """Dataset x learner matrix; the learner list is the pivot's value list."""
    return processed.groupBy("dataset_id").pivot(LEARNER, learners).agg(F.first(score_col))


def search_method(logs_name_col: str = "logs_name"):
    """Search method named inside a run name; null when none matches.

    The longer name is tested first because it contains the shorter one.
    """
    c = F.col(logs_name_col)
    # Run-name markers of the three search methods.
    return (F.when(c.contains("AsynchronousSuccessiveHalving"), F.lit("AsynchronousSuccessiveHalving"))
            .when(c.contains("AsyncEA"), F.lit("AsyncEA"))
            .when(c.contains("RandomSearch"), F.lit("RandomSearch")))


def clip_scores(score_col: str = "score", floor: float = -0.5):
    """Scores below ``floor`` become null (they are off the plotted range)."""
    return F.when(F.col(score_col) >= F.lit(floor), F.col(score_col))


def recode(col: str, mapping: dict[int, int]):
    """Replace listed values by new ones (``create_map`` lookup), keep others."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    m = F.create_map(*pairs)
    return F.coalesce(F.element_at(m, F.col(col)), F.col(col))


def log_loss(probs: DataFrame, p_col: str = "p_true", eps: float = 1e-15) -> DataFrame:
    """Mean negative log of the probability given to the true class."""
    p = F.least(F.greatest(F.col(p_col), F.lit(eps)), F.lit(1.0 - eps))
    return probs.agg((-F.avg(F.log(p))).alias("log_loss"), F.count(F.lit(1)).alias("n_rows"))


def linear_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares line y = slope * x + intercept, with R^2 and n."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def _phi(z: float) -> float:
    return math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def _Phi(z: float) -> float:
    return 0.5 * (1.0 + math.erf(z / math.sqrt(2.0)))


def studentized_range_cdf(q: float, k: int, steps: int = 4000, lo: float = -9.0, hi: float = 9.0) -> float:
    """P(range of k iid standard normals <= q) = k * int phi(z) (Phi(z) - Phi(z - q))^(k-1) dz (Simpson)."""
    h = (hi - lo) / steps
    total = 0.0
    for i in range(steps + 1):
        z = lo + i * h
        w = 1 if i in (0, steps) else (4 if i % 2 else 2)
        total += w * _phi(z) * (_Phi(z) - _Phi(z - q)) ** (k - 1)
    return k * total * h / 3.0


def critical_difference(k: int, n: int, alpha: float = 0.05) -> float:
    """Nemenyi critical difference of average ranks for k learners on n datasets."""
    if k < 2 or n < 1:
        return float("inf")
    a, b = 0.0, 10.0
    for _ in range(60):  # bisection for the (1 - alpha) quantile of the studentized range
        mid = (a + b) / 2
        if studentized_range_cdf(mid, k) < 1 - alpha:
            a = mid
        else:
            b = mid
    q_alpha = (a + b) / 2 / math.sqrt(2.0)
    return q_alpha * math.sqrt(k * (k + 1) / (6.0 * n))


def cd_groups(ranks: DataFrame, n_datasets: int, alpha: float = 0.05) -> DataFrame:
    """Groups of learners whose average ranks differ by less than the critical
    difference: maximal runs in rank order (the groups a CD diagram draws).

    ``ranks`` is (metalearner_name, avg_rank), one row per learner (a bounded
    vocabulary). Each learner's run is the learners from it onwards within CD;
    runs contained in an earlier run are dropped. Returns (group, start,
    metalearner_name, avg_rank, cd) for groups of two or more learners.
    """
    k = ranks.count()  # number of learners: a bounded scalar
    cd = critical_difference(k, n_datasets, alpha)
    order = [F.col("avg_rank").asc(), F.col(LEARNER).asc()]
    w_all = Window.orderBy(*order)
    w_next = w_all.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    r = (ranks.withColumn("pos", F.row_number().over(w_all))
         .withColumn("following", F.collect_list("avg_rank").over(w_next)))
    r = r.withColumn("run_end", F.col("pos") - 1 + F.size(F.filter("following", lambda x: x - F.col("avg_rank") < F.lit(cd))))
    prev_end = F.coalesce(F.max("run_end").over(w_all.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = (r.withColumn("prev_end", prev_end)
              .filter((F.col("run_end") > F.col("prev_end")) & (F.col("run_end") > F.col("pos")))
              .select(F.col("pos").alias("start"), "run_end"))
    members = r.select("pos", LEARNER, "avg_rank")
    # A group's positions start..run_end are expanded and joined to the
    # learners by position (equi-join; one row per learner and group).
    groups = starts.withColumn("group", F.row_number().over(Window.orderBy("start")))
    expanded = groups.select("group", "start", F.explode(F.sequence("start", "run_end")).alias("pos"))
    return (expanded.join(members, "pos")
            .select(F.col("group").cast("long"), F.col("start").cast("long"), LEARNER, "avg_rank",
                    F.lit(cd).alias("cd")))


def signed_rank_sums(scores: DataFrame, control: str, blocks: int = 64, score_col: str = "score") -> DataFrame:
    """Wilcoxon signed-rank sums of every other learner against ``control``.

    ``scores`` has one row per (learner, dataset). Differences are control minus
    learner on the datasets that both have a usable score for; zeros are left out,
    and equal absolute differences share their mean rank. A learner's differences
    are ranked in blocks of their value (approximate quantiles), so no window holds
    all datasets. Returns (learner, n, w_plus, w_minus, ties): ties is the sum of
    t^3 - t over groups of t equal absolute differences.
    """
    usable = scores.filter(valid_score(score_col))
    own = usable.filter(F.col(LEARNER) == control).select("dataset_id", F.col(score_col).alias("_control"))
    d = usable.filter(F.col(LEARNER) != control).join(own, "dataset_id").withColumn("_d", F.col("_control") - F.col(score_col)).filter("_d <> 0")
    values = d.groupBy(LEARNER, F.abs("_d").alias("a")).agg(F.count(F.lit(1)).alias("t"), F.sum((F.col("_d") > 0).cast("long")).alias("plus"))
    cuts = values.groupBy(LEARNER).agg(F.percentile_approx("a", [i / blocks for i in range(1, blocks)], 10_000).alias("cuts"))
    values = values.join(cuts, LEARNER).withColumn("block", F.size(F.filter("cuts", lambda c: c < F.col("a")))).drop("cuts")
    counts = values.groupBy(LEARNER, "block").agg(F.sum("t").alias("n"))
    earlier = Window.partitionBy(LEARNER).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(LEARNER, "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(LEARNER, "block").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn("_below", F.coalesce(F.sum("t").over(inside), F.lit(0))).join(counts, [LEARNER, "block"])
    rank = F.col("before") + F.col("_below") + (F.col("t") + 1) / 2
    return ranked.groupBy(LEARNER).agg(F.sum("t").alias("n"), F.sum(rank * F.col("plus")).alias("w_plus"), F.sum(rank * (F.col("t") - F.col("plus"))).alias("w_minus"),
                                       F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))


def signed_rank_tail(n: int, w: float) -> float:
    """P(W <= w) for the smaller of two signed-rank sums of ``n`` untied differences, by counting rank subsets."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    return sum(ways[:int(w) + 1]) / 2**n


def signed_rank_tests(scores: DataFrame, control: str, alpha: float = 0.05, exact_up_to: int = 25, score_col: str = "score") -> DataFrame:
    """Each learner against ``control``: two-sided signed-rank test, Bonferroni over the tests made.

    Up to ``exact_up_to`` untied differences the tail is counted, beyond it is the
    normal one with tie correction. Returns (learner, n, w_plus, w_minus, z, p,
    p_adjusted, differs). Only one row of sums per learner reaches the driver.
    """
    spark, rows = scores.sparkSession, signed_rank_sums(scores, control, score_col=score_col).collect()
    learners = [r[0] for r in scores.filter(F.col(LEARNER) != control).select(LEARNER).distinct().collect()]
    sums, out = {r[LEARNER]: r for r in rows}, []
    for name in sorted(learners):
        r = sums.get(name)
        n, plus, minus, ties = (int(r["n"]), float(r["w_plus"]), float(r["w_minus"]), int(r["ties"])) if r else (0, 0.0, 0.0, 0)
        spread = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
        z = (plus - n * (n + 1) / 4) / math.sqrt(spread) if spread > 0 else 0.0
        p = min(1.0, 2 * signed_rank_tail(n, min(plus, minus))) if 0 < n <= exact_up_to and not ties else math.erfc(abs(z) / math.sqrt(2))
        adjusted = min(1.0, p * len(learners))
        out.append((name, n, plus, minus, z, p, adjusted, adjusted < alpha))
    return spark.createDataFrame(out, f"{LEARNER} string, n long, w_plus double, w_minus double, z double, p double, p_adjusted double, differs boolean")
