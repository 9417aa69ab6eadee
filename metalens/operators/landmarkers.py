"""Landmarking meta-features by cross-validation, for all datasets in one plan.

Rows get a fold from a portable hash of their id; per-fold training statistics
are the dataset totals minus the fold's own sums (no per-fold copy of the
data). Numeric attributes are used after mean imputation.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metalens.functions.hashing import seeded_hash
from metalens.session import materialize


def hash_folds(labels: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(dataset_id, row_id, y, fold): fold = hash(row_id) mod k."""
    return labels.withColumn("fold", F.pmod(seeded_hash("row_id", seed), F.lit(k)))


def stratified_folds(labels: DataFrame, k: int, seed: int = 0, block_bits: int = 20) -> DataFrame:
    """Exact stratified folds: within each (dataset, class), rows ordered by a
    seeded hash get folds 0, 1, ..., k-1, 0, ... in turn.

    The position of a row inside its class is a prefix count. It is computed by
    splitting the 32-bit hash range into blocks: per-block counts and their
    prefix over blocks (a small window), plus a row number inside the block.
    A class holding most rows is thus spread over many tasks.
    """
    h = labels.withColumn("_h", seeded_hash("row_id", seed)).withColumn("_b", F.shiftright("_h", block_bits))
    per_blk = h.groupBy("dataset_id", "y", "_b").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy("dataset_id", "y").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    prefix = per_blk.select("dataset_id", "y", "_b", F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_before"))
    wr = Window.partitionBy("dataset_id", "y", "_b").orderBy("_h", "row_id")
    ranked = h.withColumn("_rn", F.row_number().over(wr)).join(prefix, ["dataset_id", "y", "_b"])
    pos = F.col("_before") + F.col("_rn") - 1
    return ranked.select("dataset_id", "row_id", "y", F.pmod(pos, F.lit(k)).cast("long").alias("fold"))


def naive_bayes_accuracy(cells: DataFrame, folds: DataFrame, var_smoothing: float = 1e-9) -> DataFrame:
    """Gaussian naive Bayes, k-fold accuracy per dataset (mean over folds).

    Returns (dataset_id, value). Variances are the training rows' population
    variances plus ``var_smoothing`` x the largest attribute variance of the
    fold's training rows.
    """
    x = _centred(cells)
    # Feeds the fold sums and the test side: written once, scanned once.
    xf = materialize(x.join(folds, ["dataset_id", "row_id"]))
    # sums per (dataset, fold, class, attr) and per (dataset, class, attr)
    part = xf.groupBy("dataset_id", "fold", "y", "attr").agg(
        F.count(F.lit(1)).alias("n_f"), F.sum("x").alias("s1_f"), F.sum(F.col("x") ** 2).alias("s2_f"))
    tot = part.groupBy("dataset_id", "y", "attr").agg(
        F.sum("n_f").alias("n"), F.sum("s1_f").alias("s1"), F.sum("s2_f").alias("s2"))
    fold_ids = folds.select("dataset_id", "fold").distinct()
    # training stats of fold f = totals - fold f's part (absent part = 0)
    train = (tot.join(fold_ids, "dataset_id")
             .join(part, ["dataset_id", "fold", "y", "attr"], "left")
             .select("dataset_id", "fold", "y", "attr",
                     (F.col("n") - F.coalesce("n_f", F.lit(0))).alias("n"),
                     (F.col("s1") - F.coalesce("s1_f", F.lit(0.0))).alias("s1"),
                     (F.col("s2") - F.coalesce("s2_f", F.lit(0.0))).alias("s2"))
             .filter(F.col("n") > 0))
    train = train.withColumn("mu", F.col("s1") / F.col("n")).withColumn(
        "var", F.greatest(F.col("s2") / F.col("n") - F.col("mu") ** 2, F.lit(0.0)))
    # overall training variance per (dataset, fold, attr) for the smoothing epsilon
    overall = (train.groupBy("dataset_id", "fold", "attr")
               .agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
               .select("dataset_id", "fold",
                       F.greatest(F.col("s2") / F.col("n") - (F.col("s1") / F.col("n")) ** 2, F.lit(0.0)).alias("v"))
               .groupBy("dataset_id", "fold").agg((F.max("v") * F.lit(var_smoothing)).alias("eps")))
    cls = (train.groupBy("dataset_id", "fold", "y").agg(F.max("n").alias("n_c"))
           .withColumn("log_prior", F.log(F.col("n_c") / F.sum("n_c").over(Window.partitionBy("dataset_id", "fold")))))
    stats = train.join(overall, ["dataset_id", "fold"]).withColumn("var", F.col("var") + F.col("eps"))
    test = xf.select("dataset_id", "fold", "row_id", F.col("y").alias("y_true"), "attr", "x")
    ll = (test.join(stats.select("dataset_id", "fold", "y", "attr", "mu", "var"), ["dataset_id", "fold", "attr"])
          .groupBy("dataset_id", "fold", "row_id", "y_true", "y")
          .agg(F.sum(F.lit(-0.5 * math.log(2 * math.pi)) - 0.5 * F.log("var")
                     - (F.col("x") - F.col("mu")) ** 2 / (2 * F.col("var"))).alias("ll")))
    post = ll.join(cls.select("dataset_id", "fold", "y", "log_prior"), ["dataset_id", "fold", "y"]).withColumn(
        "post", F.col("ll") + F.col("log_prior"))
    pred = post.groupBy("dataset_id", "fold", "row_id", "y_true").agg(
        F.max(F.struct("post", "y")).alias("best"))
    acc = (pred.groupBy("dataset_id", "fold")
           .agg(F.avg((F.col("best.y") == F.col("y_true")).cast("double")).alias("acc")))
    return acc.groupBy("dataset_id").agg(F.avg("acc").alias("value"))


def _bins(cells: DataFrame, n_bins: int) -> DataFrame:
    """Mean-imputed numeric cells with an equal-width bin 0..n_bins-1 per (dataset, attr).

    Means and the imputed value range come from one aggregate, joined once.
    """
    from metalens.operators.subtables import numeric_stats
    st = numeric_stats(cells)
    x = (cells.filter(~F.col("is_cat")).join(st, ["dataset_id", "attr"])
         .select("dataset_id", "row_id", "attr", F.coalesce("num_val", "_m").alias("x"),
                 F.col("_lo").alias("lo"), F.col("_hi").alias("hi")))
    raw = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(n_bins))
    return (x.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(raw, F.lit(n_bins - 1)))
                         .otherwise(F.lit(0)).cast("long"))
            .drop("lo", "hi"))


def decision_stumps(cells: DataFrame, folds: DataFrame, n_bins: int = 32, seed: int = 0) -> DataFrame:
    """Depth-1 trees (Gini) on equal-width bin edges, k-fold accuracy per dataset.

    Returns (dataset_id, name, value) with name ``best_node`` (best split over
    all attributes) and ``random_node`` (best split of one attribute picked by
    a seeded hash per dataset). Left counts of every split edge are fixed-width
    conditional sums over the bin counts, so no (bin x class) grid is formed.
    """
    # Binned cells with folds feed the split search and the test side: written once.
    bx = materialize(_bins(cells, n_bins).join(folds, ["dataset_id", "row_id"]))
    part = bx.groupBy("dataset_id", "fold", "attr", "bin", "y").agg(F.count(F.lit(1)).alias("n_f"))
    tot = part.groupBy("dataset_id", "attr", "bin", "y").agg(F.sum("n_f").alias("n"))
    fold_ids = folds.select("dataset_id", "fold").distinct()
    train = (tot.join(fold_ids, "dataset_id").join(part, ["dataset_id", "fold", "attr", "bin", "y"], "left")
             .select("dataset_id", "fold", "attr", "bin", "y", (F.col("n") - F.coalesce("n_f", F.lit(0))).alias("n")))
    edges = list(range(n_bins - 1))
    per_class = train.groupBy("dataset_id", "fold", "attr", "y").agg(
        F.sum("n").alias("t"),
        F.array(*[F.sum(F.when(F.col("bin") <= j, F.col("n")).otherwise(0)) for j in edges]).alias("left"))
    sides = per_class.select("dataset_id", "fold", "attr", "y", "t",
                             F.posexplode("left").alias("edge", "l")).withColumn("r", F.col("t") - F.col("l"))
    split = sides.groupBy("dataset_id", "fold", "attr", "edge").agg(
        F.sum("l").alias("nl"), F.sum(F.col("l") * F.col("l")).alias("sql"),
        F.sum("r").alias("nr"), F.sum(F.col("r") * F.col("r")).alias("sqr"),
        F.max(F.struct("l", "y")).alias("left_major"), F.max(F.struct("r", "y")).alias("right_major"))
    split = (split.filter((F.col("nl") > 0) & (F.col("nr") > 0))
             .withColumn("imp", (F.col("nl") - F.col("sql") / F.col("nl")) + (F.col("nr") - F.col("sqr") / F.col("nr"))))
    attrs = cells.filter(~F.col("is_cat")).select("dataset_id", "attr").distinct()
    attrs = attrs.withColumn("_ai", F.dense_rank().over(Window.partitionBy("dataset_id").orderBy("attr")))
    pick = (attrs.withColumn("_h", seeded_hash("_ai", F.lit(seed) + F.col("dataset_id")))
            .groupBy("dataset_id").agg(F.min_by("attr", F.struct("_h", "attr")).alias("attr")))
    candidates = {"best_node": split,
                  "random_node": split.join(pick, ["dataset_id", "attr"], "left_semi")}
    out = None
    for name, cand in candidates.items():
        best = (cand.groupBy("dataset_id", "fold")
                .agg(F.min_by(F.struct("attr", "edge", F.col("left_major.y").alias("ly"),
                                       F.col("right_major.y").alias("ry")),
                              F.struct("imp", "attr", "edge")).alias("s"))
                .select("dataset_id", "fold", "s.*"))
        test = bx.join(best, ["dataset_id", "fold", "attr"])
        pred = F.when(F.col("bin") <= F.col("edge"), F.col("ly")).otherwise(F.col("ry"))
        acc = (test.groupBy("dataset_id", "fold").agg(F.avg((pred == F.col("y")).cast("double")).alias("acc"))
               .groupBy("dataset_id").agg(F.avg("acc").alias("value"))
               .select("dataset_id", F.lit(name).alias("name"), "value"))
        out = acc if out is None else out.unionByName(acc)
    return out


def _row_vectors(x: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per row, the values of its dataset's own attributes as an array (in the
    dataset's attribute order), plus the attribute index (dataset_id, attr, idx).

    The width of a row's vector is its dataset's attribute count, not the union
    of all datasets' attributes.
    """
    idx = (x.select("dataset_id", "attr").distinct()
           .withColumn("idx", F.dense_rank().over(Window.partitionBy("dataset_id").orderBy("attr")) - 1))
    rows = (x.join(idx, ["dataset_id", "attr"]).groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("kv"))
            .select(*keys, F.col("kv.x").alias("v")))
    return rows, idx


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Vector sums of x and of the flattened outer product x x^T per ``keys``
    (``Summarizer.sum``: element-wise, merged map-side)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    outer = F.flatten(F.transform("v", lambda a: F.transform("v", lambda b: a * b)))
    return (rows.select(*keys, array_to_vector("v").alias("v1"), array_to_vector(outer).alias("v2"))
            .groupBy(*keys).agg(Summarizer.sum(F.col("v1")).alias("s1"), Summarizer.sum(F.col("v2")).alias("s2"),
                                F.count(F.lit(1)).alias("n")))


def _centred(cells: DataFrame) -> DataFrame:
    """(dataset_id, row_id, attr, x): mean-imputed numeric cells minus their attribute's mean.

    Moments of centred values don't cancel, and no landmarker here depends on the mean.
    """
    num = cells.filter(~F.col("is_cat"))
    means = num.groupBy("dataset_id", "attr").agg(F.avg("num_val").alias("_m"))
    return num.join(means, ["dataset_id", "attr"]).select(
        "dataset_id", "row_id", "attr", F.coalesce(F.col("num_val") - F.col("_m"), F.lit(0.0)).alias("x"))


def _attribute_lists(idx: DataFrame) -> DataFrame:
    """(dataset_id, attrs): each dataset's attributes in vector order."""
    return idx.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("idx", "attr"))).alias("kv")).select("dataset_id", F.col("kv.attr").alias("attrs"))


def pca_features(cells: DataFrame, accuracy: int = 10000) -> DataFrame:
    """pca.95%, pca.skewness, pca.kurtosis of the first principal component.

    One aggregation computes, for every dataset at once, the vector sum of
    x x^T over the dataset's own attributes (a d^2 buffer per dataset, merged
    map-side). Each dataset's d x d covariance is decomposed in a task of its
    own row; the loadings stay a table, by which a join projects every
    dataset's centred rows. The 0.95 quantile uses the bounded-memory
    ``percentile_approx``. The reference took the scores' first row instead of
    the first component and percentile 0.95 of 100; both are fixed here.
    """
    x = materialize(_centred(cells))
    rows, idx = _row_vectors(x, ["dataset_id", "row_id"])
    moments = (_moments(rows, ["dataset_id"]).select("dataset_id", "n", vector_to_array("s2").alias("s2"))
               .join(_attribute_lists(idx), "dataset_id"))

    def decompose(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                d = len(r.attrs)
                vals, vecs = np.linalg.eigh(np.asarray(r.s2).reshape(d, d) / r.n)
                pc = vecs[:, int(np.argmax(vals))]
                pc = pc if pc[int(np.argmax(np.abs(pc)))] >= 0 else -pc  # largest loading positive
                out += [(r.dataset_id, a, float(w)) for a, w in zip(r.attrs, pc, strict=True)]
            yield pd.DataFrame(out, columns=["dataset_id", "attr", "w"])

    w = moments.mapInPandas(decompose, "dataset_id long, attr string, w double")
    scores = x.join(w, ["dataset_id", "attr"]).groupBy("dataset_id", "row_id").agg(F.sum(F.col("x") * F.col("w")).alias("pc"))
    stats = scores.groupBy("dataset_id").agg(
        F.percentile_approx("pc", 0.95, accuracy).alias("pca.95%"),
        F.skewness("pc").alias("pca.skewness"), F.kurtosis("pc").alias("pca.kurtosis"))
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("value"))
                      for n in ["pca.95%", "pca.skewness", "pca.kurtosis"]])
    return stats.select("dataset_id", F.explode(items).alias("i")).select("dataset_id", "i.name", "i.value")


def linear_discriminant_accuracy(cells: DataFrame, folds: DataFrame) -> DataFrame:
    """Linear discriminant analysis, k-fold accuracy per dataset (mean over folds).

    Per (dataset, fold, class) the vector sums of x and x x^T over the
    dataset's own attributes come from one aggregation; training moments of a
    fold are the class totals minus that fold's part. A dataset's few moments
    (folds x classes) are solved as one group, giving per-class coefficients
    that one join applies to the test rows:
    ``delta_c(x) = x' S^-1 mu_c - mu_c' S^-1 mu_c / 2 + log prior_c``.
    """
    x = materialize(_centred(cells))
    rows, idx = _row_vectors(x, ["dataset_id", "row_id"])
    moments = (_moments(rows.join(folds, ["dataset_id", "row_id"]), ["dataset_id", "fold", "y"])
               .select("dataset_id", "fold", "y", "n", vector_to_array("s1").alias("s1"), vector_to_array("s2").alias("s2"))
               .join(_attribute_lists(idx), "dataset_id"))

    def solve(pdf):
        import numpy as np
        import pandas as pd

        attrs = list(pdf["attrs"].iloc[0])
        d, coef = len(attrs), []
        parts = {(r.fold, r.y): (float(r.n), np.asarray(r.s1), np.asarray(r.s2).reshape(d, d)) for r in pdf.itertuples(index=False)}
        nothing = (0.0, np.zeros(d), np.zeros((d, d)))
        classes = sorted({y for _, y in parts})
        totals = {y: [sum(m) for m in zip(*[v for (_, c), v in parts.items() if c == y], strict=True)] for y in classes}
        for f in sorted({f for f, _ in parts}):
            train = {y: [t - p for t, p in zip(totals[y], parts.get((f, y), nothing), strict=True)] for y in classes}
            train = {y: (n, s1 / n, s2) for y, (n, s1, s2) in train.items() if n > 0}
            n_all = sum(n for n, _, _ in train.values())
            if not train:
                continue
            scatter = sum(s2 - n * np.outer(mu, mu) for n, mu, s2 in train.values())
            inverse = np.linalg.pinv(scatter / max(n_all - len(train), 1.0))
            for y, (n, mu, _) in train.items():
                w = inverse @ mu
                coef += [(f, y, a, float(v), float(np.log(n / n_all) - mu @ w / 2)) for a, v in zip(attrs, w, strict=True)]
        out = pd.DataFrame(coef, columns=["fold", "y", "attr", "w", "b"])
        out.insert(0, "dataset_id", pdf["dataset_id"].iloc[0])
        return out

    cf = moments.groupBy("dataset_id").applyInPandas(solve, "dataset_id long, fold long, y string, attr string, w double, b double")
    test = x.join(folds.select("dataset_id", "row_id", "fold", F.col("y").alias("y_true")), ["dataset_id", "row_id"])
    score = (test.join(cf, ["dataset_id", "fold", "attr"])
             .groupBy("dataset_id", "fold", "row_id", "y_true", "y")
             .agg((F.sum(F.col("x") * F.col("w")) + F.max("b")).alias("delta")))
    pred = score.groupBy("dataset_id", "fold", "row_id", "y_true").agg(F.max(F.struct("delta", "y")).alias("best"))
    return (pred.groupBy("dataset_id", "fold")
            .agg(F.avg((F.col("best.y") == F.col("y_true")).cast("double")).alias("acc"))
            .groupBy("dataset_id").agg(F.avg("acc").alias("value")))


def _best_splits(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Best Gini split (attr, edge) per ``keys`` group from class counts per
    (keys, attr, bin, y); only splits with rows on both sides.

    Only bins that hold rows are looked at. Going through them in order, a
    class count n that moves from right to left changes the sums of squared
    class counts by 2ln + n^2 and n^2 - 2rn (l, r: the class's counts before).
    """
    group = [*keys, "attr"]
    own = Window.partitionBy(*group, "y").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce(F.sum("n").over(own), F.lit(0))
    total = F.sum("n").over(Window.partitionBy(*group, "y"))
    moved = (counts.repartition(*[F.col(c) for c in group]).withColumn("l", left).withColumn("r", total - F.col("l"))
             .withColumn("dl", 2 * F.col("l") * F.col("n") + F.col("n") * F.col("n"))
             .withColumn("dr", F.col("n") * F.col("n") - 2 * F.col("r") * F.col("n")))
    bins = moved.groupBy(*group, "bin").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"), F.sum("dr").alias("dr"))
    upto = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    split = bins.select(*group, F.col("bin").alias("edge"), F.sum("n").over(upto).alias("nl"), F.sum("n").over(whole).alias("n"),
                        F.sum("dl").over(upto).alias("sql"), (F.sum("dl").over(whole) + F.sum("dr").over(upto)).alias("sqr"))
    split = (split.withColumn("nr", F.col("n") - F.col("nl")).filter((F.col("nl") > 0) & (F.col("nr") > 0))
             .withColumn("imp", (F.col("nl") - F.col("sql") / F.col("nl")) + (F.col("nr") - F.col("sqr") / F.col("nr"))))
    return (split.groupBy(*keys).agg(F.min_by(F.struct("attr", "edge"), F.struct("imp", "attr", "edge")).alias("s"))
            .select(*keys, "s.attr", "s.edge"))


def decision_tree_f1(cells: DataFrame, folds: DataFrame, max_depth: int = 8, n_bins: int = 32) -> DataFrame:
    """Decision-tree landmarker: k-fold macro F1 per dataset (mean over folds).

    Gini trees on equal-width bin edges are grown level by level for every
    dataset and fold at once. Each row appears once per fold, as a training
    row (fold != f) or as a test row (fold == f); test rows descend the same
    splits. Rows carry their own bins and, being alike in all that a tree can
    see, are counted once with their number; so no level joins rows with cells.
    A level is: class counts per (dataset, fold, node, attr, bin) from the
    training rows, the best split per node (fixed-width left sums, no bin x class
    grid), and the children assignment by a join with the splits. Assignment,
    majorities and splits are written every level, so the lineage stays one level
    long and small tables are known to be small. Impure nodes with a valid split
    are split until ``max_depth``; a leaf predicts its majority class (ties:
    smallest label).
    """
    from metalens.session import materialize

    own = (_bins(cells, n_bins).groupBy("dataset_id", "row_id")
           .agg(F.sort_array(F.collect_list(F.struct("attr", "bin"))).alias("cells")))
    rows = (folds.select("dataset_id", "row_id", "y", F.col("fold").alias("own_fold")).join(own, ["dataset_id", "row_id"], "left")
            .groupBy("dataset_id", "own_fold", "y", "cells").agg(F.count(F.lit(1)).alias("n")))
    rows = materialize(rows)
    k_folds = materialize(rows.select("dataset_id", "own_fold").distinct()).withColumnRenamed("own_fold", "f")
    asg = materialize(
        rows.join(k_folds, "dataset_id")
        .select("dataset_id", F.col("f").alias("fold"), "y", "cells", "n",
                (F.col("own_fold") == F.col("f")).alias("is_test"), F.lit(1).cast("long").alias("node")))
    keys = ["dataset_id", "fold", "node"]
    majorities, finished = [], []
    for depth in range(max_depth + 1):
        train = asg.filter(~F.col("is_test"))
        node_cls = train.groupBy(*keys, "y").agg(F.sum("n").alias("n"))
        majority = materialize(node_cls.groupBy(*keys).agg(
            F.min_by("y", F.struct((-F.col("n")).alias("neg_n"), F.col("y"))).alias("y_hat"),
            F.count(F.lit(1)).alias("n_classes")))
        majorities.append(majority.select(*keys, "y_hat"))
        if depth == max_depth:
            finished.append(asg)
            break
        impure = majority.filter(F.col("n_classes") > 1).select(*keys)
        counts = (train.join(impure, keys, "left_semi").select(*keys, "y", "n", F.inline("cells"))
                  .groupBy(*keys, "attr", "bin", "y").agg(F.sum("n").alias("n")))
        splits = materialize(_best_splits(counts, keys))
        finished.append(asg.join(splits, keys, "left_anti"))
        moved = (asg.join(splits, keys)
                 .withColumn("bin", F.explode(F.expr("transform(filter(cells, c -> c.attr = attr), c -> c.bin)")))
                 .select("dataset_id", "fold", "y", "cells", "n", "is_test",
                         (F.col("node") * 2 + (F.col("bin") > F.col("edge")).cast("long")).alias("node")))
        asg = materialize(moved)
    leaves = majorities[0]
    for m in majorities[1:]:
        leaves = leaves.unionByName(m)
    final = finished[0]
    for fr in finished[1:]:
        final = final.unionByName(fr)
    pred = materialize(final.filter(F.col("is_test")).join(leaves, keys)
                       .groupBy("dataset_id", "fold", "y", "y_hat").agg(F.sum("n").alias("n")))
    labels = (pred.select("dataset_id", "fold", F.col("y").alias("c"))
              .unionByName(pred.select("dataset_id", "fold", F.col("y_hat").alias("c"))).distinct())
    stats = pred.groupBy("dataset_id", "fold").agg(F.sum("n").alias("_n"))  # folds with test rows
    per_c = (labels.join(pred, ["dataset_id", "fold"])
             .groupBy("dataset_id", "fold", "c").agg(
                 F.sum(((F.col("y") == F.col("c")) & (F.col("y_hat") == F.col("c"))).cast("long") * F.col("n")).alias("tp"),
                 F.sum(((F.col("y") != F.col("c")) & (F.col("y_hat") == F.col("c"))).cast("long") * F.col("n")).alias("fp"),
                 F.sum(((F.col("y") == F.col("c")) & (F.col("y_hat") != F.col("c"))).cast("long") * F.col("n")).alias("fn")))
    f1 = per_c.withColumn("f1", F.when((2 * F.col("tp") + F.col("fp") + F.col("fn")) > 0,
                                       2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
                          .otherwise(F.lit(0.0)))
    macro = f1.groupBy("dataset_id", "fold").agg(F.avg("f1").alias("f1")).join(stats, ["dataset_id", "fold"])
    return macro.groupBy("dataset_id").agg(F.avg("f1").alias("value"))
