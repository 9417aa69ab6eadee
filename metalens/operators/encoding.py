"""Encoding of mixed attributes for model fitting, learned without the rows it is tested on.

A row belongs to one fold; "held" names the fold that is left out of training.
Everything an encoding learns (means, categories, class shares) for a held fold
is the dataset's total minus that fold's part, so all datasets and folds are
encoded by the same few aggregates and no training copy is made.

Numeric attributes: missing values become the training mean (0 without any).
Nominal attributes go by their number of training categories:

* up to 2: one column with 1 or 2 in the order of the names;
* up to ``one_hot_max``: a 0/1 column for each category;
* more: for each class but the first, the category's share of that class, drawn
  towards the share among all training rows by ``prior_weight`` rows.

A missing category, or one that no training row has, is 0, all 0, or the shares
of all training rows. Rows without a label teach no class shares. Encoded rows
are sparse: their size and the (pos, value) entries other than 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metalens.session import materialize

# Limits on the number of categories for the first two encodings.
ORDINAL_MAX, ONE_HOT_MAX = 2, 10
PRIOR_WEIGHT = 1.0


def _without_fold(part: DataFrame, held: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """``sums`` per (``keys``, held) over all folds but the held one; ``part`` has them per (keys, fold)."""
    total = part.groupBy(*keys).agg(*[F.sum(s).alias(f"all_{s}") for s in sums])
    own = part.withColumnRenamed("fold", "held")
    out = total.join(held, "dataset_id").join(own, [*keys, "held"], "left")
    return out.select(*keys, "held", *[(F.col(f"all_{s}") - F.coalesce(F.col(s), F.lit(0))).alias(s) for s in sums])


def _entry(pos: Column, value: Column) -> Column:
    return F.struct(pos.cast("int").alias("pos"), value.cast("double").alias("value"))


class Encoding:
    """What each held fold's training rows teach.

    ``attributes``: a row per (dataset_id, held, attr) with the column of a numeric
    attribute or the entries for unseen categories; ``codes``: the entries of each
    training category; ``columns``: the meaning of each position; ``sizes``.
    """

    def __init__(self, cells: DataFrame, folds: DataFrame, held: Sequence[int] | None = None, one_hot_max: int = ONE_HOT_MAX,
                 prior_weight: float = PRIOR_WEIGHT) -> None:
        self.held = list(held) if held is not None else None
        fold_rows = folds.select("dataset_id", "row_id", F.col("fold").cast("long").alias("fold"), "y")
        # Feeds the statistics and the encoding itself: written once.
        self.cells = materialize(cells.join(fold_rows, ["dataset_id", "row_id"]))
        by_class = fold_rows.filter("y IS NOT NULL").groupBy("dataset_id", "fold", "y").agg(F.count(F.lit(1)).alias("n"))
        held_ids = fold_rows.select("dataset_id", F.col("fold").alias("held")).distinct()
        if self.held is not None:
            held_ids = held_ids.select("dataset_id").distinct().withColumn("held", F.explode(F.array(*[F.lit(h).cast("long") for h in self.held])))
        key = ["dataset_id", "held", "attr"]

        numeric = self.cells.filter(~F.col("is_cat"))
        part = numeric.groupBy("dataset_id", "attr", "fold").agg(F.count("num_val").alias("n"), F.sum(F.coalesce("num_val", F.lit(0.0))).alias("s"))
        means = _without_fold(part, held_ids, ["dataset_id", "attr"], ["n", "s"]).select(
            *key, F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.lit(0.0)).alias("mean"))

        nominal = self.cells.filter("is_cat")
        part = nominal.filter("cat_val IS NOT NULL").groupBy("dataset_id", "attr", "cat_val", "y", "fold").agg(F.count(F.lit(1)).alias("n"))
        keys = ["dataset_id", "attr", "cat_val", "y"]
        part = part.withColumn("y", F.struct("y"))  # a missing class is a group that joins like any other
        counts = materialize(_without_fold(part, held_ids, keys, ["n"]).filter("n > 0").withColumn("y", F.col("y.y")))
        cats = counts.groupBy(*key, "cat_val").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y").isNotNull(), F.col("n")).otherwise(0)).alias("n_labelled"))
        spread = cats.groupBy(*key).agg(F.count(F.lit(1)).alias("n_cats"), F.min("cat_val").alias("first_cat"))
        kind = F.when(F.col("n_cats") <= ORDINAL_MAX, "ordinal").when(F.col("n_cats") <= one_hot_max, "one_hot").otherwise("target")
        kinds = materialize(nominal.select("dataset_id", "attr").distinct().join(held_ids, "dataset_id").join(spread, key, "left")
                            .withColumn("n_cats", F.coalesce("n_cats", F.lit(0))).withColumn("kind", kind))

        classes = _without_fold(by_class, held_ids, ["dataset_id", "y"], ["n"]).filter("n > 0")
        whole = Window.partitionBy("dataset_id", "held")  # a row per class
        classes = classes.withColumn("share", F.col("n") / F.sum("n").over(whole)).withColumn("first_y", F.min("y").over(whole))
        classes = classes.filter("y <> first_y").select("dataset_id", "held", "y", "share")
        by_share = kinds.filter("kind = 'target'").select(*key).join(classes, ["dataset_id", "held"])

        names = (means.select(*key, F.lit("").alias("part"))
                 .unionByName(kinds.filter("kind = 'ordinal'").select(*key, F.lit("").alias("part")))
                 .unionByName(cats.join(kinds.filter("kind = 'one_hot'").select(*key), key).select(*key, F.col("cat_val").alias("part")))
                 .unionByName(by_share.select(*key, F.col("y").alias("part"))))
        order = Window.partitionBy("dataset_id", "held").orderBy("attr", "part")  # a row per column of the dataset
        self.columns = materialize(names.withColumn("pos", (F.row_number().over(order) - 1).cast("int")))
        self.sizes = self.columns.groupBy("dataset_id", "held").agg(F.count(F.lit(1)).cast("int").alias("size"))

        pos = self.columns
        single = pos.filter("part = ''").select(*key, "pos")
        ordinal = cats.join(kinds.filter("kind = 'ordinal'").select(*key, "first_cat"), key).join(single, key).select(
            *key, "cat_val", F.array(_entry(F.col("pos"), F.when(F.col("cat_val") == F.col("first_cat"), 1.0).otherwise(2.0))).alias("entries"))
        one_hot = (cats.join(kinds.filter("kind = 'one_hot'").select(*key), key).join(pos.withColumnRenamed("part", "cat_val"), [*key, "cat_val"])
                   .select(*key, "cat_val", F.array(_entry(F.col("pos"), F.lit(1.0))).alias("entries")))
        by_share = materialize(by_share.join(pos.withColumnRenamed("part", "y"), [*key, "y"]))
        drawn = (F.coalesce("n_y", F.lit(0)) + F.lit(prior_weight) * F.col("share")) / (F.col("n_labelled") + F.lit(prior_weight))
        target = (cats.select(*key, "cat_val", "n_labelled").join(by_share, key).join(counts.withColumnRenamed("n", "n_y"), [*key, "cat_val", "y"], "left")
                  .groupBy(*key, "cat_val").agg(F.collect_list(_entry(F.col("pos"), drawn)).alias("entries")))  # an entry per class
        self.codes = materialize(ordinal.unionByName(one_hot).unionByName(target))
        unseen = by_share.groupBy(*key).agg(F.collect_list(_entry(F.col("pos"), F.col("share"))).alias("unseen"))
        nothing = F.array().cast("array<struct<pos:int,value:double>>")
        nominal_rows = kinds.select(*key).join(unseen, key, "left").select(*key, F.lit(None).cast("int").alias("pos"), F.lit(None).cast("double").alias("mean"), F.coalesce("unseen", nothing).alias("unseen"))
        numeric_rows = means.join(single, key).select(*key, "pos", "mean", nothing.alias("unseen"))
        self.attributes = materialize(nominal_rows.unionByName(numeric_rows))

    def encoded(self) -> DataFrame:
        """(dataset_id, held, row_id, y, in_test, size, entries), entries by position and without zeros.

        Each row once for every fold in ``held``; without ``held`` only for its own
        fold, so that no row is encoded by anything learned from its own part.
        """
        x = self.cells
        x = x.withColumn("held", F.col("fold") if self.held is None else F.explode(F.array(*[F.lit(h).cast("long") for h in self.held])))
        x = x.join(self.attributes, ["dataset_id", "held", "attr"]).join(self.codes, ["dataset_id", "held", "attr", "cat_val"], "left")
        own = F.when(F.col("is_cat"), F.coalesce("entries", "unseen")).otherwise(F.array(_entry(F.col("pos"), F.coalesce("num_val", "mean"))))
        rows = x.groupBy("dataset_id", "held", "row_id", "y", (F.col("fold") == F.col("held")).alias("in_test")).agg(F.flatten(F.collect_list(own)).alias("entries"))
        entries = F.array_sort(F.filter("entries", lambda e: e["value"] != 0))
        return rows.join(self.sizes, ["dataset_id", "held"]).select("dataset_id", "held", "row_id", "y", "in_test", "size", entries.alias("entries"))


def with_vectors(encoded: DataFrame, out: str = "features") -> DataFrame:
    """``encoded`` with an ml vector, sparse where that is smaller."""
    by_pos = F.map_from_entries("entries")
    dense = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.coalesce(F.try_element_at(by_pos, i), F.lit(0.0)))
    wide = encoded.withColumn("_dense", array_to_vector(dense))
    return VectorAssembler(inputCols=["_dense"], outputCol=out).transform(wide).drop("_dense")
