"""Sub-table sampling and pooled statistics of datasets (learned-characterization data path).

Per dataset and batch ``b``: up to ``n_rows`` instances, ``n_features``
numeric attributes and ``n_classes`` classes are drawn without replacement by
a seeded hash order; class labels are one-hot encoded, every (feature, class)
pair of a sampled row is formed, and statistics are pooled first over
instances per (class, feature), then over all (class, feature). A fixed
feature map (x, y, x*y, x^2) stands in for the pre-trained network, whose
weights are not available.

Sampling keeps ``row_number() <= n`` per (dataset, batch) so Spark applies a
partial window-group limit before the shuffle; only sampled rows are joined
back to the cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metalens.functions.hashing import seeded_hash
from metalens.session import materialize

# Sub-table sizes of the learned characterization.
N_ROWS, N_CLASSES, N_FEATURES = 256, 3, 16
POOL_DIMS = ["x", "y", "xy", "xx"]


def _batches(df: DataFrame, n_batches: int) -> DataFrame:
    return df.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_batches - 1).cast("long"))))


def _seed(seed: int):
    return F.lit(seed) + F.col("batch") * F.lit(7919)


def impute_mean(cells: DataFrame) -> DataFrame:
    """Numeric cells with nulls replaced by the (dataset, attr) mean."""
    num = cells.filter(~F.col("is_cat"))
    means = num.groupBy("dataset_id", "attr").agg(F.avg("num_val").alias("_m"))
    return (num.join(means, ["dataset_id", "attr"])
            .withColumn("num_val", F.coalesce("num_val", "_m")).drop("_m"))


def sample_rows(labels: DataFrame, n_batches: int, seed: int, n_rows: int = N_ROWS) -> DataFrame:
    """(dataset_id, batch, row_id): up to ``n_rows`` instances per dataset and batch."""
    b = _batches(labels.select("dataset_id", "row_id"), n_batches)
    b = b.withColumn("_h", seeded_hash("row_id", _seed(seed)))
    w = Window.partitionBy("dataset_id", "batch").orderBy("_h", "row_id")
    return b.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n_rows).select(
        "dataset_id", "batch", "row_id")


def numeric_stats(cells: DataFrame) -> DataFrame:
    """One aggregate per (dataset, attr): mean (for imputation) and the
    min/max of the imputed values (the mean joins the range when a value is
    missing)."""
    num = cells.filter(~F.col("is_cat"))
    st = num.groupBy("dataset_id", "attr").agg(
        F.avg("num_val").alias("_m"), F.min("num_val").alias("_lo0"), F.max("num_val").alias("_hi0"),
        F.max(F.col("num_val").isNull().cast("int")).alias("_miss"))
    return st.select("dataset_id", "attr", "_m",
                     F.when(F.col("_miss") == 1, F.least("_lo0", "_m")).otherwise(F.col("_lo0")).alias("_lo"),
                     F.when(F.col("_miss") == 1, F.greatest("_hi0", "_m")).otherwise(F.col("_hi0")).alias("_hi"))


def scaled_values(cells: DataFrame, stats: DataFrame, scale: bool = True) -> DataFrame:
    """Numeric cells, mean-imputed and (optionally) min-max scaled, in one join."""
    v = (cells.filter(~F.col("is_cat")).join(stats, ["dataset_id", "attr"])
         .withColumn("num_val", F.coalesce("num_val", "_m")))
    if scale:
        v = v.withColumn("num_val", F.when(F.col("_hi") > F.col("_lo"),
                                           (F.col("num_val") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
                         .otherwise(F.lit(0.0)))
    return v.drop("_m", "_lo", "_hi")


def sample_features(cells: DataFrame, n_batches: int, seed: int, n_features: int = N_FEATURES,
                    attrs: DataFrame | None = None) -> DataFrame:
    """(dataset_id, batch, attr): up to ``n_features`` numeric attributes per dataset and batch."""
    attrs = (attrs if attrs is not None else cells.filter(~F.col("is_cat"))).select("dataset_id", "attr").distinct()
    attrs = attrs.withColumn("_ai", F.dense_rank().over(Window.partitionBy("dataset_id").orderBy("attr")))
    b = _batches(attrs, n_batches).withColumn("_h", seeded_hash("_ai", _seed(seed) + 1))
    w = Window.partitionBy("dataset_id", "batch").orderBy("_h", "attr")
    return b.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n_features).select(
        "dataset_id", "batch", "attr")


def class_index(labels: DataFrame) -> DataFrame:
    """(dataset_id, y, class_idx): classes numbered in sorted label order."""
    classes = labels.select("dataset_id", "y").distinct()
    return classes.withColumn("class_idx", (F.dense_rank().over(Window.partitionBy("dataset_id").orderBy("y")) - 1)
                              .cast("long"))


def sample_classes(labels: DataFrame, n_batches: int, seed: int, n_classes: int = N_CLASSES) -> DataFrame:
    """(dataset_id, batch, class_idx, y): up to ``n_classes`` one-hot columns per batch."""
    c = _batches(class_index(labels), n_batches).withColumn("_h", seeded_hash("class_idx", _seed(seed) + 2))
    w = Window.partitionBy("dataset_id", "batch").orderBy("_h", "class_idx")
    return c.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n_classes).select(
        "dataset_id", "batch", "class_idx", "y")


def flatten_pairs(cells: DataFrame, labels: DataFrame, n_batches: int, seed: int, scale: bool = True) -> DataFrame:
    """All (feature, class) pairs of sampled rows: (dataset_id, batch, attr,
    class_idx, row_id, x, y) with y the row's one-hot value for the class.

    ``x`` is the mean-imputed value, min-max scaled over the whole dataset
    when ``scale`` (so that the pooled x^2 stays on a unit scale)."""
    # One pass over the cells for means, bounds and the attribute list; the
    # small result is written once because two branches read it.
    stats = materialize(numeric_stats(cells))
    rows = sample_rows(labels, n_batches, seed)
    feats = sample_features(cells, n_batches, seed, attrs=stats)
    classes = sample_classes(labels, n_batches, seed)
    values = scaled_values(cells, stats, scale)
    x = (values.join(rows, ["dataset_id", "row_id"])
         .join(feats, ["dataset_id", "batch", "attr"])
         .select("dataset_id", "batch", "attr", "row_id", F.col("num_val").alias("x")))
    lab = labels.select("dataset_id", "row_id", F.col("y").alias("label"))
    onehot = (rows.join(lab, ["dataset_id", "row_id"]).join(classes, ["dataset_id", "batch"])
              .select("dataset_id", "batch", "row_id", "class_idx",
                      (F.col("label") == F.col("y")).cast("double").alias("y")))
    return x.join(onehot, ["dataset_id", "batch", "row_id"])


def pooled_vectors(pairs: DataFrame) -> DataFrame:
    """Mean over instances per (class, feature), then over (class, feature),
    then over batches. Long form (dataset_id, dim, name, value)."""
    per_cf = pairs.groupBy("dataset_id", "batch", "class_idx", "attr").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"),
        F.avg(F.col("x") * F.col("y")).alias("xy"), F.avg(F.col("x") * F.col("x")).alias("xx"))
    per_batch = per_cf.groupBy("dataset_id", "batch").agg(*[F.avg(d).alias(d) for d in POOL_DIMS])
    per_ds = per_batch.groupBy("dataset_id").agg(*[F.avg(d).alias(d) for d in POOL_DIMS],
                                                 F.count(F.lit(1)).alias("n_batches"))
    items = F.array(*[F.struct(F.lit(i).cast("long").alias("dim"), F.col(d).alias("value"))
                      for i, d in enumerate(POOL_DIMS)])
    return (per_ds.select("dataset_id", "n_batches", F.explode(items).alias("i"))
            .select("dataset_id", "i.dim",
                    F.concat(F.lit("batch_"), F.col("n_batches").cast("string"), F.lit("_dim"),
                             F.col("i.dim").cast("string")).alias("name"),
                    "i.value"))
