"""Dataset meta-features for all datasets at once, by group-by on a long form.

Wide per-dataset tables are unpivoted to cells (dataset_id, row_id, attr,
is_cat, num_val, cat_val) and labels (dataset_id, row_id, y). Every feature is
then an aggregate keyed by dataset_id (and attr); Spark merges partial
aggregates map-side, so a dataset holding a third of all cells is spread over
all tasks until the final, one-row-per-key merge.

Output is long: (dataset_id, name, value). NaN, infinities and undefined
values (e.g. the sample sd of a single value) become 0, as the reference does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metalens.functions.regret import finite_or_zero

# Meta-feature names (as produced by the reference's feature sets).
SIMPLE_NAMES = ["nr_inst", "log_nr_inst", "nr_attr", "log_nr_attr", "nr_class", "nr_cat", "nr_num",
                "cat_to_num", "num_to_cat", "attr_to_inst", "log_attr_to_inst", "inst_to_attr",
                "log_inst_to_attr"]
SUMMARIES = ["min", "max", "mean", "sd"]
MISSING_NAMES = ["nr_rows_with_missval", "miss_rows_perc", "nr_cols_with_missval", "miss_cols_perc",
                 "n_miss_values", "perc_miss_values"]
CATEGORICAL_NAMES = ["categorical_values.min", "categorical_values.max", "categorical_values.mean",
                     "categorical_values.std", "categorical_values.total"]


def to_cells(wide: DataFrame, numeric: list[str], categorical: list[str],
             id_cols: tuple[str, str] = ("dataset_id", "row_id")) -> DataFrame:
    """Unpivot attribute columns into one row per (row, attribute)."""
    items = [F.struct(F.lit(c).alias("attr"), F.lit(False).alias("is_cat"),
                      F.col(c).cast("double").alias("num_val"), F.lit(None).cast("string").alias("cat_val"))
             for c in numeric]
    items += [F.struct(F.lit(c).alias("attr"), F.lit(True).alias("is_cat"),
                       F.lit(None).cast("double").alias("num_val"), F.col(c).cast("string").alias("cat_val"))
              for c in categorical]
    ds, row = id_cols
    return (wide.select(F.col(ds).cast("long").alias("dataset_id"), F.col(row).alias("row_id"),
                        F.explode(F.array(*items)).alias("c"))
            .select("dataset_id", "row_id", "c.*"))


def labels_of(wide: DataFrame, target: str, id_cols: tuple[str, str] = ("dataset_id", "row_id")) -> DataFrame:
    ds, row = id_cols
    return wide.select(F.col(ds).cast("long").alias("dataset_id"), F.col(row).alias("row_id"),
                       F.col(target).cast("string").alias("y"))


def _long(df: DataFrame, names: list[str]) -> DataFrame:
    """Wide (dataset_id, <names>) -> long (dataset_id, name, value), zeroing non-finite."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("value"))
                      for n in names])
    out = df.select("dataset_id", F.explode(pairs).alias("p")).select("dataset_id", "p.name", "p.value")
    return out.withColumn("value", F.coalesce(finite_or_zero("value"), F.lit(0.0)))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def attribute_stats(cells: DataFrame) -> DataFrame:
    """One row per (dataset, attribute): type, missing count, distinct
    categories (missing counted as one), skewness and kurtosis (population)."""
    return cells.groupBy("dataset_id", "attr").agg(
        F.max(F.col("is_cat").cast("int")).cast("boolean").alias("is_cat"),
        F.sum(F.when(F.col("num_val").isNull() & F.col("cat_val").isNull(), 1).otherwise(0)).alias("n_missing"),
        (F.count_distinct("cat_val")
         + F.max(F.when(F.col("is_cat") & F.col("cat_val").isNull(), 1).otherwise(0))).alias("n_categories"),
        F.skewness("num_val").alias("skewness"),
        F.kurtosis("num_val").alias("kurtosis"))


def simple_features(cells: DataFrame, labels: DataFrame) -> DataFrame:
    inst = labels.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("nr_inst"),
                                           F.count_distinct("y").alias("nr_class"))
    attrs = (attribute_stats(cells).groupBy("dataset_id")
             .agg(F.count(F.lit(1)).alias("nr_attr"),
                  F.sum(F.col("is_cat").cast("int")).alias("nr_cat"),
                  F.sum((~F.col("is_cat")).cast("int")).alias("nr_num")))
    d = inst.join(attrs, "dataset_id")
    d = (d.withColumn("cat_to_num", F.coalesce(_ratio(F.col("nr_cat"), F.col("nr_num")), F.lit(0.0)))
         .withColumn("num_to_cat", F.coalesce(_ratio(F.col("nr_num"), F.col("nr_cat")), F.lit(0.0)))
         .withColumn("attr_to_inst", _ratio(F.col("nr_attr"), F.col("nr_inst")))
         .withColumn("inst_to_attr", _ratio(F.col("nr_inst"), F.col("nr_attr"))))
    for base in ["nr_inst", "nr_attr", "attr_to_inst", "inst_to_attr"]:
        d = d.withColumn(f"log_{base}", F.log(F.col(base).cast("double")))
    return _long(d, SIMPLE_NAMES)


def class_features(labels: DataFrame) -> DataFrame:
    """class_ent (bits) and freq_class min/max/mean/sd."""
    counts = labels.groupBy("dataset_id", "y").agg(F.count(F.lit(1)).alias("n"))
    tot = counts.groupBy("dataset_id").agg(F.sum("n").alias("total"))
    p = counts.join(tot, "dataset_id").withColumn("p", F.col("n") / F.col("total"))
    d = p.groupBy("dataset_id").agg(
        (-F.sum(F.col("p") * F.log2("p"))).alias("class_ent"),
        F.min("p").alias("freq_class.min"), F.max("p").alias("freq_class.max"),
        F.avg("p").alias("freq_class.mean"), F.stddev_samp("p").alias("freq_class.sd"))
    return _long(d, ["class_ent"] + [f"freq_class.{s}" for s in SUMMARIES])


def moment_features(cells: DataFrame) -> DataFrame:
    """kurtosis and skewness of each numeric attribute, summarised over attributes."""
    a = attribute_stats(cells).filter(~F.col("is_cat"))
    aggs = []
    for m in ["kurtosis", "skewness"]:
        v = F.coalesce(finite_or_zero(m), F.lit(0.0))
        aggs += [F.min(v).alias(f"{m}.min"), F.max(v).alias(f"{m}.max"),
                 F.avg(v).alias(f"{m}.mean"), F.stddev_samp(v).alias(f"{m}.sd")]
    d = a.groupBy("dataset_id").agg(*aggs)
    return _long(d, [f"{m}.{s}" for m in ["kurtosis", "skewness"] for s in SUMMARIES])


def missing_features(cells: DataFrame) -> DataFrame:
    """Rows, columns and cells with missing values: counts and shares."""
    miss = F.col("num_val").isNull() & F.col("cat_val").isNull()
    rows = (cells.groupBy("dataset_id", "row_id").agg(F.max(miss.cast("int")).alias("m"))
            .groupBy("dataset_id").agg(F.sum("m").alias("nr_rows_with_missval"), F.count(F.lit(1)).alias("n_rows")))
    cols = (attribute_stats(cells).groupBy("dataset_id")
            .agg(F.sum((F.col("n_missing") > 0).cast("int")).alias("nr_cols_with_missval"),
                 F.count(F.lit(1)).alias("n_cols"), F.sum("n_missing").alias("n_miss_values")))
    d = (rows.join(cols, "dataset_id")
         .withColumn("miss_rows_perc", F.col("nr_rows_with_missval") / F.col("n_rows"))
         .withColumn("miss_cols_perc", F.col("nr_cols_with_missval") / F.col("n_cols"))
         .withColumn("perc_miss_values", F.col("n_miss_values") / (F.col("n_rows") * F.col("n_cols"))))
    return _long(d, MISSING_NAMES)


def categorical_features(cells: DataFrame) -> DataFrame:
    """Distinct categories per categorical attribute: min/max/mean/std(pop)/total.

    Datasets without categorical attributes get zeros.
    """
    a = attribute_stats(cells)
    d = a.groupBy("dataset_id").agg(
        F.min(F.when(F.col("is_cat"), F.col("n_categories"))).alias("categorical_values.min"),
        F.max(F.when(F.col("is_cat"), F.col("n_categories"))).alias("categorical_values.max"),
        F.avg(F.when(F.col("is_cat"), F.col("n_categories"))).alias("categorical_values.mean"),
        F.stddev_pop(F.when(F.col("is_cat"), F.col("n_categories"))).alias("categorical_values.std"),
        F.sum(F.when(F.col("is_cat"), F.col("n_categories"))).alias("categorical_values.total"))
    return _long(d, CATEGORICAL_NAMES)


def feature_set(cells: DataFrame, labels: DataFrame, which: str = "full") -> DataFrame:
    """A named set as the union of its parts (long form).

    The cells feed several aggregations; they are written once so the source
    is read once.
    """
    from metalens.session import materialize
    cells = materialize(cells)
    parts = [simple_features(cells, labels), class_features(labels), moment_features(cells)]
    if which == "full":
        parts += [missing_features(cells), categorical_features(cells)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feasible_features(raw: DataFrame) -> DataFrame:
    """Features finite (not null, NaN or infinite) on every dataset.

    ``raw`` is (dataset_id, name, value) before zeroing. One aggregate per
    feature name; the reference's list-removal loop skipped neighbours.
    """
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != F.lit(float("inf")))
    return (raw.groupBy("name").agg(F.bool_and(finite).alias("ok"))
            .filter(F.col("ok")).select("name"))
