"""Metadatabase selections: filters, lookups, equivalent-run averaging, top-n.

The evaluations table is the fact table (dataset_id, pipeline_id, score,
metric, logs_name, plus a unique ``eval_id`` used as the last tie-break).
Lookups are small dimension tables; filters by name become semi-joins on the
lookup so that Catalyst keeps the fact scan streaming.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metalens.functions.regret import valid_score


class UnknownKeyError(KeyError):
    """A requested name or id is not in the lookup table."""


def _ids_frame(spark, values: Iterable, name: str, dtype: str) -> DataFrame:
    rows = [(v,) for v in values]
    return spark.createDataFrame(rows, f"{name} {dtype}")


def get_df(evals: DataFrame, datasets: list[int] | None = None, pipelines: list[int] | None = None,
           metrics: list[str] | None = None, logs_names: list[str] | None = None) -> DataFrame:
    """Evaluations restricted by dataset ids, pipeline ids, metrics and run names.

    Literal ``isin`` lists are pushed into the parquet scan as ``In`` filters.
    """
    out = evals
    if datasets is not None:
        out = out.filter(F.col("dataset_id").isin(list(datasets)))
    if pipelines is not None:
        out = out.filter(F.col("pipeline_id").isin(list(pipelines)))
    if metrics is not None:
        out = out.filter(F.col("metric").isin(list(metrics)))
    if logs_names is not None:
        out = out.filter(F.col("logs_name").isin(list(logs_names)))
    return out


def ids_for_names(lookup: DataFrame, names: list[str], name_col: str, id_col: str) -> DataFrame:
    """Ids of the given names; raises for a name not in the lookup.

    The existence check is a left-anti join of the requested names against the
    lookup; only the (bounded) list of missing names reaches the driver.
    """
    spark = lookup.sparkSession
    wanted = _ids_frame(spark, names, name_col, "string")
    missing = wanted.join(lookup.select(name_col), name_col, "left_anti").limit(20).collect()
    if missing:
        raise UnknownKeyError(f"unknown {name_col}: {[r[0] for r in missing]}")
    return lookup.join(wanted, name_col, "left_semi").select(id_col)


def get_df_by_names(evals: DataFrame, dataset_lookup: DataFrame | None = None, dataset_names: list[str] | None = None,
                    pipeline_lookup: DataFrame | None = None, pipeline_names: list[str] | None = None) -> DataFrame:
    """Evaluations of named datasets / pipelines (name -> id via the lookups)."""
    out = evals
    if dataset_names is not None:
        ids = ids_for_names(dataset_lookup, dataset_names, "dataset", "dataset_id")
        out = out.join(ids, "dataset_id", "left_semi")
    if pipeline_names is not None:
        ids = ids_for_names(pipeline_lookup, pipeline_names, "pipeline", "pipeline_id")
        out = out.join(ids, "pipeline_id", "left_semi")
    return out


def average_equivalent(evals: DataFrame) -> DataFrame:
    """Drop exact duplicate records, then average equal (dataset, pipeline, metric).

    One output row per group with the mean score (from an exact decimal sum,
    so it is identical for any partitioning), the run name of the group's
    first record (smallest ``eval_id``) and the number of distinct records
    averaged. Both steps are hash aggregates with map-side partial merge, so a
    hot group never lands whole in one task.
    """
    keys = ["dataset_id", "pipeline_id", "score", "metric", "logs_name"]
    dedup = evals.groupBy(*keys).agg(F.min("eval_id").alias("eval_id"))
    # Exact decimal sum: the mean does not depend on how rows are partitioned.
    exact_sum = F.sum(F.col("score").cast("decimal(38,18)")).cast("double")
    return (dedup.groupBy("dataset_id", "pipeline_id", "metric")
            .agg((exact_sum / F.count("score")).alias("score"),
                 F.min_by("logs_name", "eval_id").alias("logs_name"),
                 F.count(F.lit(1)).alias("n_records")))


def top_n_per_dataset(evals: DataFrame, n: int, metric: str, score_col: str = "score",
                      tie_cols: tuple[str, ...] = ("pipeline_id", "eval_id")) -> DataFrame:
    """Best ``n`` records of each dataset for ``metric``, with their position.

    ``row_number() <= n`` lets Spark insert a partial WindowGroupLimit before the
    shuffle: each map task forwards at most ``n`` rows per dataset, so even a
    dataset holding a third of all rows costs only n x (map tasks) rows after
    the exchange. Ties are broken by pipeline id and then the record id.
    Scores that aren't usable (null, NaN, infinite) are no candidates.
    """
    order = [F.col(score_col).desc()] + [F.col(c).asc() for c in tie_cols]
    w = Window.partitionBy("dataset_id").orderBy(*order)
    return (evals.filter((F.col("metric") == metric) & valid_score(score_col))
            .withColumn("position", F.row_number().over(w))
            .filter(F.col("position") <= n))


def top_n_global(evals: DataFrame, n: int, metric: str) -> DataFrame:
    """Best ``n`` records with a usable score over all selected datasets together (``TakeOrdered``)."""
    return (evals.filter((F.col("metric") == metric) & valid_score("score"))
            .orderBy(F.col("score").desc(), F.col("pipeline_id").asc(), F.col("eval_id").asc())
            .limit(n))


def relevance_labels(evals: DataFrame, n: int, metric: str) -> DataFrame:
    """Top ``n`` per dataset labelled n..1 (best highest), query id = dataset id."""
    top = top_n_per_dataset(evals, n, metric)
    size = F.count(F.lit(1)).over(Window.partitionBy("dataset_id"))
    return (top.withColumn("relevance", size - F.col("position") + 1)
            .withColumn("qid", F.col("dataset_id")))


def candidate_set(evals: DataFrame, n: int, metric: str) -> DataFrame:
    """Distinct pipelines that are among the top ``n`` of at least one dataset."""
    return top_n_per_dataset(evals, n, metric).select("pipeline_id").distinct()


def dataset_bounds(evals: DataFrame, score_col: str = "score") -> DataFrame:
    """Per-dataset min and max score (hash aggregate, one row per dataset)."""
    usable = F.when(valid_score(score_col), F.col(score_col))
    return evals.groupBy("dataset_id").agg(F.min(usable).alias("min_score"), F.max(usable).alias("max_score"))


def assign_new_ids(lookup: DataFrame, names: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """Ids for names not yet in the lookup, continuing after the largest id.

    Returns (name, id) for the unseen names only; new ids are ``max + 1``,
    ``max + 2``, ... in name order (the reference restarts at the max id and
    collides; this does not).
    """
    unseen = names.select(name_col).distinct().join(lookup.select(name_col), name_col, "left_anti")
    start = lookup.agg(F.max(id_col)).first()[0]
    start = -1 if start is None else int(start)
    numbered = global_row_number(unseen, [F.col(name_col).asc()], "_no")
    return numbered.select(name_col, (F.col("_no") + F.lit(start)).cast("long").alias(id_col))


def check_no_overlap(existing: DataFrame, new: DataFrame, key: str) -> None:
    """Raise if any key of ``new`` already exists (append without overwrite)."""
    clash = new.select(key).join(existing.select(key), key, "left_semi").distinct().limit(20).collect()
    if clash:
        raise ValueError(f"{key} already present: {[r[0] for r in clash]}")


def check_all_known(known: DataFrame, new: DataFrame, key: str) -> None:
    """Raise if ``new`` refers to a key missing from ``known``."""
    miss = new.select(key).join(known.select(key), key, "left_anti").distinct().limit(20).collect()
    if miss:
        raise UnknownKeyError(f"unknown {key}: {[r[0] for r in miss]}")


def global_row_number(df: DataFrame, order: list, out: str = "row_no") -> DataFrame:
    """1-based position of each row in a global order, without a
    single-partition window and without leaving the JVM.

    The range-partitioned sort is tagged with ``monotonically_increasing_id``
    (partition index in the upper bits) and written once, so the ids are
    stable; per-partition row counts (one row per partition) give each
    partition's offset.
    """
    from metalens.session import materialize
    tagged = materialize(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), 33)
    sizes = tagged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (tagged.withColumn("_p", part).join(F.broadcast(offsets), "_p")
            .withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("long"))
            .drop("_p", "_n", "_m0", "_off", "_mid"))
