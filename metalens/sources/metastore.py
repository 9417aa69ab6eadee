"""A metadatabase stored as parquet tables under one root folder.

Layout: ``evaluations/`` (partitioned by metric, so metric filters prune
files), ``datasets/`` and ``pipelines/`` (id lookups), ``dataset_chars/`` and
``pipeline_chars/`` (partitioned by method). Writes are appends of new files
only; readers of earlier snapshots are never disturbed.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metalens.functions.regret import valid_score
from metalens.operators import store
from metalens.operators.views import MetaView, partial_view
from metalens.sources import schemas
from metalens.sources.io import _exists, read_arff, split_features_target


class MetaStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        for sub in ("evaluations", "datasets", "pipelines"):
            if not _exists(spark, self._p(sub)):
                raise FileNotFoundError(self._p(sub))

    def _p(self, sub: str) -> str:
        return f"{self.root}/{sub}"

    # ---- creation and reading ---------------------------------------------------
    @classmethod
    def create(cls, spark: SparkSession, root: str) -> MetaStore:
        """Empty metadatabase with all tables (characterization stores inside the root)."""
        root = root.rstrip("/")
        if _exists(spark, f"{root}/evaluations"):
            raise FileExistsError(root)
        spark.createDataFrame([], schemas.EVALUATIONS).write.partitionBy("metric").parquet(f"{root}/evaluations")
        spark.createDataFrame([], schemas.DATASET_LOOKUP).write.parquet(f"{root}/datasets")
        spark.createDataFrame([], schemas.PIPELINE_LOOKUP).write.parquet(f"{root}/pipelines")
        spark.createDataFrame([], schemas.CHARACTERIZATIONS).write.partitionBy("method").parquet(f"{root}/dataset_chars")
        spark.createDataFrame([], schemas.PIPELINE_CHARACTERIZATIONS).write.partitionBy(
            "method").parquet(f"{root}/pipeline_chars")
        return cls(spark, root)

    def evaluations(self) -> DataFrame:
        """All evaluations; a NaN score is a missing one, as in the CSV reader."""
        rows = self.spark.read.schema(schemas.EVALUATIONS).parquet(self._p("evaluations"))
        return rows.withColumn("score", F.when(~F.isnan("score"), F.col("score")))

    def datasets(self) -> DataFrame:
        return self.spark.read.schema(schemas.DATASET_LOOKUP).parquet(self._p("datasets"))

    def pipelines(self) -> DataFrame:
        return self.spark.read.schema(schemas.PIPELINE_LOOKUP).parquet(self._p("pipelines"))

    def dataset_chars(self) -> DataFrame:
        return self.spark.read.schema(schemas.CHARACTERIZATIONS).parquet(self._p("dataset_chars"))

    def pipeline_chars(self) -> DataFrame:
        return self.spark.read.schema(schemas.PIPELINE_CHARACTERIZATIONS).parquet(self._p("pipeline_chars"))

    # ---- lookups ------------------------------------------------------------------
    def list_datasets(self, by: str = "both") -> DataFrame:
        cols = {"name": ["dataset"], "id": ["dataset_id"], "both": ["dataset", "dataset_id"]}[by]
        return self.datasets().select(*cols)

    def list_pipelines(self, by: str = "both") -> DataFrame:
        cols = {"name": ["pipeline"], "id": ["pipeline_id"], "both": ["pipeline", "pipeline_id"]}[by]
        return self.pipelines().select(*cols)

    def dataset_exists(self, name: str) -> bool:
        return self.datasets().filter(F.col("dataset") == name).limit(1).count() > 0

    def pipe_exists(self, pipeline: str) -> bool:
        return self.pipelines().filter(F.col("pipeline") == pipeline).limit(1).count() > 0

    def get_dataset_id(self, name: str) -> int:
        r = self.datasets().filter(F.col("dataset") == name).select("dataset_id").first()
        if r is None:
            raise store.UnknownKeyError(name)
        return int(r[0])

    def get_pipeline_id(self, pipeline: str) -> int:
        r = self.pipelines().filter(F.col("pipeline") == pipeline).select("pipeline_id").first()
        if r is None:
            raise store.UnknownKeyError(pipeline)
        return int(r[0])

    # ---- selections ---------------------------------------------------------------
    def get_df(self, datasets: list | None = None, pipelines: list | None = None, metrics: list[str] | None = None,
               logs_names: list[str] | None = None, avg_equivalent: bool = False, top_n: int | None = None) -> DataFrame:
        """Evaluations of the given datasets and pipelines (ids or names), metrics and runs.

        ``avg_equivalent`` averages the distinct scores of equal (dataset,
        pipeline, metric); ``top_n`` then keeps the best of each dataset and metric
        (ties: smaller pipeline id).
        """
        out = self.evaluations()
        for wanted, lookup, name, key in ((datasets, self.datasets(), "dataset", "dataset_id"), (pipelines, self.pipelines(), "pipeline", "pipeline_id")):
            if wanted is None:
                continue
            names = [w for w in wanted if isinstance(w, str)]
            ids = [w for w in wanted if not isinstance(w, str)]
            if names:
                ids += [r[0] for r in store.ids_for_names(lookup, names, name, key).collect()]  # the caller's own list
            out = out.filter(F.col(key).isin(ids))
        out = store.get_df(out, metrics=metrics, logs_names=logs_names)
        if avg_equivalent:
            distinct = out.distinct().groupBy("dataset_id", "pipeline_id", "metric")
            out = distinct.agg(F.avg("score").alias("score"), F.min("logs_name").alias("logs_name"))
        if top_n is not None:
            best = Window.partitionBy("dataset_id", "metric").orderBy(F.col("score").desc(), F.col("pipeline_id").asc(), F.col("logs_name").asc())
            out = out.filter(valid_score("score")).withColumn("position", F.row_number().over(best)).filter(F.col("position") <= top_n)
        return out

    def view(self, keep: DataFrame) -> MetaView:
        """The store restricted to the dataset ids in ``keep``; nothing is written."""
        return partial_view(self.evaluations(), self.datasets(), self.pipelines(), keep, self.dataset_chars(), self.pipeline_chars())

    def get_dataset(self, folder: str, dataset_id: int) -> tuple[DataFrame, DataFrame]:
        """(features, target) of a known dataset, from ``<dataset_id>.arff`` in ``folder``."""
        if self.datasets().filter(F.col("dataset_id") == dataset_id).isEmpty():
            raise store.UnknownKeyError(dataset_id)
        return split_features_target(read_arff(self.spark, f"{folder.rstrip('/')}/{dataset_id}.arff")[0])

    # ---- appends --------------------------------------------------------------------
    def add_evaluations(self, records: DataFrame) -> DataFrame:
        """Append (dataset, pipeline, score, metric, logs_name) records.

        Unseen dataset and pipeline names get new ids (max + 1, ...); a run name
        already present is an error. Returns the appended rows with ids.
        """
        runs = records.select("logs_name").distinct()
        store.check_no_overlap(self.evaluations().select("logs_name").distinct(), runs, "logs_name")
        new_ds = store.assign_new_ids(self.datasets(), records.select("dataset"), "dataset", "dataset_id")
        new_pp = store.assign_new_ids(self.pipelines(), records.select("pipeline"), "pipeline", "pipeline_id")
        new_ds = new_ds.cache()
        new_pp = new_pp.cache()
        new_ds.write.mode("append").parquet(self._p("datasets"))
        new_pp.write.mode("append").parquet(self._p("pipelines"))
        rows = (records.join(self.datasets(), "dataset").join(self.pipelines(), "pipeline")
                .select("dataset_id", "pipeline_id", F.col("score").cast("double"), "metric", "logs_name"))
        rows.write.mode("append").partitionBy("metric").parquet(self._p("evaluations"))
        new_ds.unpersist()
        new_pp.unpersist()
        return self.evaluations().join(runs, "logs_name", "left_semi")

    def add_run_top(self, records: DataFrame, n: int) -> DataFrame:
        """Append only the ``n`` best records (by usable score, ties by pipeline name)
        of each run in ``records`` (a finished search run's table part)."""
        w = Window.partitionBy("logs_name").orderBy(F.col("score").desc(), F.col("pipeline").asc())
        best = records.filter(valid_score("score")).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
        return self.add_evaluations(best)

    def add_dataset_characterizations(self, method: str, chars: DataFrame) -> None:
        """Append (dataset_id, values, names) for ``method``.

        Dataset ids must exist, must not already have this method, and every
        row must carry the same dimension names as the stored ones.
        """
        store.check_all_known(self.datasets(), chars, "dataset_id")
        existing = self.dataset_chars().filter(F.col("method") == method)
        store.check_no_overlap(existing, chars, "dataset_id")
        self._check_names(existing, chars)
        (chars.select(F.lit(method).alias("method"), "dataset_id", "values", "names")
         .write.mode("append").partitionBy("method").parquet(self._p("dataset_chars")))

    def add_pipeline_characterizations(self, method: str, chars: DataFrame) -> None:
        store.check_all_known(self.pipelines(), chars, "pipeline_id")
        existing = self.pipeline_chars().filter(F.col("method") == method)
        store.check_no_overlap(existing, chars, "pipeline_id")
        self._check_names(existing, chars)
        (chars.select(F.lit(method).alias("method"), "pipeline_id",
                      F.col("values").cast("array<string>").alias("values"), "names")
         .write.mode("append").partitionBy("method").parquet(self._p("pipeline_chars")))

    @staticmethod
    def _check_names(existing: DataFrame, chars: DataFrame) -> None:
        distinct = existing.select("names").unionByName(chars.select("names")).distinct().limit(2).count()
        if distinct > 1:
            raise ValueError("characterization dimension names differ from the stored ones")

    # ---- characterization lookups ----------------------------------------------------
    def list_dataset_characterizations(self, methods: list[str] | None = None, ids: list[int] | None = None) -> DataFrame:
        return list_characterizations(_chosen(self.dataset_chars(), methods, ids, "dataset_id"), "dataset_id")

    def list_pipeline_characterizations(self, methods: list[str] | None = None, ids: list[int] | None = None) -> DataFrame:
        return list_characterizations(_chosen(self.pipeline_chars(), methods, ids, "pipeline_id"), "pipeline_id")

    def get_dataset_characterizations(self, method: str, ids: list[int]) -> DataFrame:
        return ordered_lookup(self.dataset_chars().filter(F.col("method") == method), ids, "dataset_id")

    def get_configuration_characterizations(self, method: str, ids: list[int]) -> DataFrame:
        return ordered_lookup(self.pipeline_chars().filter(F.col("method") == method), ids, "pipeline_id")


def _chosen(chars: DataFrame, methods: list[str] | None, ids: list[int] | None, id_col: str) -> DataFrame:
    chars = chars if methods is None else chars.filter(F.col("method").isin(list(methods)))
    return chars if ids is None else chars.filter(F.col(id_col).isin(list(ids)))


def list_characterizations(chars: DataFrame, id_col: str = "dataset_id") -> DataFrame:
    """Per method: its ids (sorted) and their count; empty methods do not appear."""
    return chars.groupBy("method").agg(F.array_sort(F.collect_set(id_col)).alias("ids"),
                                       F.count_distinct(id_col).alias("n"))


def ordered_lookup(chars: DataFrame, ids: list[int], id_col: str = "dataset_id") -> DataFrame:
    """One row per requested id, in request order, duplicates kept; an unknown id is an error.

    The request list is the caller's argument (bounded); it becomes a small
    DataFrame with positions and meets the store in an equi-join.
    """
    spark = chars.sparkSession
    req = spark.createDataFrame([(i, int(v)) for i, v in enumerate(ids)], f"req_pos long, {id_col} long")
    out = req.join(chars, id_col, "left")
    missing = out.filter(F.col("values").isNull()).select(id_col).distinct().limit(20).collect()
    if missing:
        raise store.UnknownKeyError(f"no characterization for {id_col} {[r[0] for r in missing]}")
    return out.orderBy("req_pos")


def snapshot_path(root: str, name: str) -> str:
    return os.path.join(root, name)
