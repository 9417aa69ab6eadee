"""Streaming view of appended evaluations: best score so far per run.

Evaluations arrive as appended parquet files (the store's append path). A
Structured Streaming aggregation keeps, per run, the best score, the number of
evaluations and the latest evaluation number; the state is one row per run and
the checkpoint location makes the query restartable after executor or driver
loss. ``update`` mode emits only the runs touched by each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_LOG = T.StructType([
    T.StructField("run_id", T.LongType(), False),
    T.StructField("eval_no", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("score", T.DoubleType(), True),
])


def run_best_stream(spark: SparkSession, source_dir: str, schema: T.StructType = RUN_LOG,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame (run_id, best_score, n_evals, last_eval_no)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    logs = reader.parquet(source_dir)
    return (logs.filter(F.col("score").isNotNull() & ~F.isnan("score"))
            .groupBy("run_id")
            .agg(F.max("score").alias("best_score"), F.count(F.lit(1)).alias("n_evals"),
                 F.max("eval_no").alias("last_eval_no")))


def start_run_best(spark: SparkSession, source_dir: str, checkpoint_location: str, query_name: str = "run_best",
                   sink: str = "memory"):
    """Start the query into ``sink`` (``memory`` for tests; any table/format otherwise)."""
    stream = run_best_stream(spark, source_dir)
    writer = (stream.writeStream.outputMode("update" if sink != "memory" else "complete")
              .option("checkpointLocation", checkpoint_location).queryName(query_name))
    return writer.format(sink).start()
