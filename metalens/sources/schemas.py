"""Explicit schemas of the stored tables (no inference anywhere)."""

from pyspark.sql import types as T

EVALUATIONS = T.StructType([
    T.StructField("dataset_id", T.LongType(), False),
    T.StructField("pipeline_id", T.LongType(), False),
    T.StructField("score", T.DoubleType(), True),
    T.StructField("metric", T.StringType(), False),
    T.StructField("logs_name", T.StringType(), True),
])

PIPELINE_LOOKUP = T.StructType([
    T.StructField("pipeline", T.StringType(), False),
    T.StructField("pipeline_id", T.LongType(), False),
])

DATASET_LOOKUP = T.StructType([
    T.StructField("dataset", T.StringType(), False),
    T.StructField("dataset_id", T.LongType(), False),
])

CHARACTERIZATIONS = T.StructType([
    T.StructField("method", T.StringType(), False),
    T.StructField("dataset_id", T.LongType(), False),
    T.StructField("values", T.ArrayType(T.DoubleType()), False),
    T.StructField("names", T.ArrayType(T.StringType()), False),
])

RESULTS = T.StructType([
    T.StructField("metalearner_name", T.StringType(), False),
    T.StructField("dataset_id", T.LongType(), False),
    T.StructField("score", T.DoubleType(), True),
])

PIPELINE_CHARACTERIZATIONS = T.StructType([
    T.StructField("method", T.StringType(), False),
    T.StructField("pipeline_id", T.LongType(), False),
    T.StructField("values", T.ArrayType(T.StringType()), False),
    T.StructField("names", T.ArrayType(T.StringType()), False),
])
