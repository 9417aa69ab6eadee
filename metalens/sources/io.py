"""Readers and writers of the metadatabase's files, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metalens.sources import schemas


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def require(spark: SparkSession, *paths: str) -> None:
    """Raise FileNotFoundError for the first missing path (any Hadoop file system)."""
    for p in paths:
        if not _exists(spark, p):
            raise FileNotFoundError(p)


def read_evaluations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Evaluations (dataset_id, pipeline_id, score, metric, logs_name).

    CSV files written by pandas may carry a leading index column and may lack
    ``logs_name``; both are handled by reading with a header and selecting.
    """
    require(spark, path)
    if fmt == "parquet":
        return spark.read.schema(schemas.EVALUATIONS).parquet(path)
    raw = spark.read.option("header", True).csv(path)
    cols = {c: c for c in raw.columns}
    out = raw.select(
        F.col("dataset_id").cast("long").alias("dataset_id"),
        F.col("pipeline_id").cast("long").alias("pipeline_id"),
        F.col("score").cast("double").alias("score"),
        F.col("metric").cast("string").alias("metric"),
        (F.col("logs_name") if "logs_name" in cols else F.lit(None).cast("string")).alias("logs_name"))
    return out.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def read_lookup(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Pipeline or dataset lookup CSV (pandas index column tolerated)."""
    require(spark, path)
    name = "pipeline" if kind == "pipelines" else "dataset"
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return raw.select(F.col(name).cast("string").alias(name), F.col(f"{name}_id").cast("long").alias(f"{name}_id"))


def read_characterizations(spark: SparkSession, path: str, method: str, id_col: str = "dataset_id",
                           keep_strings: bool = False) -> DataFrame:
    """One CSV per method: id + named dimensions -> (method, id, values, names).

    Dimensions are read as strings and cast to double unless ``keep_strings``
    (pipeline characterizations may hold hashes).
    """
    require(spark, path)
    raw = spark.read.option("header", True).csv(path)
    dims = [c for c in raw.columns if c not in (id_col, "_c0", "")]
    elem = (lambda c: F.col(f"`{c}`").cast("string")) if keep_strings else (lambda c: F.col(f"`{c}`").cast("double"))
    return raw.select(F.lit(method).alias("method"), F.col(id_col).cast("long").alias(id_col),
                      F.array(*[elem(c) for c in dims]).alias("values"),
                      F.array(*[F.lit(c) for c in dims]).alias("names"))


def read_results(spark: SparkSession, path: str, metric: str = "neg_log_loss") -> DataFrame:
    """Results CSV ``metalearner_name,dataset_id,<metric>`` -> (metalearner_name, dataset_id, score)."""
    require(spark, path)
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col("metalearner_name").cast("string"), F.col("dataset_id").cast("long"),
                      F.col(metric).cast("double").alias("score"))


def read_timing_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``... at yyyy-MM-dd HH:mm:ss.SSSSSS`` -> (line_no, ts), in file order."""
    require(spark, path)
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    stamp = F.element_at(F.split("value", " at "), -1)
    return lines.select("line_no", F.to_timestamp(F.trim(stamp), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


def read_evaluation_log(spark: SparkSession, path: str, field: int = 6) -> DataFrame:
    """``;``-separated log with a header; field ``field`` (1-based: the sixth) holds a tuple
    text ``(score, ...)``: its first item as a double, one row per line."""
    require(spark, path)
    raw = spark.read.option("header", True).option("sep", ";").csv(path)
    col = raw.columns[field - 1]
    first = F.regexp_extract(F.col(f"`{col}`"), r"^\s*\(?\s*([^,()]+)", 1)
    return (raw.withColumn("eval_no", F.monotonically_increasing_id())
            .select("eval_no", F.trim(first).cast("double").alias("score")))


def read_arff(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """A dense ARFF file -> (DataFrame, attribute names, nominal attribute names).

    Only the ``@attribute`` header lines (one per column) are brought to the
    driver to build the schema; data lines are parsed by ``from_csv`` on the
    executors. Nominal attributes stay strings; the last attribute is the target.
    """
    require(spark, path)
    lines = spark.read.text(path)
    header = (lines.filter(F.lower(F.trim("value")).startswith("@attribute"))
              .withColumn("_i", F.monotonically_increasing_id()).orderBy("_i").collect())
    names, nominal, fields = [], [], []
    for row in header:
        body = row["value"].strip()[len("@attribute"):].strip()
        if body.startswith("'") or body.startswith('"'):
            q = body[0]
            end = body.index(q, 1)
            name, kind = body[1:end], body[end + 1:].strip()
        else:
            name, _, kind = body.partition(" ")
            kind = kind.strip()
        names.append(name)
        if kind.startswith("{") or kind.lower() in ("string", "date"):
            nominal.append(name)
            fields.append(T.StructField(name, T.StringType(), True))
        else:
            fields.append(T.StructField(name, T.DoubleType(), True))
    data = lines.filter((F.length(F.trim("value")) > 0) & ~F.trim("value").startswith("@")
                        & ~F.trim("value").startswith("%"))
    # Fields are read as text first: a lone ? is a missing value, a ? inside a value is not.
    text = ", ".join(f"`{f.name}` string" for f in fields)
    single = F.regexp_replace("value", r'(^|,)\s*"((?:[^"\\\\]|\\\\.)*)"\s*(?=,|$)', "$1'$2'")
    parsed = data.select(F.from_csv(single, text, {"quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r")).select("r.*")
    return parsed.select(*[F.when(F.col(f"`{f.name}`") != "?", F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in fields]), names, nominal


def split_features_target(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features = all columns but the last; target = the last column."""
    cols = df.columns
    return df.select(*[F.col(f"`{c}`") for c in cols[:-1]]), df.select(F.col(f"`{cols[-1]}`"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Processed results export: CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def store_results(spark: SparkSession, results: list[tuple[int, list[float | None]]], learner: str,
                  path: str, metric: str = "neg_log_loss") -> DataFrame:
    """Evaluation results (dataset, list of scores or None) -> CSV rows
    (metalearner_name, dataset_id, <metric>); datasets without any result are
    dropped, scores stay doubles."""
    df = spark.createDataFrame([(learner, int(d), s) for d, s in results],
                               "metalearner_name string, dataset_id long, scores array<double>")
    out = (df.filter(F.exists("scores", lambda x: x.isNotNull()))
           .select("metalearner_name", "dataset_id", F.posexplode("scores").alias("slot", metric))
           .withColumn("slot", F.col("slot") + 1))
    write_csv(out, path)
    return out

