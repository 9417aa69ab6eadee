"""Pipeline (configuration) characterizations from a steps table.

``steps`` has one row per (pipeline_id, pos, algorithm) with pos 0 for the
first executed step, and ``params`` one row per (pipeline_id, step_no,
algorithm, param, value). Everything is keyed by pipeline_id and computed for all
pipelines in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metalens.functions.configs import PREPROCESSING_STEPS, param_items, step_names


def parse_steps(pipes: DataFrame, drop: list[str] | None = None) -> DataFrame:
    """(pipeline_id, pos, algorithm, step_no), preprocessing steps removed.

    ``pos`` is renumbered; ``step_no`` is the place among all steps, by which parameters are found.
    """
    drop = PREPROCESSING_STEPS if drop is None else drop
    s = pipes.select("pipeline_id", F.posexplode(step_names("pipeline")).alias("pos", "algorithm")).withColumn("step_no", F.col("pos").cast("long"))
    if drop:
        s = s.filter(~F.col("algorithm").isin(drop))
        w = Window.partitionBy("pipeline_id").orderBy("pos")
        s = s.withColumn("pos", F.row_number().over(w) - 1)
    return s.withColumn("pos", F.col("pos").cast("long"))


def parse_params(pipes: DataFrame) -> DataFrame:
    """(pipeline_id, step_no, algorithm, param, value) for every ``Algo.param=value`` or ``param=value``."""
    return pipes.select("pipeline_id", F.explode(param_items("pipeline")).alias("i")).select("pipeline_id", "i.*")


def params_in_space(params: DataFrame, space: DataFrame) -> DataFrame:
    """Parameters that belong to the search space (semi-join on algorithm, param)."""
    return params.join(space.select("algorithm", "param").distinct(), ["algorithm", "param"], "left_semi")


def check_vocabulary(steps: DataFrame, vocabulary: list[str]) -> None:
    """An algorithm outside the vocabulary is an error."""
    spark = steps.sparkSession
    vocab = spark.createDataFrame([(a,) for a in vocabulary], "algorithm string")
    unknown = steps.select("algorithm").distinct().join(vocab, "algorithm", "left_anti").limit(20).collect()
    if unknown:
        raise ValueError(f"algorithms outside the vocabulary: {[r[0] for r in unknown]}")


def _vocab_frame(spark, vocabulary: list[str]) -> DataFrame:
    return spark.createDataFrame([(a, i) for i, a in enumerate(vocabulary)], "algorithm string, idx long")


def algorithm_bits(steps: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Set bits of the presence + successor encoding, long form.

    Index ``i`` for algorithm ``vocabulary[i]``; index ``n + i*n + j`` for
    ``a_i-->a_j`` when ``a_j`` directly follows ``a_i``. Returns
    (pipeline_id, idx, feature) for the bits equal to 1.
    """
    check_vocabulary(steps, vocabulary)
    n = len(vocabulary)
    vocab = F.broadcast(_vocab_frame(steps.sparkSession, vocabulary))
    s = steps.join(vocab, "algorithm")
    presence = s.select("pipeline_id", "idx", F.col("algorithm").alias("feature"))
    w = Window.partitionBy("pipeline_id").orderBy("pos")
    nxt = (s.withColumn("next_idx", F.lead("idx").over(w))
           .withColumn("next_alg", F.lead("algorithm").over(w))
           .filter(F.col("next_idx").isNotNull()))
    succ = nxt.select("pipeline_id", (F.lit(n) + F.col("idx") * n + F.col("next_idx")).alias("idx"),
                      F.concat("algorithm", F.lit("-->"), "next_alg").alias("feature"))
    return presence.unionByName(succ).distinct()


def algorithm_vectors(steps: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Dense 0/1 vector of length n + n^2 per pipeline (array<int>)."""
    n = len(vocabulary)
    bits = algorithm_bits(steps, vocabulary).groupBy("pipeline_id").agg(F.collect_set("idx").alias("on"))
    return bits.select("pipeline_id", F.transform(F.sequence(F.lit(0), F.lit(n + n * n - 1)),
                                                  lambda i: F.array_contains("on", i.cast("long")).cast("int"))
                       .alias("vector"))


def step_text(steps: DataFrame, params: DataFrame) -> DataFrame:
    """Canonical text ``Algo(p1=v1, p2=v2)`` of each step, parameters sorted by name."""
    p = (params.groupBy("pipeline_id", "step_no")
         .agg(F.array_sort(F.collect_list(F.concat("param", F.lit("="), "value"))).alias("kv")))
    return (steps.join(p, ["pipeline_id", "step_no"], "left")
            .withColumn("text", F.concat("algorithm", F.lit("("),
                                         F.array_join(F.coalesce("kv", F.array().cast("array<string>")), ", "),
                                         F.lit(")"))))


def step_hashes(steps: DataFrame, params: DataFrame) -> DataFrame:
    """MD5 of each step's text, last step first, padded with the hash of ""
    up to the longest pipeline. Long form (pipeline_id, pos, hash).

    The longest length is one scalar aggregate, joined back by broadcast.
    """
    t = step_text(steps, params)
    n = t.groupBy("pipeline_id").agg(F.count(F.lit(1)).alias("n"))
    longest = n.agg(F.max("n")).first()[0] or 0  # bounded scalar
    slots = n.select("pipeline_id", "n", F.explode(F.sequence(F.lit(0), F.lit(max(longest - 1, 0)))).alias("pos"))
    rev = t.join(n, "pipeline_id").select("pipeline_id", (F.col("n") - 1 - F.col("pos")).alias("pos"),
                                          F.md5("text").alias("hash"))
    return (slots.join(rev, ["pipeline_id", "pos"], "left")
            .select("pipeline_id", F.col("pos").cast("long").alias("pos"),
                    F.coalesce("hash", F.md5(F.lit(""))).alias("hash")))


def longest_pipeline(steps: DataFrame) -> DataFrame:
    return steps.groupBy("pipeline_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("longest"))


def apply_skip_rules(recs: DataFrame, steps: DataFrame, sizes: DataFrame,
                     rules: list[tuple[str, str]]) -> DataFrame:
    """Drop recommended pipelines containing an algorithm whose rule holds on the
    dataset's size. ``rules`` are (algorithm, SQL predicate over n_rows/n_cols),
    e.g. ``("KNeighborsClassifier", "n_rows * n_cols > 6000000")``."""
    flagged = None
    for algo, predicate in rules:
        bad = (recs.select("dataset_id", "pipeline_id").join(sizes, "dataset_id")
               .filter(F.expr(predicate))
               .join(steps.filter(F.col("algorithm") == algo).select("pipeline_id"), "pipeline_id", "left_semi"))
        flagged = bad if flagged is None else flagged.unionByName(bad)
    if flagged is None:
        return recs
    return recs.join(flagged.select("dataset_id", "pipeline_id").distinct(), ["dataset_id", "pipeline_id"], "left_anti")
