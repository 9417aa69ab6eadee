"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each reads the driver tables (through the stand-ins of ``sources.tables``) in
full; parameters such as ``k`` or a dataset id list are the operator's own
arguments, not row caps. Computed doubles are rounded to 10 decimals so that
results compare exactly with the DuckDB oracle in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metalens.functions.regret import rnd
from metalens.operators import store
from metalens.plans import recommend
from metalens.session import materialize
from metalens.sources.tables import fixture

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}

# Query parameters shared with the oracle SQL.
METRIC = "neg_log_loss"
SELECTED_DATASETS = [1, 2, 3, 5, 8, 13, 21, 34]
SELECTED_RUNS = ["d1_AsyncEA", "d2_RandomSearch", "d3_AsynchronousSuccessiveHalving", "d5_AsyncEA",
                 "d8_AsyncEA", "d13_RandomSearch", "d21_AsyncEA", "d34_RandomSearch"]
TOP_N = 5
TOTAL_N_CONFIGS = 25
MIN_EVALS = 10
NAMED_PIPELINE_IDS = [10, 11, 12]


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn
    return deco


def _evals(spark, sf):
    return fixture(spark, sf, "evaluations")


def dataset_lookup(evals: DataFrame) -> DataFrame:
    """Dataset lookup derived from the evaluations: name ``d<id>``."""
    return (evals.select("dataset_id").distinct()
            .select(F.concat(F.lit("d"), F.col("dataset_id").cast("string")).alias("dataset"), "dataset_id"))


# --- step 1: average regret -------------------------------------------------

@register("avg_regret")
def q_avg_regret(spark, sf):
    return recommend.average_regret_offline(_evals(spark, sf), fixture(spark, sf, "pipelines"), METRIC)


@register("avg_regret_topk")
def q_avg_regret_topk(spark, sf):
    off = recommend.average_regret_offline(_evals(spark, sf), fixture(spark, sf, "pipelines"), METRIC)
    return recommend.average_regret_online(off, TOTAL_N_CONFIGS, MIN_EVALS)


# --- step 2: selections, top-n, aggregation -----------------------------------

@register("get_df_filters")
def q_get_df_filters(spark, sf):
    return store.get_df(_evals(spark, sf), datasets=SELECTED_DATASETS, metrics=[METRIC],
                        logs_names=SELECTED_RUNS)


@register("get_df_by_names")
def q_get_df_by_names(spark, sf):
    ev = _evals(spark, sf)
    pipes = fixture(spark, sf, "pipelines")
    names = [f"d{i}" for i in SELECTED_DATASETS]
    # The requested pipeline names are those of a few lookup ids (three strings).
    pipe_names = [r[0] for r in pipes.filter(F.col("pipeline_id").isin(NAMED_PIPELINE_IDS))
                  .select("pipeline").distinct().collect()]
    return store.get_df_by_names(ev, dataset_lookup(ev), names, pipes, pipe_names)


@register("avg_equivalent")
def q_avg_equivalent(spark, sf):
    out = store.average_equivalent(_evals(spark, sf))
    return out.withColumn("score", rnd("score")).withColumn("n_records", F.col("n_records").cast("long"))


@register("topn_per_dataset")
def q_topn_per_dataset(spark, sf):
    top = store.top_n_per_dataset(_evals(spark, sf), TOP_N, METRIC)
    return top.select("dataset_id", "position", "pipeline_id", "eval_id", "score").withColumn(
        "position", F.col("position").cast("long"))


@register("topn_global")
def q_topn_global(spark, sf):
    return store.top_n_global(_evals(spark, sf), TOTAL_N_CONFIGS, METRIC).select("eval_id", "dataset_id", "pipeline_id", "score")


@register("relevance_labels")
def q_relevance_labels(spark, sf):
    out = store.relevance_labels(_evals(spark, sf), TOP_N, METRIC)
    return out.select("qid", "dataset_id", "pipeline_id", "score",
                      F.col("relevance").cast("long").alias("relevance"))


@register("candidate_set")
def q_candidate_set(spark, sf):
    return store.candidate_set(_evals(spark, sf), TOP_N, METRIC)


@register("dataset_minmax")
def q_dataset_minmax(spark, sf):
    return store.dataset_bounds(_evals(spark, sf).filter(F.col("metric") == METRIC))


@register("value_counts")
def q_value_counts(spark, sf):
    return _evals(spark, sf).groupBy("logs_name").agg(F.count(F.lit(1)).alias("n"))


@register("regret_rows")
def q_regret_rows(spark, sf):
    r = recommend.with_regret(_evals(spark, sf), METRIC)
    return r.select("eval_id", "dataset_id", "pipeline_id", rnd("regret").alias("regret"))


# --- step 3: analysis of results ----------------------------------------------

# The learner names of the results stand-in (events.event_type).
LEARNERS = ["click", "error", "purchase", "signup", "view"]
BEST_OF = 5
N_SLOTS = 25
RECODE = {1: 2, 2: 1}


def _processed(spark, sf):
    from metalens.operators.analysis import processed_scores
    return processed_scores(fixture(spark, sf, "results"), BEST_OF)


@register("best_of_first5")
def q_best_of_first5(spark, sf):
    from metalens.operators.analysis import best_of_first
    return best_of_first(fixture(spark, sf, "results"), BEST_OF)


@register("grid_fill_missing")
def q_grid_fill_missing(spark, sf):
    return _processed(spark, sf).withColumn("score", rnd("score"))


@register("regret_mean_std")
def q_regret_mean_std(spark, sf):
    from metalens.operators.analysis import regret_summary
    out = regret_summary(fixture(spark, sf, "results"), N_SLOTS)
    return out.select("metalearner_name", rnd("regret_mean").alias("regret_mean"),
                      rnd("regret_std").alias("regret_std"))


@register("avg_ranks")
def q_avg_ranks(spark, sf):
    from metalens.operators.analysis import average_ranks
    out = average_ranks(_processed(spark, sf))
    return out.select("metalearner_name", rnd("avg_rank").alias("avg_rank"),
                      F.col("n_datasets").cast("long").alias("n_datasets"))


@register("friedman")
def q_friedman(spark, sf):
    from metalens.operators.analysis import friedman_statistic
    out = friedman_statistic(_processed(spark, sf))
    return out.withColumn("statistic", rnd("statistic"))


@register("friedman_pvalue")
def q_friedman_pvalue(spark, sf):
    from metalens.operators.analysis import friedman_test
    out = friedman_test(_processed(spark, sf))
    return out.withColumn("statistic", rnd("statistic", 8)).withColumn("p_value", rnd("p_value", 8))


@register("pivot_scores")
def q_pivot_scores(spark, sf):
    from metalens.operators.analysis import pivot_learners
    return pivot_learners(_processed(spark, sf), LEARNERS)


@register("learner_positions")
def q_learner_positions(spark, sf):
    from metalens.operators.analysis import learner_positions
    out = learner_positions(_processed(spark, sf))
    return out.select("metalearner_name", "dataset_id", F.col("position").cast("long").alias("position"))


@register("running_best")
def q_running_best(spark, sf):
    from metalens.operators.sequence import running_max
    log = fixture(spark, sf, "run_log").select("run_id", "eval_no", "score")
    return running_max(log, "run_id", "eval_no", "score", "best_so_far", block_size=256)


@register("gap_seconds")
def q_gap_seconds(spark, sf):
    from metalens.operators.sequence import gap_seconds
    log = fixture(spark, sf, "run_log").select("run_id", "eval_no", "ts")
    return gap_seconds(log, "run_id", "eval_no", "ts", block_size=256).select("run_id", "eval_no", "gap_seconds")


@register("timing_fit")
def q_timing_fit(spark, sf):
    from metalens.operators.analysis import linear_fit
    from metalens.operators.sequence import seconds_between
    log = fixture(spark, sf, "run_log")
    runs = log.groupBy("run_id").agg(seconds_between(F.min("ts"), F.max("ts")).alias("duration"),
                                     F.count(F.lit(1)).cast("double").alias("n_evals"))
    fit = linear_fit(runs, "duration", "n_evals")
    # Durations are ~1e6 s: keep 6 decimals (about 13 significant digits).
    return fit.select(rnd("slope", 6).alias("slope"), rnd("intercept", 6).alias("intercept"),
                      rnd("r2", 10).alias("r2"), F.col("n").cast("long").alias("n"))


@register("run_methods")
def q_run_methods(spark, sf):
    from metalens.operators.analysis import search_method
    return (_evals(spark, sf).select(search_method("logs_name").alias("method"))
            .groupBy("method").agg(F.count(F.lit(1)).alias("n")))


@register("clip_recode")
def q_clip_recode(spark, sf):
    from metalens.operators.analysis import clip_scores, recode
    res = fixture(spark, sf, "results")
    return res.select("metalearner_name", recode("dataset_id", RECODE).alias("dataset_id"),
                      F.col("slot").cast("long").alias("slot"), clip_scores("score").alias("score"))


@register("log_loss")
def q_log_loss(spark, sf):
    from metalens.operators.analysis import log_loss
    out = log_loss(fixture(spark, sf, "probs"))
    return out.select(rnd("log_loss").alias("log_loss"), "n_rows")


# --- step 4: similarity and similarity-based recommenders ------------------------

QUERY_DATASET = 0
N_SIMILAR = 5


def _similarities(spark, sf):
    """One-vs-all similarity of the query dataset to the other known datasets."""
    from metalens.operators.similarity import one_vs_all
    ev = _evals(spark, sf)
    vec = fixture(spark, sf, "vectors")
    stored = recommend.known_vectors(vec.filter(F.col("dataset_id") != QUERY_DATASET), ev)
    query = vec.filter(F.col("dataset_id") == QUERY_DATASET)
    return one_vs_all(stored, query)


def _mdbase_evals(spark, sf):
    """Evaluations of the datasets other than the query dataset."""
    return _evals(spark, sf).filter(F.col("dataset_id") != QUERY_DATASET)


@register("similarity_all")
def q_similarity_all(spark, sf):
    s = _similarities(spark, sf)
    return s.select("dataset_id", rnd("cosine").alias("cosine"), rnd("euclidean").alias("euclidean"),
                    rnd("kernel").alias("kernel"))


@register("cosine_topk")
def q_cosine_topk(spark, sf):
    from metalens.operators.similarity import most_similar
    s = _similarities(spark, sf).withColumn("cosine", rnd("cosine"))
    return most_similar(s, N_SIMILAR, "cosine").select("rank", "dataset_id", "cosine")


@register("euclid_topk")
def q_euclid_topk(spark, sf):
    from metalens.operators.similarity import most_similar
    s = _similarities(spark, sf).withColumn("euclidean", rnd("euclidean"))
    return most_similar(s, N_SIMILAR, "euclidean").select("rank", "dataset_id", "euclidean")


@register("vector_pairs")
def q_vector_pairs(spark, sf):
    from metalens.functions import vectors as V
    from metalens.sources.tables import table
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    pairs = emb.join(nxt, "vec_id")
    return pairs.select("vec_id", rnd(V.cosine_similarity("embedding", "other")).alias("cosine"),
                        rnd(V.euclidean_distance("embedding", "other")).alias("euclidean"),
                        rnd(V.kernel_similarity("embedding", "other")).alias("kernel"),
                        V.same_length("embedding", "other").alias("same_length"))


@register("utility_scores")
def q_utility_scores(spark, sf):
    return recommend.utility_scores(_mdbase_evals(spark, sf), fixture(spark, sf, "pipelines"),
                                    _similarities(spark, sf), METRIC)


@register("utility_topk")
def q_utility_topk(spark, sf):
    scores = recommend.utility_scores(_mdbase_evals(spark, sf), fixture(spark, sf, "pipelines"),
                                      _similarities(spark, sf), METRIC)
    return recommend.utility_online(scores, TOTAL_N_CONFIGS)


@register("top_similarity_slice")
def q_top_similarity_slice(spark, sf):
    from metalens.operators.similarity import most_similar
    s = _similarities(spark, sf).withColumn("cosine", rnd("cosine"))
    nearest = most_similar(s, N_SIMILAR, "cosine")
    return recommend.top_similarity(_mdbase_evals(spark, sf), nearest, TOTAL_N_CONFIGS, METRIC)


# --- step 5: results matrix and greedy portfolio -------------------------------

PORTFOLIO_K = 3
MATRIX_N = 5


@register("results_matrix_regret")
def q_results_matrix_regret(spark, sf):
    m = recommend.results_matrix(_evals(spark, sf), MATRIX_N, METRIC)
    return m.select("dataset_id", "pipeline_id", rnd("regret").alias("regret"))


@register("portfolio_k3")
def q_portfolio_k3(spark, sf):
    from metalens.operators.portfolio import greedy_portfolio
    m = recommend.results_matrix(_evals(spark, sf), MATRIX_N, METRIC).withColumn("regret", rnd("regret"))
    return greedy_portfolio(m, PORTFOLIO_K)


# --- step 6: leave-one-dataset-out ----------------------------------------------

HELD_OUT = [0, 1, 2]


@register("lodo_avg_regret")
def q_lodo_avg_regret(spark, sf):
    from metalens.plans.lodo import lodo_average_regret
    return lodo_average_regret(_evals(spark, sf), fixture(spark, sf, "pipelines"), TOTAL_N_CONFIGS, MIN_EVALS, METRIC)


@register("lodo_summary")
def q_lodo_summary(spark, sf):
    from metalens.plans.lodo import lodo_average_regret, lodo_summary
    ev = _evals(spark, sf)
    recs = lodo_average_regret(ev, fixture(spark, sf, "pipelines"), TOTAL_N_CONFIGS, MIN_EVALS, METRIC)
    out = lodo_summary(recs, ev, METRIC)
    return out.select("held_out_id", "best_score", "n_scored", rnd("regret").alias("regret"))


@register("kept_pipelines")
def q_kept_pipelines(spark, sf):
    from metalens.operators.views import all_but, partial_view
    ev = _evals(spark, sf)
    ds = dataset_lookup(ev)
    keep = all_but(ds.select("dataset_id"), spark.createDataFrame([(i,) for i in HELD_OUT], "dataset_id long"))
    view = partial_view(ev, ds, fixture(spark, sf, "pipelines"), keep)
    return view.pipelines


@register("holdout_split")
def q_holdout_split(spark, sf):
    from metalens.operators.views import holdout_split
    s = holdout_split(fixture(spark, sf, "samples"), "row_id", 0.8, seed=7)
    return s.groupBy("dataset_id").agg(F.sum(F.col("is_train").cast("long")).alias("n_train"),
                                       F.sum((~F.col("is_train")).cast("long")).alias("n_test"))


# --- step 7: dataset meta-features ----------------------------------------------

NUMERIC_ATTRS = ["num_total", "num_bal"]
CATEGORICAL_ATTRS = ["cat_prio", "cat_seg"]


def _cells_labels(spark, sf):
    from metalens.operators.metafeatures import labels_of, to_cells
    s = fixture(spark, sf, "samples")
    return to_cells(s, NUMERIC_ATTRS, CATEGORICAL_ATTRS), labels_of(s, "y")


def _rounded(df):
    return df.withColumn("value", rnd("value", 8))


@register("mf_simple")
def q_mf_simple(spark, sf):
    from metalens.operators.metafeatures import simple_features
    return _rounded(simple_features(*_cells_labels(spark, sf)))


@register("mf_class")
def q_mf_class(spark, sf):
    from metalens.operators.metafeatures import class_features
    return _rounded(class_features(_cells_labels(spark, sf)[1]))


@register("mf_moments")
def q_mf_moments(spark, sf):
    from metalens.operators.metafeatures import moment_features
    return _rounded(moment_features(_cells_labels(spark, sf)[0]))


@register("mf_missing")
def q_mf_missing(spark, sf):
    from metalens.operators.metafeatures import missing_features
    return _rounded(missing_features(_cells_labels(spark, sf)[0]))


@register("mf_categorical")
def q_mf_categorical(spark, sf):
    from metalens.operators.metafeatures import categorical_features
    return _rounded(categorical_features(_cells_labels(spark, sf)[0]))


@register("feasible_features")
def q_feasible_features(spark, sf):
    """Feature names finite on every dataset, before zeroing of the moment features."""
    from metalens.operators.metafeatures import attribute_stats, feasible_features
    cells, _ = _cells_labels(spark, sf)
    a = attribute_stats(cells).filter(~F.col("is_cat"))
    raw = a.select("dataset_id", F.explode(F.array(
        F.struct(F.concat(F.lit("kurtosis."), F.col("attr")).alias("name"), F.col("kurtosis").alias("value")),
        F.struct(F.concat(F.lit("skewness."), F.col("attr")).alias("name"), F.col("skewness").alias("value"))))
        .alias("f")).select("dataset_id", "f.*")
    return feasible_features(raw)


# --- step 8: pipeline parsing and characterizations ------------------------------

# The algorithm vocabulary (search space) of the stand-in pipelines.
VOCABULARY = ["Bayes", "Forest", "Pca", "Scaler", "Tree"]
# Skip rules applied to the stand-in pipelines (algorithm, predicate on dataset size).
SKIP_RULES = [("Forest", "n_rows * n_cols > 2400"), ("Pca", "n_cols > 3")]
SEARCH_SPACE = [("Tree", "depth"), ("Forest", "n"), ("Pca", "k")]


def _steps(spark, sf):
    from metalens.operators.configs import parse_steps
    return parse_steps(fixture(spark, sf, "pipelines"))


def _params(spark, sf):
    from metalens.operators.configs import parse_params
    return parse_params(fixture(spark, sf, "pipelines"))


@register("config_steps")
def q_config_steps(spark, sf):
    return _steps(spark, sf).select("pipeline_id", "pos", "algorithm")


@register("config_params")
def q_config_params(spark, sf):
    return _params(spark, sf).select("pipeline_id", "algorithm", "param", "value")


@register("params_in_space")
def q_params_in_space(spark, sf):
    from metalens.operators.configs import params_in_space
    space = spark.createDataFrame(SEARCH_SPACE, "algorithm string, param string")
    return params_in_space(_params(spark, sf), space).select("pipeline_id", "algorithm", "param", "value")


@register("algo_bits")
def q_algo_bits(spark, sf):
    from metalens.operators.configs import algorithm_bits
    return algorithm_bits(_steps(spark, sf), VOCABULARY)


@register("algo_successors")
def q_algo_successors(spark, sf):
    from metalens.operators.configs import algorithm_bits
    n = len(VOCABULARY)
    return algorithm_bits(_steps(spark, sf), VOCABULARY).filter(F.col("idx") >= n)


@register("rankml_hashes")
def q_rankml_hashes(spark, sf):
    from metalens.operators.configs import step_hashes
    return step_hashes(_steps(spark, sf), _params(spark, sf))


@register("longest_pipeline")
def q_longest_pipeline(spark, sf):
    from metalens.operators.configs import longest_pipeline
    return longest_pipeline(_steps(spark, sf)).select(F.col("longest").cast("long").alias("longest"))


def all_pipeline_names(spark, sf):
    """Pipeline strings of the lookup and, from every part, one that it lacks."""
    from metalens.sources.tables import bind_sql
    new = spark.sql(bind_sql("SELECT concat('Tree(Scaler(data), Tree.depth=', CAST(p_partkey AS varchar(20)), ')') AS pipeline FROM part", sf))
    return fixture(spark, sf, "pipelines").select("pipeline").unionAll(new)


@register("assign_ids")
def q_assign_ids(spark, sf):
    return store.assign_new_ids(fixture(spark, sf, "pipelines"), all_pipeline_names(spark, sf),
                                "pipeline", "pipeline_id")


@register("pipeline_buckets")
def q_pipeline_buckets(spark, sf):
    from metalens.functions.configs import bucket_of
    return fixture(spark, sf, "pipelines").select("pipeline_id", bucket_of("pipeline_id").alias("bucket"))


@register("skip_rules")
def q_skip_rules(spark, sf):
    from metalens.operators.configs import apply_skip_rules
    recs = store.top_n_per_dataset(_evals(spark, sf), TOP_N, METRIC).select("dataset_id", "pipeline_id", "position")
    s = fixture(spark, sf, "samples")
    sizes = s.groupBy(F.col("dataset_id").cast("long").alias("dataset_id")).agg(
        F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(NUMERIC_ATTRS) + len(CATEGORICAL_ATTRS)))
    out = apply_skip_rules(recs, _steps(spark, sf), sizes, SKIP_RULES)
    return out.withColumn("position", F.col("position").cast("long"))


# --- step 9: sub-table sampling and pooling --------------------------------------

N_BATCHES = 3
SAMPLE_SEED = 11


@register("subtable_sample")
def q_subtable_sample(spark, sf):
    from metalens.operators.subtables import sample_rows
    _, labels = _cells_labels(spark, sf)
    return sample_rows(labels, N_BATCHES, SAMPLE_SEED)


@register("flatten_pairs")
def q_flatten_pairs(spark, sf):
    from metalens.operators.subtables import flatten_pairs
    cells, labels = _cells_labels(spark, sf)
    p = flatten_pairs(cells, labels, N_BATCHES, SAMPLE_SEED)
    return p.groupBy("dataset_id", "batch").agg(F.count(F.lit(1)).alias("n_pairs"),
                                                rnd(F.sum("x"), 8).alias("sum_x"), F.sum("y").alias("sum_y"))


@register("pool_means")
def q_pool_means(spark, sf):
    from metalens.operators.subtables import flatten_pairs, pooled_vectors
    cells, labels = _cells_labels(spark, sf)
    out = pooled_vectors(flatten_pairs(cells, labels, N_BATCHES, SAMPLE_SEED))
    return out.withColumn("value", rnd("value", 10))


@register("minmax_scaled")
def q_minmax_scaled(spark, sf):
    from metalens.operators.subtables import numeric_stats, scaled_values
    cells, _ = _cells_labels(spark, sf)
    s = scaled_values(cells, numeric_stats(cells))
    return s.groupBy("dataset_id", "attr").agg(rnd(F.avg("num_val"), 8).alias("mean_scaled"),
                                               F.count(F.lit(1)).alias("n"))


# --- characterization stores ---------------------------------------------------------

REQUESTED_IDS = [5, 3, 5, 0, 39, 12]


def _embedding_chars(spark, sf):
    v = fixture(spark, sf, "vectors")
    return v.select(F.lit("embedding").alias("method"), "dataset_id",
                    F.col("embedding").cast("array<double>").alias("values"),
                    F.transform("embedding", lambda x, i: F.concat(F.lit("dim"), i.cast("string"))).alias("names"))


def _simple_chars(spark, sf):
    from metalens.operators.metafeatures import simple_features
    long = simple_features(*_cells_labels(spark, sf))
    packed = long.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("kv"))
    return packed.select(F.lit("simple").alias("method"), "dataset_id",
                         F.col("kv.value").alias("values"), F.col("kv.name").alias("names"))


@register("list_characterizations")
def q_list_characterizations(spark, sf):
    from metalens.sources.metastore import list_characterizations
    chars = _embedding_chars(spark, sf).unionByName(_simple_chars(spark, sf))
    return list_characterizations(chars).select("method", F.col("n").cast("long").alias("n"))


@register("char_lookup_ordered")
def q_char_lookup_ordered(spark, sf):
    from metalens.sources.metastore import ordered_lookup
    out = ordered_lookup(_embedding_chars(spark, sf), REQUESTED_IDS)
    return out.select("req_pos", "dataset_id", F.size("values").cast("long").alias("n_dims"),
                      rnd(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 8).alias("value_sum"))


# --- step 10: learned ranking ----------------------------------------------------------

RANK_N_MODELS = 10


def _pipe_vecs(spark, sf, steps=None):
    from metalens.operators.configs import algorithm_vectors
    return algorithm_vectors(_steps(spark, sf) if steps is None else steps, VOCABULARY).withColumnRenamed("vector", "values")


def _dataset_vecs(spark, sf):
    return fixture(spark, sf, "vectors").select("dataset_id", F.col("embedding").alias("values"))


@register("ltr_frame")
def q_ltr_frame(spark, sf):
    from metalens.plans.rankml import training_frame
    f = training_frame(_mdbase_evals(spark, sf), _dataset_vecs(spark, sf), _pipe_vecs(spark, sf), RANK_N_MODELS, METRIC)
    return f.select("qid", "dataset_id", "pipeline_id", "relevance", F.size("features").cast("long").alias("n_features"),
                    rnd(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("feature_sum"))


@register("dense_rank_ties")
def q_dense_rank_ties(spark, sf):
    """Ranked top-k on a coarse score (one decimal of the average-regret score),
    so that many pipelines share a rank and the gap tie-break decides."""
    from metalens.plans.rankml import ranked_top_k
    ev = _evals(spark, sf)
    off = recommend.average_regret_offline(ev, fixture(spark, sf, "pipelines"), METRIC)
    scored = off.select("pipeline_id", F.round("ranking_score", 1).alias("predicted"))
    out = ranked_top_k(scored, ev, TOTAL_N_CONFIGS, "predicted", METRIC)
    return out.withColumn("gap", rnd("gap"))


@register("rankml_topk")
def q_rankml_topk(spark, sf):
    from metalens.plans.rankml import candidate_frame, fit_ranker, ranked_top_k, score_candidates, training_frame
    ev = _mdbase_evals(spark, sf)
    pv = materialize(_pipe_vecs(spark, sf, materialize(_steps(spark, sf))))
    model = fit_ranker(training_frame(ev, _dataset_vecs(spark, sf), pv, RANK_N_MODELS, METRIC))
    q = fixture(spark, sf, "vectors").filter(F.col("dataset_id") == QUERY_DATASET).select("embedding").first()
    cands = candidate_frame(ev, pv, list(q[0]) if q else [], None, METRIC)
    return ranked_top_k(score_candidates(model, cands), ev, TOTAL_N_CONFIGS, "predicted", METRIC)


# --- similarity of many datasets, leave-one-out of the learners that use it ---------------------

N_NEAREST = 5


def _held_out(dataset_id):
    return dataset_id % 20 == 0


@register("similarity_many")
def q_similarity_many(spark, sf):
    """The most similar datasets of every dataset whose id is divisible by 20, among all."""
    from metalens.operators.similarity import many_vs_all
    out = many_vs_all(fixture(spark, sf, "vectors"), _held_out, N_NEAREST)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "dataset_id", rnd("value", 8).alias("value"))


@register("lodo_top_similarity")
def q_lodo_top_similarity(spark, sf):
    from metalens.operators.similarity import many_vs_all
    from metalens.plans.lodo import lodo_top_similarity
    ev = _evals(spark, sf)
    near = many_vs_all(recommend.known_vectors(fixture(spark, sf, "vectors"), ev), _held_out, N_NEAREST)
    return lodo_top_similarity(ev, near, TOTAL_N_CONFIGS, METRIC).withColumn("heldout_score", rnd("heldout_score"))


@register("lodo_utility")
def q_lodo_utility(spark, sf):
    from metalens.plans.lodo import lodo_utility_of_vectors
    ev = _evals(spark, sf)
    out = lodo_utility_of_vectors(ev, recommend.known_vectors(fixture(spark, sf, "vectors"), ev), _held_out, TOTAL_N_CONFIGS, METRIC)
    return out.withColumn("heldout_score", rnd("heldout_score"))


@register("lodo_portfolio")
def q_lodo_portfolio(spark, sf):
    """Greedy portfolios with each dataset whose id is divisible by 20 held out in turn."""
    from metalens.operators.portfolio import lodo_portfolios
    m = recommend.results_matrix(_evals(spark, sf), MATRIX_N, METRIC).withColumn("regret", rnd("regret"))
    held = m.filter(_held_out(F.col("dataset_id"))).select(F.col("dataset_id").alias("held_out_id"))
    return lodo_portfolios(m, held, PORTFOLIO_K).withColumn("gain", rnd("gain"))


HASH_POSITIONS = [0, 1]


@register("rankml_pairwise")
def q_rankml_pairwise(spark, sf):
    """Ranking by boosted trees on within-dataset pairs, with the hashes of the last two steps as categories."""
    from metalens.operators.configs import step_hashes
    from metalens.plans.pairwise import fit_pairwise, hash_columns
    from metalens.plans.rankml import candidate_frame, ranked_top_k, training_frame
    ev = _mdbase_evals(spark, sf)
    steps = materialize(_steps(spark, sf))
    pv = materialize(_pipe_vecs(spark, sf, steps))
    hashes = materialize(hash_columns(step_hashes(steps, _params(spark, sf)), HASH_POSITIONS))
    names = hashes.columns[1:]
    ranker = fit_pairwise(training_frame(ev, _dataset_vecs(spark, sf), pv, RANK_N_MODELS, METRIC).join(hashes, "pipeline_id"), names)
    q = fixture(spark, sf, "vectors").filter(F.col("dataset_id") == QUERY_DATASET).select("embedding").first()
    cands = candidate_frame(ev, pv, list(q[0]) if q else [], None, METRIC).join(hashes, "pipeline_id")
    return ranked_top_k(ranker.score(cands), ev, TOTAL_N_CONFIGS, "predicted", METRIC)


# --- learner API over a leave-out view ----------------------------------------------------

def _view(spark, sf):
    from metalens.operators.views import all_but, partial_view
    ev = _evals(spark, sf).drop("logs_name")  # no learner reads it
    ds = dataset_lookup(ev)
    keep = all_but(ds.select("dataset_id"), spark.createDataFrame([(QUERY_DATASET,)], "dataset_id long"))
    return partial_view(ev, ds, fixture(spark, sf, "pipelines"), keep,
                        dataset_chars=fixture(spark, sf, "vectors"), stored=True)


@register("learner_utility")
def q_learner_utility(spark, sf):
    from metalens.plans.learners import UtilityEstimateLearner, call_with_supported
    lrn = UtilityEstimateLearner(metric=METRIC).fit(_view(spark, sf))
    q = fixture(spark, sf, "vectors").filter(F.col("dataset_id") == QUERY_DATASET)
    return call_with_supported(lrn.recommend, query_vector=q, total_n_configs=TOTAL_N_CONFIGS, min_evals=MIN_EVALS)


@register("learner_portfolio")
def q_learner_portfolio(spark, sf):
    from metalens.plans.learners import PortfolioLearner
    lrn = PortfolioLearner(metric=METRIC, portfolio_size=PORTFOLIO_K, n_pipes=MATRIX_N).fit(_view(spark, sf))
    return lrn.recommend(total_n_configs=PORTFOLIO_K).withColumn("score", rnd("score"))


# --- sizes, subsets, warm-start lists --------------------------------------------------------

LEARNER_SUBSET_DATASETS = [0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24, 26, 28, 30, 32, 34, 36]


@register("dataset_sizes")
def q_dataset_sizes(spark, sf):
    """Per dataset: instances, features, classes, cells = rows * (features + classes)
    joined with the number of evaluations, ordered by size."""
    cells, labels = _cells_labels(spark, sf)
    inst = labels.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("y").alias("n_classes"))
    feats = cells.groupBy("dataset_id").agg(F.count_distinct("attr").alias("n_features"))
    evals = _evals(spark, sf).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_evals"))
    sizes = (inst.join(feats, "dataset_id").join(evals, "dataset_id", "left")
             .select("dataset_id", F.col("n_rows").cast("long"), F.col("n_features").cast("long"),
                     F.col("n_classes").cast("long"),
                     (F.col("n_rows") * (F.col("n_features") + F.col("n_classes"))).cast("long").alias("n_cells"),
                     F.coalesce("n_evals", F.lit(0)).cast("long").alias("n_evals")))
    return sizes.orderBy(F.col("n_rows").desc(), F.col("n_features").desc(), F.col("dataset_id"))


@register("learner_subset")
def q_learner_subset(spark, sf):
    """Results of learners whose name lacks a substring, on a listed dataset subset."""
    res = fixture(spark, sf, "results")
    out = res.filter(~F.col("metalearner_name").contains("ew") & F.col("dataset_id").isin(LEARNER_SUBSET_DATASETS))
    return out.withColumn("slot", F.col("slot").cast("long"))


@register("warm_start_list")
def q_warm_start_list(spark, sf):
    """Kept recommendations after the skip rules, first 5 per dataset."""
    from metalens.operators.configs import apply_skip_rules
    recs = store.top_n_per_dataset(_evals(spark, sf), 2 * TOP_N, METRIC).select("dataset_id", "pipeline_id", "position")
    s = fixture(spark, sf, "samples")
    sizes = s.groupBy(F.col("dataset_id").cast("long").alias("dataset_id")).agg(
        F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(NUMERIC_ATTRS) + len(CATEGORICAL_ATTRS)))
    kept = apply_skip_rules(recs, _steps(spark, sf), sizes, SKIP_RULES)
    w = Window.partitionBy("dataset_id").orderBy("position")
    return (kept.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= TOP_N)
            .select("dataset_id", F.col("slot").cast("long").alias("slot"), "pipeline_id"))


# --- landmarkers ------------------------------------------------------------------------------

N_FOLDS = 10
FOLD_SEED = 3


@register("stratified_folds")
def q_stratified_folds(spark, sf):
    from metalens.operators.landmarkers import stratified_folds
    _, labels = _cells_labels(spark, sf)
    f = stratified_folds(labels, 3, FOLD_SEED)
    return f.groupBy("dataset_id", "fold", "y").agg(F.count(F.lit(1)).alias("n"))


@register("naive_bayes_landmarker")
def q_naive_bayes_landmarker(spark, sf):
    from metalens.operators.landmarkers import hash_folds, naive_bayes_accuracy
    cells, labels = _cells_labels(spark, sf)
    out = naive_bayes_accuracy(cells, hash_folds(labels, N_FOLDS, FOLD_SEED))
    return out.select("dataset_id", rnd("value").alias("value"))


ENCODE_FOLDS = 5


def _encoded(spark, sf, one_hot_max):
    from metalens.operators.encoding import Encoding
    from metalens.operators.landmarkers import hash_folds
    cells, labels = _cells_labels(spark, sf)
    rows = Encoding(cells, hash_folds(labels, ENCODE_FOLDS, FOLD_SEED), one_hot_max=one_hot_max).encoded()
    return rows.select("dataset_id", "held", "row_id", "size", F.explode("entries").alias("e")).select(
        "dataset_id", "held", "row_id", F.col("size").cast("long").alias("size"), F.col("e.pos").cast("long").alias("pos"), rnd("e.value", 6).alias("value"))


@register("encoded_frame")
def q_encoded_frame(spark, sf):
    """Every row of every dataset encoded by the other folds' rows: means and 0/1 columns."""
    return _encoded(spark, sf, 10)


@register("encoded_target")
def q_encoded_target(spark, sf):
    """The same with class shares for attributes of more than 3 categories."""
    return _encoded(spark, sf, 3)


# --- fitting recommended pipelines (pyspark.ml) ---------------------------------------------

SCORED_RECOMMENDATIONS = 3


def _scored(spark, sf, folds):
    from metalens.operators.modeling import encoded_splits, score_recommendations
    frame = encoded_splits(*_cells_labels(spark, sf), QUERY_DATASET, folds)
    rest = _mdbase_evals(spark, sf)
    off = recommend.average_regret_offline(rest, fixture(spark, sf, "pipelines"), METRIC)
    recs = [r["pipeline_id"] for r in recommend.average_regret_online(off, SCORED_RECOMMENDATIONS, MIN_EVALS)
            .orderBy("rank").collect()]
    return score_recommendations(spark, recs, frame, _steps(spark, sf), _params(spark, sf))


@register("fit_score_recommended")
def q_fit_score_recommended(spark, sf):
    """Hold-out (80/20) negative log loss of the top average-regret recommendations on the new dataset."""
    return _scored(spark, sf, None)


@register("kfold_score_recommended")
def q_kfold_score_recommended(spark, sf):
    """Same recommendations scored by 3-fold mean negative log loss."""
    return _scored(spark, sf, 3)


@register("node_landmarkers")
def q_node_landmarkers(spark, sf):
    from metalens.operators.landmarkers import decision_stumps, hash_folds
    cells, labels = _cells_labels(spark, sf)
    out = decision_stumps(cells, hash_folds(labels, N_FOLDS, FOLD_SEED), 32, seed=FOLD_SEED)
    return out.withColumn("value", rnd("value"))


@register("pca_landmarkers")
def q_pca_landmarkers(spark, sf):
    """First-component statistics per dataset (one PCA fit per dataset, one projection job)."""
    from metalens.operators.landmarkers import pca_features
    cells, _ = _cells_labels(spark, sf)
    out = pca_features(cells)
    return out.withColumn("value", rnd("value", 6))


@register("lda_landmarker")
def q_lda_landmarker(spark, sf):
    from metalens.operators.landmarkers import hash_folds, linear_discriminant_accuracy
    cells, labels = _cells_labels(spark, sf)
    out = linear_discriminant_accuracy(cells, hash_folds(labels, N_FOLDS, FOLD_SEED))
    return out.select("dataset_id", rnd("value", 6).alias("value"))


@register("mf_full")
def q_mf_full(spark, sf):
    """The full set (simple, class, moments, missing, categorical) in long form."""
    from metalens.operators.metafeatures import feature_set
    return _rounded(feature_set(*_cells_labels(spark, sf), which="full"))


@register("mf_basic")
def q_mf_basic(spark, sf):
    from metalens.operators.metafeatures import feature_set
    return _rounded(feature_set(*_cells_labels(spark, sf), which="basic"))


TREE_FOLDS = 5
TREE_DEPTH = 8


@register("tree_landmarker")
def q_tree_landmarker(spark, sf):
    """Decision-tree macro F1 (5 folds), all datasets grown level by level at once."""
    from metalens.operators.landmarkers import decision_tree_f1, hash_folds
    cells, labels = _cells_labels(spark, sf)
    out = decision_tree_f1(cells, hash_folds(labels, TREE_FOLDS, FOLD_SEED), TREE_DEPTH)
    return out.select("dataset_id", rnd("value").alias("value"))


@register("learner_report")
def q_learner_report(spark, sf):
    """Per learner: regret mean and std over 25 slots, average rank and number of first places."""
    from metalens.operators.analysis import average_ranks, learner_positions, regret_summary
    res = fixture(spark, sf, "results")
    processed = _processed(spark, sf)
    wins = (learner_positions(processed).groupBy("metalearner_name")
            .agg(F.sum((F.col("position") == 1).cast("long")).alias("n_first")))
    return (regret_summary(res, N_SLOTS).join(average_ranks(processed), "metalearner_name")
            .join(wins, "metalearner_name")
            .select("metalearner_name", rnd("regret_mean").alias("regret_mean"), rnd("regret_std").alias("regret_std"),
                    rnd("avg_rank").alias("avg_rank"), "n_first"))


@register("cd_groups")
def q_cd_groups(spark, sf):
    """Learner groups within the Nemenyi critical difference of average ranks."""
    from metalens.operators.analysis import average_ranks, cd_groups
    processed = _processed(spark, sf)
    ranks = average_ranks(processed).select("metalearner_name", rnd("avg_rank").alias("avg_rank"))
    n = processed.select(F.count_distinct("dataset_id")).first()[0]  # one bounded scalar
    return cd_groups(ranks, int(n)).withColumn("cd", rnd("cd", 2))


CONTROL = "view"


@register("signed_rank")
def q_signed_rank(spark, sf):
    """Every learner against a control over all datasets, at 0.05 after Bonferroni (normal tails)."""
    from metalens.operators.analysis import signed_rank_tests
    out = signed_rank_tests(_processed(spark, sf), CONTROL, exact_up_to=0)
    return out.select("metalearner_name", "n", rnd("w_plus", 1).alias("w_plus"), rnd("w_minus", 1).alias("w_minus"), rnd("z", 8).alias("z"), "differs")
