"""DuckDB oracle SQL, one statement per registered query (same column names)."""

from __future__ import annotations

from metalens.plans.queries import METRIC, MIN_EVALS, SELECTED_DATASETS, SELECTED_RUNS, TOP_N, TOTAL_N_CONFIGS
from metalens.sources.tables import FIXTURE_SQL, with_fixtures

ORACLE: dict[str, str] = {}

_DS = ", ".join(str(i) for i in SELECTED_DATASETS)
_RUNS = ", ".join(f"'{r}'" for r in SELECTED_RUNS)

_REGRET = f"""
e AS (SELECT * FROM evaluations WHERE metric = '{METRIC}'),
b AS (SELECT dataset_id, min(score) AS min_score, max(score) AS max_score FROM e GROUP BY dataset_id),
r AS (SELECT e.*, CASE WHEN max_score = min_score THEN 0.0
                       ELSE abs(max_score - score) / abs(min_score - max_score) END AS regret
      FROM e JOIN b USING (dataset_id))"""

_AVG_REGRET = with_fixtures("evaluations", "pipelines") + "," + _REGRET + """,
a AS (SELECT pipeline_id, avg(1 - regret) AS s, count(*) AS n FROM r GROUP BY pipeline_id),
off AS (SELECT p.pipeline_id, round(coalesce(a.s, 0.0), 10) AS ranking_score, coalesce(a.n, 0) AS n_evals
        FROM pipelines p LEFT JOIN a USING (pipeline_id))"""

ORACLE["avg_regret"] = _AVG_REGRET + "\nSELECT * FROM off"

ORACLE["avg_regret_topk"] = _AVG_REGRET + f"""
SELECT row_number() OVER (ORDER BY ranking_score DESC, pipeline_id) AS rank, pipeline_id, ranking_score, n_evals
FROM off WHERE n_evals >= {MIN_EVALS} ORDER BY ranking_score DESC, pipeline_id LIMIT {TOTAL_N_CONFIGS}"""

ORACLE["get_df_filters"] = with_fixtures("evaluations") + f"""
SELECT * FROM evaluations
WHERE dataset_id IN ({_DS}) AND metric = '{METRIC}' AND logs_name IN ({_RUNS})"""

ORACLE["get_df_by_names"] = with_fixtures("evaluations", "pipelines") + f"""
SELECT * FROM evaluations
WHERE dataset_id IN ({_DS})
  AND pipeline_id IN (SELECT pipeline_id FROM pipelines WHERE pipeline IN
      (SELECT pipeline FROM pipelines WHERE pipeline_id IN (10, 11, 12)))"""

ORACLE["avg_equivalent"] = with_fixtures("evaluations") + """,
d AS (SELECT dataset_id, pipeline_id, score, metric, logs_name, min(eval_id) AS eval_id
      FROM evaluations GROUP BY dataset_id, pipeline_id, score, metric, logs_name)
SELECT dataset_id, pipeline_id, metric,
       round(CAST(sum(CAST(score AS DECIMAL(38, 18))) AS DOUBLE) / count(score), 10) AS score,
       arg_min(logs_name, eval_id) AS logs_name, count(*) AS n_records
FROM d GROUP BY dataset_id, pipeline_id, metric"""

_TOPN = f"""
t AS (SELECT dataset_id, pipeline_id, eval_id, score,
             row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, pipeline_id, eval_id) AS position
      FROM evaluations WHERE metric = '{METRIC}')"""

ORACLE["topn_per_dataset"] = with_fixtures("evaluations") + "," + _TOPN + f"""
SELECT dataset_id, position, pipeline_id, eval_id, score FROM t WHERE position <= {TOP_N}"""

ORACLE["topn_global"] = with_fixtures("evaluations") + f"""
SELECT eval_id, dataset_id, pipeline_id, score FROM evaluations
WHERE metric = '{METRIC}'
ORDER BY score DESC, pipeline_id, eval_id LIMIT {TOTAL_N_CONFIGS}"""

ORACLE["relevance_labels"] = with_fixtures("evaluations") + "," + _TOPN + f"""
SELECT dataset_id AS qid, dataset_id, pipeline_id, score,
       count(*) OVER (PARTITION BY dataset_id) - position + 1 AS relevance
FROM t WHERE position <= {TOP_N}"""

ORACLE["candidate_set"] = with_fixtures("evaluations") + "," + _TOPN + f"""
SELECT DISTINCT pipeline_id FROM t WHERE position <= {TOP_N}"""

ORACLE["dataset_minmax"] = with_fixtures("evaluations") + f"""
SELECT dataset_id, min(score) AS min_score, max(score) AS max_score
FROM evaluations WHERE metric = '{METRIC}' GROUP BY dataset_id"""

ORACLE["value_counts"] = with_fixtures("evaluations") + """
SELECT logs_name, count(*) AS n FROM evaluations GROUP BY logs_name"""

ORACLE["regret_rows"] = with_fixtures("evaluations") + "," + _REGRET + """
SELECT eval_id, dataset_id, pipeline_id, round(regret, 10) AS regret FROM r"""

# --- step 3 -------------------------------------------------------------------

_VALID = "score IS NOT NULL AND NOT isnan(score) AND score < 1e6"
_PROCESSED = with_fixtures("results") + f""",
v AS (SELECT * FROM results WHERE {_VALID}),
fill AS (SELECT dataset_id, min(score) - 0.01 AS fill_value FROM v GROUP BY dataset_id),
best AS (SELECT metalearner_name, dataset_id, max(score) AS score FROM v WHERE slot <= 5 GROUP BY 1, 2),
grid AS (SELECT l.metalearner_name, d.dataset_id
         FROM (SELECT DISTINCT metalearner_name FROM results) l CROSS JOIN (SELECT DISTINCT dataset_id FROM results) d),
p AS (SELECT g.metalearner_name, g.dataset_id, coalesce(b.score, f.fill_value) AS score, b.score IS NULL AS filled
      FROM grid g LEFT JOIN fill f USING (dataset_id) LEFT JOIN best b USING (metalearner_name, dataset_id)),
rk AS (SELECT *, rank() OVER (PARTITION BY dataset_id ORDER BY score DESC)
                 + (count(*) OVER (PARTITION BY dataset_id, score) - 1) / 2.0 AS rank FROM p)"""

ORACLE["best_of_first5"] = with_fixtures("results") + f"""
SELECT metalearner_name, dataset_id, max(score) AS score FROM results WHERE slot <= 5 AND {_VALID} GROUP BY 1, 2"""

ORACLE["grid_fill_missing"] = _PROCESSED + """
SELECT metalearner_name, dataset_id, round(score, 10) AS score, filled FROM p"""

ORACLE["regret_mean_std"] = with_fixtures("results") + f""",
v AS (SELECT * FROM results WHERE {_VALID}),
bounds AS (SELECT dataset_id, min(score) AS lo, max(score) AS hi FROM v GROUP BY 1),
r AS (SELECT metalearner_name, dataset_id, slot,
             CASE WHEN {_VALID} THEN (CASE WHEN hi = lo THEN 0.0 ELSE abs(hi - score) / abs(lo - hi) END)
                  ELSE 1.0 END AS regret
      FROM results LEFT JOIN bounds USING (dataset_id) WHERE slot <= 25),
grid AS (SELECT l.metalearner_name, d.dataset_id
         FROM (SELECT DISTINCT metalearner_name FROM results) l CROSS JOIN (SELECT DISTINCT dataset_id FROM results) d),
slots AS (SELECT * FROM grid CROSS JOIN (SELECT range AS slot FROM range(1, 26)) s),
padded AS (SELECT s.metalearner_name, s.dataset_id, coalesce(r.regret, 1.0) AS regret
           FROM slots s LEFT JOIN r USING (metalearner_name, dataset_id, slot)),
pp AS (SELECT metalearner_name, dataset_id, avg(regret) AS m, stddev_samp(regret) AS sd FROM padded GROUP BY 1, 2)
SELECT metalearner_name, round(avg(m), 10) AS regret_mean, round(avg(sd), 10) AS regret_std FROM pp GROUP BY 1"""

ORACLE["avg_ranks"] = _PROCESSED + """
SELECT metalearner_name, round(avg(rank), 10) AS avg_rank, count(*) AS n_datasets FROM rk GROUP BY 1"""

ORACLE["friedman"] = _PROCESSED + """,
rs AS (SELECT metalearner_name, sum(rank) AS r FROM rk GROUP BY 1),
tt AS (SELECT dataset_id, score, count(*) AS t FROM p GROUP BY 1, 2),
a AS (SELECT sum(r * r) AS ssbn, count(*) AS k FROM rs),
b AS (SELECT sum(t * t * t - t) AS tie, count(DISTINCT dataset_id) AS n FROM tt)
SELECT n AS n_datasets, k AS n_learners,
       round((12.0 / (n * k * (k + 1)) * ssbn - 3.0 * n * (k + 1)) / (1 - tie / (n * k * (k * k - 1))), 10) AS statistic
FROM a, b"""

# Five learners give four degrees of freedom, for which the chi-square tail is closed.
ORACLE["friedman_pvalue"] = f"""
SELECT n_datasets, n_learners, round(statistic, 8) AS statistic, round(exp(-statistic / 2) * (1 + statistic / 2), 8) AS p_value FROM ({ORACLE["friedman"]})"""

ORACLE["pivot_scores"] = _PROCESSED + """
SELECT dataset_id,
       max(CASE WHEN metalearner_name = 'click' THEN score END) AS click,
       max(CASE WHEN metalearner_name = 'error' THEN score END) AS error,
       max(CASE WHEN metalearner_name = 'purchase' THEN score END) AS purchase,
       max(CASE WHEN metalearner_name = 'signup' THEN score END) AS signup,
       max(CASE WHEN metalearner_name = 'view' THEN score END) AS view
FROM p GROUP BY dataset_id"""

ORACLE["learner_positions"] = _PROCESSED + """
SELECT metalearner_name, dataset_id,
       row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, metalearner_name) AS position FROM p"""

ORACLE["running_best"] = with_fixtures("run_log") + """
SELECT run_id, eval_no, score,
       max(score) OVER (PARTITION BY run_id ORDER BY eval_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far
FROM run_log"""

ORACLE["gap_seconds"] = with_fixtures("run_log") + """
SELECT run_id, eval_no,
       date_diff('microsecond', lag(ts) OVER (PARTITION BY run_id ORDER BY eval_no), ts) / 1e6 AS gap_seconds
FROM run_log"""

ORACLE["timing_fit"] = with_fixtures("run_log") + """,
d AS (SELECT run_id, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS duration,
             CAST(count(*) AS double) AS n_evals FROM run_log GROUP BY 1)
SELECT round(regr_slope(duration, n_evals), 6) AS slope, round(regr_intercept(duration, n_evals), 6) AS intercept,
       round(regr_r2(duration, n_evals), 10) AS r2, CAST(regr_count(duration, n_evals) AS bigint) AS n FROM d"""

ORACLE["run_methods"] = with_fixtures("evaluations") + """
SELECT method, count(*) AS n FROM (
  SELECT CASE WHEN logs_name LIKE '%AsynchronousSuccessiveHalving%' THEN 'AsynchronousSuccessiveHalving'
              WHEN logs_name LIKE '%AsyncEA%' THEN 'AsyncEA'
              WHEN logs_name LIKE '%RandomSearch%' THEN 'RandomSearch' END AS method
  FROM evaluations) t GROUP BY method"""

ORACLE["clip_recode"] = with_fixtures("results") + """
SELECT metalearner_name, CASE dataset_id WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE dataset_id END AS dataset_id, slot,
       CASE WHEN score >= -0.5 THEN score END AS score FROM results"""

ORACLE["log_loss"] = with_fixtures("probs") + """
SELECT round(-avg(ln(least(greatest(p_true, 1e-15), 1 - 1e-15))), 10) AS log_loss, count(*) AS n_rows FROM probs"""

# --- step 4 -------------------------------------------------------------------

_SIMS = with_fixtures("evaluations", "vectors", "pipelines") + """,
x AS (SELECT dataset_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM vectors),
q AS (SELECT pos, x AS q FROM x WHERE dataset_id = 0),
qn AS (SELECT sum(q * q) AS qq FROM q),
sims AS (SELECT x.dataset_id, sum(x.x * q.q) / (sqrt(sum(x.x * x.x)) * sqrt(max(qn.qq))) AS cosine,
                sqrt(sum((x.x - q.q) * (x.x - q.q))) AS euclidean
         FROM x JOIN q USING (pos), qn
         WHERE x.dataset_id <> 0 AND x.dataset_id IN (SELECT dataset_id FROM evaluations)
         GROUP BY x.dataset_id)"""

ORACLE["similarity_all"] = _SIMS + """
SELECT dataset_id, round(cosine, 10) AS cosine, round(euclidean, 10) AS euclidean,
       round(exp(-euclidean), 10) AS kernel FROM sims"""

ORACLE["cosine_topk"] = _SIMS + """,
s AS (SELECT dataset_id, round(cosine, 10) AS cosine FROM sims)
SELECT row_number() OVER (ORDER BY cosine DESC, dataset_id) AS rank, dataset_id, cosine
FROM s ORDER BY cosine DESC, dataset_id LIMIT 5"""

ORACLE["euclid_topk"] = _SIMS + """,
s AS (SELECT dataset_id, round(euclidean, 10) AS euclidean FROM sims)
SELECT row_number() OVER (ORDER BY euclidean, dataset_id) AS rank, dataset_id, euclidean
FROM s ORDER BY euclidean, dataset_id LIMIT 5"""

ORACLE["vector_pairs"] = """
WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos,
                  len(embedding) AS n FROM embeddings),
pr AS (SELECT a.vec_id, sum(a.x * b.x) AS dot, sum(a.x * a.x) AS aa, sum(b.x * b.x) AS bb,
              sum((a.x - b.x) * (a.x - b.x)) AS dd, max(a.n) = max(b.n) AS same_length
       FROM x a JOIN x b ON b.vec_id = a.vec_id + 1 AND a.pos = b.pos GROUP BY a.vec_id)
SELECT vec_id, round(CASE WHEN sqrt(aa) * sqrt(bb) > 0 THEN dot / (sqrt(aa) * sqrt(bb)) END, 10) AS cosine,
       round(sqrt(dd), 10) AS euclidean, round(exp(-sqrt(dd)), 10) AS kernel, same_length FROM pr"""

_UTIL = _SIMS + f""",
e AS (SELECT * FROM evaluations WHERE metric = '{METRIC}' AND dataset_id <> 0),
b AS (SELECT dataset_id, min(score) AS min_score, max(score) AS max_score FROM e GROUP BY dataset_id),
r AS (SELECT e.*, CASE WHEN max_score = min_score THEN 0.0
                       ELSE abs(max_score - score) / abs(min_score - max_score) END AS regret
      FROM e JOIN b USING (dataset_id)),
u AS (SELECT pipeline_id, avg(s.cosine * (1 - regret)) AS utility, count(*) AS n
      FROM r JOIN sims s USING (dataset_id) GROUP BY pipeline_id),
us AS (SELECT p.pipeline_id, round(coalesce(u.utility, 0.0), 10) AS utility, coalesce(u.n, 0) AS n_evals
       FROM pipelines p LEFT JOIN u USING (pipeline_id))"""

ORACLE["utility_scores"] = _UTIL + "\nSELECT * FROM us"

ORACLE["utility_topk"] = _UTIL + f"""
SELECT row_number() OVER (ORDER BY utility DESC, pipeline_id) AS rank, pipeline_id, utility
FROM us ORDER BY utility DESC, pipeline_id LIMIT {TOTAL_N_CONFIGS}"""

ORACLE["top_similarity_slice"] = _SIMS + f""",
near AS (SELECT dataset_id, row_number() OVER (ORDER BY round(cosine, 10) DESC, dataset_id) AS sim_rank
         FROM sims ORDER BY round(cosine, 10) DESC, dataset_id LIMIT 5),
best AS (SELECT dataset_id, pipeline_id, max(score) AS best FROM evaluations
         WHERE metric = '{METRIC}' AND dataset_id <> 0 AND dataset_id IN (SELECT dataset_id FROM near)
         GROUP BY 1, 2),
ranked AS (SELECT b.*, n.sim_rank,
                  row_number() OVER (PARTITION BY b.dataset_id ORDER BY best DESC, pipeline_id) AS pos
           FROM best b JOIN near n USING (dataset_id)),
keyed AS (SELECT *, (pos - 1) // 5 AS rnd FROM ranked WHERE pos <= 25),
firsts AS (SELECT pipeline_id, arg_min(dataset_id, (rnd, sim_rank, pos)) AS dataset_id,
                  min((rnd, sim_rank, pos)) AS k FROM keyed GROUP BY pipeline_id)
SELECT row_number() OVER (ORDER BY k) AS rank, pipeline_id, dataset_id
FROM firsts ORDER BY k LIMIT {TOTAL_N_CONFIGS}"""

# --- step 5 -------------------------------------------------------------------

_MATRIX = with_fixtures("evaluations") + "," + _TOPN + f""",
cands AS (SELECT DISTINCT pipeline_id FROM t WHERE position <= 5),
perf AS (SELECT dataset_id, pipeline_id, avg(score) AS score FROM evaluations
         WHERE metric = '{METRIC}' AND pipeline_id IN (SELECT pipeline_id FROM cands) GROUP BY 1, 2),
pb AS (SELECT dataset_id, min(score) AS lo, max(score) AS hi FROM perf GROUP BY 1),
m AS (SELECT dataset_id, pipeline_id,
             round(CASE WHEN hi = lo THEN 0.0 ELSE abs(hi - score) / abs(lo - hi) END, 10) AS regret
      FROM perf JOIN pb USING (dataset_id))"""

ORACLE["results_matrix_regret"] = _MATRIX + "\nSELECT * FROM m"


def _portfolio_sql(k: int) -> str:
    parts = [_MATRIX + """,
c AS (SELECT DISTINCT pipeline_id FROM m),
b0 AS (SELECT DISTINCT dataset_id, 1.0 AS best FROM m)"""]
    for i in range(1, k + 1):
        excl = " AND ".join(f"c.pipeline_id <> (SELECT pipeline_id FROM p{j})" for j in range(1, i)) or "TRUE"
        parts.append(f"""g{i} AS (SELECT c.pipeline_id,
                round(coalesce(sum(greatest(b.best - m.regret, 0.0)), 0.0), 10) AS gain
         FROM c LEFT JOIN m ON m.pipeline_id = c.pipeline_id LEFT JOIN b{i - 1} b ON b.dataset_id = m.dataset_id
         WHERE {excl} GROUP BY c.pipeline_id),
p{i} AS (SELECT pipeline_id, gain FROM g{i} ORDER BY gain DESC, pipeline_id LIMIT 1),
b{i} AS (SELECT b.dataset_id, least(b.best, coalesce(m.regret, 1.0)) AS best FROM b{i - 1} b
         LEFT JOIN m ON m.dataset_id = b.dataset_id AND m.pipeline_id = (SELECT pipeline_id FROM p{i}))""")
    sel = []
    for i in range(1, k + 1):
        tot = "(SELECT count(*) FROM b0)" + "".join(f" - (SELECT gain FROM p{j})" for j in range(1, i + 1))
        sel.append(f"SELECT CAST({i} AS BIGINT) AS position, pipeline_id, gain, round({tot}, 10) AS total_regret FROM p{i}")
    return ",\n".join(parts) + "\n" + "\nUNION ALL\n".join(sel)


ORACLE["portfolio_k3"] = _portfolio_sql(3)

# --- step 6 -------------------------------------------------------------------

_LODO = with_fixtures("evaluations", "pipelines") + "," + _REGRET + f""",
h AS (SELECT DISTINCT dataset_id AS held_out_id FROM e),
hp AS (SELECT h.held_out_id, p.pipeline_id FROM h CROSS JOIN pipelines p),
a AS (SELECT h.held_out_id, r.pipeline_id, avg(1 - r.regret) AS s, count(*) AS n
      FROM h JOIN r ON r.dataset_id <> h.held_out_id GROUP BY 1, 2),
sc AS (SELECT hp.held_out_id, hp.pipeline_id, round(coalesce(a.s, 0.0), 10) AS ranking_score,
              coalesce(a.n, 0) AS n_evals
       FROM hp LEFT JOIN a USING (held_out_id, pipeline_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY held_out_id ORDER BY ranking_score DESC, pipeline_id) AS rank
       FROM sc WHERE n_evals >= {MIN_EVALS}),
own AS (SELECT dataset_id AS held_out_id, pipeline_id, avg(score) AS heldout_score FROM e GROUP BY 1, 2),
recs AS (SELECT rk.held_out_id, rk.rank, rk.pipeline_id, rk.ranking_score, rk.n_evals, own.heldout_score
         FROM rk LEFT JOIN own USING (held_out_id, pipeline_id) WHERE rk.rank <= {TOTAL_N_CONFIGS})"""

ORACLE["lodo_avg_regret"] = _LODO + "\nSELECT * FROM recs"

ORACLE["lodo_summary"] = _LODO + """,
bb AS (SELECT held_out_id, max(heldout_score) AS best_score, count(heldout_score) AS n_scored FROM recs GROUP BY 1)
SELECT bb.held_out_id, best_score, n_scored,
       round(CASE WHEN best_score IS NULL THEN 1.0 WHEN b.max_score = b.min_score THEN 0.0
                  ELSE abs(b.max_score - best_score) / abs(b.min_score - b.max_score) END, 10) AS regret
FROM bb JOIN b ON b.dataset_id = bb.held_out_id"""

ORACLE["kept_pipelines"] = with_fixtures("evaluations", "pipelines") + """
SELECT * FROM pipelines WHERE pipeline_id IN (SELECT pipeline_id FROM evaluations WHERE dataset_id NOT IN (0, 1, 2))"""

ORACLE["holdout_split"] = with_fixtures("samples") + """,
s AS (SELECT dataset_id,
             CAST('0x' || substr(md5(concat_ws(':', 7, row_id)), 1, 8) AS BIGINT) / 4294967296.0 < 0.8 AS is_train
      FROM samples)
SELECT dataset_id, CAST(sum(CAST(is_train AS BIGINT)) AS BIGINT) AS n_train,
       CAST(sum(CAST(NOT is_train AS BIGINT)) AS BIGINT) AS n_test
FROM s GROUP BY dataset_id"""

# --- step 7 -------------------------------------------------------------------

_CELLS = with_fixtures("samples") + """,
cells AS (
  SELECT CAST(dataset_id AS BIGINT) AS dataset_id, row_id, 'num_total' AS attr, false AS is_cat,
         CAST(num_total AS DOUBLE) AS num_val, CAST(NULL AS VARCHAR) AS cat_val FROM samples
  UNION ALL SELECT CAST(dataset_id AS BIGINT), row_id, 'num_bal', false, CAST(num_bal AS DOUBLE), NULL FROM samples
  UNION ALL SELECT CAST(dataset_id AS BIGINT), row_id, 'cat_prio', true, NULL, cat_prio FROM samples
  UNION ALL SELECT CAST(dataset_id AS BIGINT), row_id, 'cat_seg', true, NULL, cat_seg FROM samples),
labels AS (SELECT CAST(dataset_id AS BIGINT) AS dataset_id, row_id, y FROM samples),
ast AS (SELECT dataset_id, attr, bool_or(is_cat) AS is_cat,
               sum(CASE WHEN num_val IS NULL AND cat_val IS NULL THEN 1 ELSE 0 END) AS n_missing,
               count(DISTINCT cat_val) + max(CASE WHEN is_cat AND cat_val IS NULL THEN 1 ELSE 0 END) AS n_categories
        FROM cells GROUP BY 1, 2),
mu AS (SELECT dataset_id, attr, avg(num_val) AS m FROM cells WHERE NOT is_cat GROUP BY 1, 2),
mom AS (SELECT c.dataset_id, c.attr,
               avg(power(num_val - m, 3)) / power(avg(power(num_val - m, 2)), 1.5) AS skewness,
               avg(power(num_val - m, 4)) / power(avg(power(num_val - m, 2)), 2) - 3 AS kurtosis
        FROM cells c JOIN mu USING (dataset_id, attr) WHERE NOT c.is_cat AND num_val IS NOT NULL GROUP BY 1, 2)"""


def _long_sql(d: str) -> str:
    return f"""
SELECT dataset_id, name, round(coalesce(CASE WHEN isfinite(value) THEN value ELSE 0 END, 0), 8) AS value
FROM (UNPIVOT ({d}) ON COLUMNS(* EXCLUDE (dataset_id)) INTO NAME name VALUE value)"""


ORACLE["mf_simple"] = _CELLS + """,
inst AS (SELECT dataset_id, count(*) AS nr_inst, count(DISTINCT y) AS nr_class FROM labels GROUP BY 1),
attrs AS (SELECT dataset_id, count(*) AS nr_attr, sum(CASE WHEN is_cat THEN 1 ELSE 0 END) AS nr_cat,
                 sum(CASE WHEN is_cat THEN 0 ELSE 1 END) AS nr_num FROM ast GROUP BY 1),
d AS (SELECT dataset_id, CAST(nr_inst AS DOUBLE) AS nr_inst, ln(nr_inst) AS log_nr_inst,
             CAST(nr_attr AS DOUBLE) AS nr_attr, ln(nr_attr) AS log_nr_attr, CAST(nr_class AS DOUBLE) AS nr_class,
             CAST(nr_cat AS DOUBLE) AS nr_cat, CAST(nr_num AS DOUBLE) AS nr_num,
             coalesce(CASE WHEN nr_num <> 0 THEN nr_cat / nr_num END, 0) AS cat_to_num,
             coalesce(CASE WHEN nr_cat <> 0 THEN nr_num / nr_cat END, 0) AS num_to_cat,
             nr_attr / nr_inst AS attr_to_inst, ln(nr_attr / nr_inst) AS log_attr_to_inst,
             nr_inst / nr_attr AS inst_to_attr, ln(nr_inst / nr_attr) AS log_inst_to_attr
      FROM inst JOIN attrs USING (dataset_id))""" + _long_sql("SELECT * FROM d")

ORACLE["mf_class"] = _CELLS + """,
cn AS (SELECT dataset_id, y, count(*) AS n FROM labels GROUP BY 1, 2),
p AS (SELECT dataset_id, n / sum(n) OVER (PARTITION BY dataset_id) AS p FROM cn),
d AS (SELECT dataset_id, -sum(p * log2(p)) AS class_ent, min(p) AS "freq_class.min", max(p) AS "freq_class.max",
             avg(p) AS "freq_class.mean", stddev_samp(p) AS "freq_class.sd" FROM p GROUP BY 1)""" + _long_sql("SELECT * FROM d")

ORACLE["mf_moments"] = _CELLS + """,
z AS (SELECT dataset_id, coalesce(CASE WHEN isfinite(kurtosis) THEN kurtosis ELSE 0 END, 0) AS k,
             coalesce(CASE WHEN isfinite(skewness) THEN skewness ELSE 0 END, 0) AS s
      FROM ast JOIN mom USING (dataset_id, attr) WHERE NOT ast.is_cat),
d AS (SELECT dataset_id, min(k) AS "kurtosis.min", max(k) AS "kurtosis.max", avg(k) AS "kurtosis.mean",
             stddev_samp(k) AS "kurtosis.sd", min(s) AS "skewness.min", max(s) AS "skewness.max",
             avg(s) AS "skewness.mean", stddev_samp(s) AS "skewness.sd" FROM z GROUP BY 1)""" + _long_sql("SELECT * FROM d")

ORACLE["mf_missing"] = _CELLS + """,
rw AS (SELECT dataset_id, row_id, max(CASE WHEN num_val IS NULL AND cat_val IS NULL THEN 1 ELSE 0 END) AS m
       FROM cells GROUP BY 1, 2),
rs AS (SELECT dataset_id, sum(m) AS nr_rows_with_missval, count(*) AS n_rows FROM rw GROUP BY 1),
cs AS (SELECT dataset_id, sum(CASE WHEN n_missing > 0 THEN 1 ELSE 0 END) AS nr_cols_with_missval, count(*) AS n_cols,
              sum(n_missing) AS n_miss_values FROM ast GROUP BY 1),
d AS (SELECT dataset_id, CAST(nr_rows_with_missval AS DOUBLE) AS nr_rows_with_missval,
             nr_rows_with_missval / n_rows AS miss_rows_perc,
             CAST(nr_cols_with_missval AS DOUBLE) AS nr_cols_with_missval, nr_cols_with_missval / n_cols AS miss_cols_perc,
             CAST(n_miss_values AS DOUBLE) AS n_miss_values, n_miss_values / (n_rows * n_cols) AS perc_miss_values
      FROM rs JOIN cs USING (dataset_id))""" + _long_sql("SELECT * FROM d")

ORACLE["mf_categorical"] = _CELLS + """,
d AS (SELECT dataset_id,
             CAST(min(CASE WHEN is_cat THEN n_categories END) AS DOUBLE) AS "categorical_values.min",
             CAST(max(CASE WHEN is_cat THEN n_categories END) AS DOUBLE) AS "categorical_values.max",
             avg(CASE WHEN is_cat THEN n_categories END) AS "categorical_values.mean",
             stddev_pop(CASE WHEN is_cat THEN n_categories END) AS "categorical_values.std",
             CAST(sum(CASE WHEN is_cat THEN n_categories END) AS DOUBLE) AS "categorical_values.total"
      FROM ast GROUP BY 1)""" + _long_sql("SELECT * FROM d")

ORACLE["feasible_features"] = _CELLS + """,
f AS (SELECT dataset_id, 'kurtosis.' || attr AS name, kurtosis AS value FROM mom
      UNION ALL SELECT dataset_id, 'skewness.' || attr, skewness FROM mom)
SELECT name FROM f GROUP BY name HAVING bool_and(value IS NOT NULL AND isfinite(value))"""

# --- step 8 -------------------------------------------------------------------

_STEPS = with_fixtures("pipelines") + r""",
raw AS (SELECT pipeline_id, unnest(list_reverse(regexp_extract_all(pipeline, '([A-Za-z]\w*)\(', 1))) AS algorithm,
               generate_subscripts(regexp_extract_all(pipeline, '([A-Za-z]\w*)\(', 1), 1) AS i FROM pipelines),
steps AS (SELECT pipeline_id, CAST(row_number() OVER (PARTITION BY pipeline_id ORDER BY i) - 1 AS BIGINT) AS pos, algorithm
          FROM raw WHERE algorithm NOT IN ('ord-enc', 'oh-enc', 'imputation')),
params AS (SELECT pipeline_id,
                  unnest(regexp_extract_all(pipeline, '([A-Za-z]\w*)\.(\w+)=([^,)]+)', 1)) AS algorithm,
                  unnest(regexp_extract_all(pipeline, '([A-Za-z]\w*)\.(\w+)=([^,)]+)', 2)) AS param,
                  trim(unnest(regexp_extract_all(pipeline, '([A-Za-z]\w*)\.(\w+)=([^,)]+)', 3))) AS value
           FROM pipelines)"""

ORACLE["config_steps"] = _STEPS + "\nSELECT * FROM steps"
ORACLE["config_params"] = _STEPS + "\nSELECT * FROM params"
ORACLE["params_in_space"] = _STEPS + """
SELECT * FROM params WHERE (algorithm, param) IN (VALUES ('Tree', 'depth'), ('Forest', 'n'), ('Pca', 'k'))"""

_BITS = _STEPS + """,
vocab AS (SELECT * FROM (VALUES ('Bayes', 0), ('Forest', 1), ('Pca', 2), ('Scaler', 3), ('Tree', 4)) v(algorithm, idx)),
s AS (SELECT steps.*, vocab.idx FROM steps JOIN vocab USING (algorithm)),
succ AS (SELECT pipeline_id, 5 + idx * 5 + lead(idx) OVER (PARTITION BY pipeline_id ORDER BY pos) AS idx,
                algorithm || '-->' || lead(algorithm) OVER (PARTITION BY pipeline_id ORDER BY pos) AS feature FROM s),
bits AS (SELECT DISTINCT pipeline_id, CAST(idx AS BIGINT) AS idx, feature FROM (
           SELECT pipeline_id, idx, algorithm AS feature FROM s
           UNION ALL SELECT * FROM succ WHERE idx IS NOT NULL) u)"""

ORACLE["algo_bits"] = _BITS + "\nSELECT * FROM bits"
ORACLE["algo_successors"] = _BITS + "\nSELECT * FROM bits WHERE idx >= 5"

ORACLE["rankml_hashes"] = _STEPS + """,
kv AS (SELECT pipeline_id, algorithm, list_sort(list(param || '=' || value)) AS kv FROM params GROUP BY 1, 2),
txt AS (SELECT s.pipeline_id, s.pos, s.algorithm || '(' || coalesce(array_to_string(kv.kv, ', '), '') || ')' AS text
        FROM steps s LEFT JOIN kv USING (pipeline_id, algorithm)),
n AS (SELECT pipeline_id, count(*) AS n FROM steps GROUP BY 1),
slots AS (SELECT pipeline_id, n, unnest(range(0, (SELECT max(n) FROM n))) AS pos FROM n),
rev AS (SELECT txt.pipeline_id, n.n - 1 - txt.pos AS pos, md5(text) AS hash FROM txt JOIN n USING (pipeline_id))
SELECT slots.pipeline_id, CAST(slots.pos AS BIGINT) AS pos, coalesce(rev.hash, md5('')) AS hash
FROM slots LEFT JOIN rev USING (pipeline_id, pos)"""

ORACLE["longest_pipeline"] = _STEPS + """
SELECT max(n) AS longest FROM (SELECT pipeline_id, count(*) AS n FROM steps GROUP BY 1) t"""

ORACLE["assign_ids"] = with_fixtures("pipelines") + """,
names AS (SELECT pipeline FROM pipelines UNION
          SELECT concat('Tree(Scaler(data), Tree.depth=', CAST(p_partkey AS varchar(20)), ')') FROM part),
unseen AS (SELECT pipeline FROM names WHERE pipeline NOT IN (SELECT pipeline FROM pipelines))
SELECT pipeline, (SELECT max(pipeline_id) FROM pipelines) + row_number() OVER (ORDER BY pipeline) AS pipeline_id
FROM unseen"""

ORACLE["pipeline_buckets"] = with_fixtures("pipelines") + """
SELECT pipeline_id, (200003 * pipeline_id + 200131) % 1000 AS bucket FROM pipelines"""

ORACLE["skip_rules"] = _STEPS + """,
evaluations AS (""" + FIXTURE_SQL["evaluations"] + """),
samples AS (""" + FIXTURE_SQL["samples"] + """),""" + _TOPN + """,
sizes AS (SELECT CAST(dataset_id AS BIGINT) AS dataset_id, count(*) AS n_rows, 4 AS n_cols FROM samples GROUP BY 1),
recs AS (SELECT dataset_id, pipeline_id, position FROM t WHERE position <= 5),
flag AS (SELECT r.dataset_id, r.pipeline_id FROM recs r JOIN sizes z USING (dataset_id)
         WHERE (z.n_rows * z.n_cols > 2400 AND r.pipeline_id IN (SELECT pipeline_id FROM steps WHERE algorithm = 'Forest'))
            OR (z.n_cols > 3 AND r.pipeline_id IN (SELECT pipeline_id FROM steps WHERE algorithm = 'Pca')))
SELECT * FROM recs WHERE (dataset_id, pipeline_id) NOT IN (SELECT (dataset_id, pipeline_id) FROM flag)"""

# --- step 9 -------------------------------------------------------------------

_SUB = _CELLS + """,
bt AS (SELECT range AS batch FROM range(0, 3)),
rows_b AS (SELECT l.dataset_id, b.batch, l.row_id,
                  CAST('0x' || substr(md5(concat_ws(':', 11 + b.batch * 7919, l.row_id)), 1, 8) AS BIGINT) AS h
           FROM labels l CROSS JOIN bt b),
srows AS (SELECT dataset_id, batch, row_id FROM (
            SELECT *, row_number() OVER (PARTITION BY dataset_id, batch ORDER BY h, row_id) AS rn FROM rows_b) t
          WHERE rn <= 256),
attrs AS (SELECT dataset_id, attr, dense_rank() OVER (PARTITION BY dataset_id ORDER BY attr) AS ai
          FROM (SELECT DISTINCT dataset_id, attr FROM cells WHERE NOT is_cat) a),
feats AS (SELECT dataset_id, batch, attr FROM (
            SELECT a.dataset_id, b.batch, a.attr,
                   row_number() OVER (PARTITION BY a.dataset_id, b.batch
                                      ORDER BY CAST('0x' || substr(md5(concat_ws(':', 11 + b.batch * 7919 + 1, a.ai)), 1, 8) AS BIGINT), a.attr) AS rn
            FROM attrs a CROSS JOIN bt b) t WHERE rn <= 16),
cls AS (SELECT dataset_id, y, dense_rank() OVER (PARTITION BY dataset_id ORDER BY y) - 1 AS class_idx
        FROM (SELECT DISTINCT dataset_id, y FROM labels) c),
scls AS (SELECT dataset_id, batch, class_idx, y FROM (
           SELECT c.*, b.batch,
                  row_number() OVER (PARTITION BY c.dataset_id, b.batch
                                     ORDER BY CAST('0x' || substr(md5(concat_ws(':', 11 + b.batch * 7919 + 2, c.class_idx)), 1, 8) AS BIGINT), c.class_idx) AS rn
           FROM cls c CROSS JOIN bt b) t WHERE rn <= 3),
imp0 AS (SELECT c.dataset_id, c.attr, c.row_id, coalesce(c.num_val, m.m) AS x
        FROM cells c JOIN mu m USING (dataset_id, attr) WHERE NOT c.is_cat),
ib AS (SELECT dataset_id, attr, min(x) AS lo, max(x) AS hi FROM imp0 GROUP BY 1, 2),
imp AS (SELECT dataset_id, attr, row_id, CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0.0 END AS x
        FROM imp0 JOIN ib USING (dataset_id, attr)),
xs AS (SELECT i.dataset_id, r.batch, i.attr, i.row_id, i.x FROM imp i
       JOIN srows r USING (dataset_id, row_id) JOIN feats f ON f.dataset_id = i.dataset_id AND f.batch = r.batch AND f.attr = i.attr),
oh AS (SELECT r.dataset_id, r.batch, r.row_id, s.class_idx, CAST(l.y = s.y AS DOUBLE) AS y
       FROM srows r JOIN labels l USING (dataset_id, row_id) JOIN scls s ON s.dataset_id = r.dataset_id AND s.batch = r.batch),
pairs AS (SELECT xs.*, oh.class_idx, oh.y FROM xs JOIN oh USING (dataset_id, batch, row_id))"""

ORACLE["subtable_sample"] = _SUB + "\nSELECT dataset_id, CAST(batch AS BIGINT) AS batch, row_id FROM srows"

ORACLE["flatten_pairs"] = _SUB + """
SELECT dataset_id, CAST(batch AS BIGINT) AS batch, count(*) AS n_pairs, round(sum(x), 8) AS sum_x, sum(y) AS sum_y
FROM pairs GROUP BY 1, 2"""

ORACLE["pool_means"] = _SUB + """,
cf AS (SELECT dataset_id, batch, class_idx, attr, avg(x) AS x, avg(y) AS y, avg(x * y) AS xy, avg(x * x) AS xx
       FROM pairs GROUP BY 1, 2, 3, 4),
pb AS (SELECT dataset_id, batch, avg(x) AS x, avg(y) AS y, avg(xy) AS xy, avg(xx) AS xx FROM cf GROUP BY 1, 2),
pd AS (SELECT dataset_id, avg(x) AS x, avg(y) AS y, avg(xy) AS xy, avg(xx) AS xx, count(*) AS nb FROM pb GROUP BY 1)
SELECT dataset_id, CAST(dim AS BIGINT) AS dim, 'batch_' || CAST(nb AS VARCHAR) || '_dim' || CAST(dim AS VARCHAR) AS name,
       round(value, 10) AS value
FROM (SELECT dataset_id, nb, 0 AS dim, x AS value FROM pd UNION ALL SELECT dataset_id, nb, 1, y FROM pd
      UNION ALL SELECT dataset_id, nb, 2, xy FROM pd UNION ALL SELECT dataset_id, nb, 3, xx FROM pd) u"""

ORACLE["minmax_scaled"] = _CELLS + """,
imp AS (SELECT c.dataset_id, c.attr, coalesce(c.num_val, m.m) AS x FROM cells c JOIN mu m USING (dataset_id, attr)
        WHERE NOT c.is_cat),
bnd AS (SELECT dataset_id, attr, min(x) AS lo, max(x) AS hi FROM imp GROUP BY 1, 2)
SELECT dataset_id, attr, round(avg(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0.0 END), 8) AS mean_scaled,
       count(*) AS n
FROM imp JOIN bnd USING (dataset_id, attr) GROUP BY 1, 2"""

# --- characterization stores -----------------------------------------------------

ORACLE["list_characterizations"] = _CELLS + """,
vectors AS (""" + FIXTURE_SQL["vectors"] + """)
SELECT 'embedding' AS method, count(DISTINCT dataset_id) AS n FROM vectors
UNION ALL SELECT 'simple', count(DISTINCT dataset_id) FROM labels"""

ORACLE["char_lookup_ordered"] = with_fixtures("vectors") + """,
req AS (SELECT * FROM (VALUES (0, 5), (1, 3), (2, 5), (3, 0), (4, 39), (5, 12)) v(req_pos, dataset_id))
SELECT CAST(req_pos AS BIGINT) AS req_pos, CAST(req.dataset_id AS BIGINT) AS dataset_id,
       CAST(len(embedding) AS BIGINT) AS n_dims,
       round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda x: CAST(x AS DOUBLE))), lambda a, b: a + b), 8) AS value_sum
FROM req JOIN vectors USING (dataset_id)"""

# --- step 10 ------------------------------------------------------------------

ORACLE["ltr_frame"] = _BITS + """,
evaluations AS (""" + FIXTURE_SQL["evaluations"] + """),
vectors AS (""" + FIXTURE_SQL["vectors"] + """),
t AS (SELECT dataset_id, pipeline_id, score,
             row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, pipeline_id, eval_id) AS position
      FROM evaluations WHERE metric = 'neg_log_loss' AND dataset_id <> 0),
lab AS (SELECT dataset_id AS qid, dataset_id, pipeline_id,
               CAST(count(*) OVER (PARTITION BY dataset_id) - position + 1 AS DOUBLE) AS relevance
        FROM t WHERE position <= 10),
pv AS (SELECT pipeline_id, count(*) AS n_on FROM bits GROUP BY 1),
dv AS (SELECT dataset_id, len(embedding) AS nd,
              list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda x: CAST(x AS DOUBLE))), lambda a, b: a + b) AS ds
       FROM vectors)
SELECT lab.qid, lab.dataset_id, lab.pipeline_id, lab.relevance, CAST(dv.nd + 30 AS BIGINT) AS n_features,
       round(dv.ds + pv.n_on, 6) AS feature_sum
FROM lab JOIN dv USING (dataset_id) JOIN pv USING (pipeline_id)"""

ORACLE["dense_rank_ties"] = _AVG_REGRET + f""",
sc AS (SELECT pipeline_id, round(ranking_score, 1) AS predicted FROM off),
dr AS (SELECT *, dense_rank() OVER (ORDER BY predicted DESC) AS dense_rank FROM sc),
bs AS (SELECT dataset_id, max(score) AS best FROM e GROUP BY 1),
gp AS (SELECT pipeline_id, avg(best - score) AS gap FROM e JOIN bs USING (dataset_id) GROUP BY 1),
j AS (SELECT dr.*, gp.gap FROM dr LEFT JOIN gp USING (pipeline_id))
SELECT row_number() OVER (ORDER BY dense_rank, gap NULLS LAST, pipeline_id) AS rank, pipeline_id, dense_rank,
       predicted, round(gap, 10) AS gap
FROM j ORDER BY dense_rank, gap NULLS LAST, pipeline_id LIMIT {TOTAL_N_CONFIGS}"""

ORACLE["learner_utility"] = _UTIL + f"""
SELECT row_number() OVER (ORDER BY utility DESC, pipeline_id) AS rank, pipeline_id, utility AS score
FROM us ORDER BY utility DESC, pipeline_id LIMIT {TOTAL_N_CONFIGS}"""

_MATRIX_KEPT = _MATRIX.replace("FROM evaluations WHERE metric = '" + METRIC + "')",
                               "FROM evaluations WHERE metric = '" + METRIC + "' AND dataset_id <> 0)").replace(
    "FROM evaluations\n         WHERE metric = '" + METRIC + "' AND pipeline_id IN",
    "FROM evaluations\n         WHERE metric = '" + METRIC + "' AND dataset_id <> 0 AND pipeline_id IN")
# The learner builds its matrix without rounding the regrets (gains are rounded).
_MATRIX_KEPT = _MATRIX_KEPT.replace(
    "round(CASE WHEN hi = lo THEN 0.0 ELSE abs(hi - score) / abs(lo - hi) END, 10) AS regret",
    "CASE WHEN hi = lo THEN 0.0 ELSE abs(hi - score) / abs(lo - hi) END AS regret")
ORACLE["learner_portfolio"] = _portfolio_sql(3).replace(_MATRIX, _MATRIX_KEPT).replace(
    "SELECT CAST(1 AS BIGINT) AS position, pipeline_id, gain, round(", "SELECT CAST(1 AS BIGINT) AS rank, pipeline_id, round(").replace(
    "SELECT CAST(2 AS BIGINT) AS position, pipeline_id, gain, round(", "SELECT CAST(2 AS BIGINT) AS rank, pipeline_id, round(").replace(
    "SELECT CAST(3 AS BIGINT) AS position, pipeline_id, gain, round(", "SELECT CAST(3 AS BIGINT) AS rank, pipeline_id, round(").replace(
    ", 10) AS total_regret FROM p", ", 10) AS score FROM p")

ORACLE["dataset_sizes"] = _CELLS + """,
evaluations AS (""" + FIXTURE_SQL["evaluations"] + """),
inst AS (SELECT dataset_id, count(*) AS n_rows, count(DISTINCT y) AS n_classes FROM labels GROUP BY 1),
feats AS (SELECT dataset_id, count(DISTINCT attr) AS n_features FROM cells GROUP BY 1),
ev AS (SELECT dataset_id, count(*) AS n_evals FROM evaluations GROUP BY 1)
SELECT dataset_id, n_rows, n_features, n_classes, n_rows * (n_features + n_classes) AS n_cells,
       coalesce(n_evals, 0) AS n_evals
FROM inst JOIN feats USING (dataset_id) LEFT JOIN ev USING (dataset_id)"""

ORACLE["learner_subset"] = with_fixtures("results") + """
SELECT * FROM results WHERE metalearner_name NOT LIKE '%ew%'
  AND dataset_id IN (0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24, 26, 28, 30, 32, 34, 36)"""

ORACLE["warm_start_list"] = ORACLE["skip_rules"].replace("WHERE position <= 5),\nflag AS", "WHERE position <= 10),\nflag AS").replace(
    "SELECT * FROM recs WHERE (dataset_id, pipeline_id) NOT IN (SELECT (dataset_id, pipeline_id) FROM flag)",
    """SELECT dataset_id, slot, pipeline_id FROM (
  SELECT dataset_id, pipeline_id, row_number() OVER (PARTITION BY dataset_id ORDER BY position) AS slot
  FROM recs WHERE (dataset_id, pipeline_id) NOT IN (SELECT (dataset_id, pipeline_id) FROM flag)) k WHERE slot <= 5""")

# --- landmarkers ----------------------------------------------------------------

ORACLE["stratified_folds"] = _CELLS + """,
h AS (SELECT dataset_id, row_id, y, CAST('0x' || substr(md5(concat_ws(':', 3, row_id)), 1, 8) AS BIGINT) AS h FROM labels),
f AS (SELECT dataset_id, y, (row_number() OVER (PARTITION BY dataset_id, y ORDER BY h, row_id) - 1) % 3 AS fold FROM h)
SELECT dataset_id, CAST(fold AS BIGINT) AS fold, y, count(*) AS n FROM f GROUP BY 1, 2, 3"""

ORACLE["naive_bayes_landmarker"] = _CELLS + """,
folds AS (SELECT dataset_id, row_id, y, CAST('0x' || substr(md5(concat_ws(':', 3, row_id)), 1, 8) AS BIGINT) % 10 AS fold FROM labels),
x AS (SELECT c.dataset_id, c.row_id, c.attr, coalesce(c.num_val, m.m) AS x FROM cells c JOIN mu m USING (dataset_id, attr)
      WHERE NOT c.is_cat),
xf AS (SELECT x.*, f.fold, f.y FROM x JOIN folds f USING (dataset_id, row_id)),
fids AS (SELECT DISTINCT dataset_id, fold FROM folds),
part AS (SELECT dataset_id, fold, y, attr, count(*) AS n_f, sum(x) AS s1_f, sum(x * x) AS s2_f FROM xf GROUP BY 1, 2, 3, 4),
tot AS (SELECT dataset_id, y, attr, sum(n_f) AS n, sum(s1_f) AS s1, sum(s2_f) AS s2 FROM part GROUP BY 1, 2, 3),
train AS (SELECT t.dataset_id, fi.fold, t.y, t.attr, t.n - coalesce(p.n_f, 0) AS n,
                 t.s1 - coalesce(p.s1_f, 0) AS s1, t.s2 - coalesce(p.s2_f, 0) AS s2
          FROM tot t JOIN fids fi USING (dataset_id)
          LEFT JOIN part p ON p.dataset_id = t.dataset_id AND p.fold = fi.fold AND p.y = t.y AND p.attr = t.attr),
tr AS (SELECT *, s1 / n AS mu, greatest(s2 / n - (s1 / n) * (s1 / n), 0.0) AS var FROM train WHERE n > 0),
ov AS (SELECT dataset_id, fold, max(v) * 1e-9 AS eps FROM (
         SELECT dataset_id, fold, attr,
                greatest(sum(s2) / sum(n) - (sum(s1) / sum(n)) * (sum(s1) / sum(n)), 0.0) AS v
         FROM tr GROUP BY 1, 2, 3) o GROUP BY 1, 2),
cls AS (SELECT dataset_id, fold, y, ln(n_c / sum(n_c) OVER (PARTITION BY dataset_id, fold)) AS log_prior FROM (
          SELECT dataset_id, fold, y, max(n) AS n_c FROM tr GROUP BY 1, 2, 3) c),
st AS (SELECT tr.dataset_id, tr.fold, tr.y, tr.attr, tr.mu, tr.var + ov.eps AS var FROM tr JOIN ov USING (dataset_id, fold)),
ll AS (SELECT xf.dataset_id, xf.fold, xf.row_id, xf.y AS y_true, st.y,
              sum(-0.5 * ln(2 * pi()) - 0.5 * ln(st.var) - (xf.x - st.mu) * (xf.x - st.mu) / (2 * st.var)) AS ll
       FROM xf JOIN st ON st.dataset_id = xf.dataset_id AND st.fold = xf.fold AND st.attr = xf.attr
       GROUP BY 1, 2, 3, 4, 5),
post AS (SELECT ll.*, ll.ll + cls.log_prior AS post FROM ll JOIN cls USING (dataset_id, fold, y)),
pred AS (SELECT dataset_id, fold, row_id, y_true, arg_max(y, (post, y)) AS y_hat FROM post GROUP BY 1, 2, 3, 4),
acc AS (SELECT dataset_id, fold, avg(CAST(y_hat = y_true AS DOUBLE)) AS acc FROM pred GROUP BY 1, 2)
SELECT dataset_id, round(avg(acc), 10) AS value FROM acc GROUP BY 1"""

ORACLE["node_landmarkers"] = _CELLS + """,
folds AS (SELECT dataset_id, row_id, y, CAST('0x' || substr(md5(concat_ws(':', 3, row_id)), 1, 8) AS BIGINT) % 10 AS fold FROM labels),
x AS (SELECT c.dataset_id, c.row_id, c.attr, coalesce(c.num_val, m.m) AS x FROM cells c JOIN mu m USING (dataset_id, attr)
      WHERE NOT c.is_cat),
bd AS (SELECT dataset_id, attr, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1, 2),
bx AS (SELECT x.*, f.fold, f.y,
              CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 32), 31) ELSE 0 END AS bin
       FROM x JOIN bd USING (dataset_id, attr) JOIN folds f USING (dataset_id, row_id)),
fids AS (SELECT DISTINCT dataset_id, fold FROM folds),
part AS (SELECT dataset_id, fold, attr, bin, y, count(*) AS n_f FROM bx GROUP BY ALL),
tot AS (SELECT dataset_id, attr, bin, y, sum(n_f) AS n FROM part GROUP BY ALL),
train AS (SELECT t.dataset_id, fi.fold, t.attr, t.bin, t.y, t.n - coalesce(p.n_f, 0) AS n
          FROM tot t JOIN fids fi USING (dataset_id)
          LEFT JOIN part p ON p.dataset_id = t.dataset_id AND p.fold = fi.fold AND p.attr = t.attr
                          AND p.bin = t.bin AND p.y = t.y),
edges AS (SELECT range AS edge FROM range(0, 31)),
sides AS (SELECT t.dataset_id, t.fold, t.attr, t.y, e.edge,
                 sum(CASE WHEN t.bin <= e.edge THEN t.n ELSE 0 END) AS l, sum(t.n) AS tt
          FROM train t CROSS JOIN edges e GROUP BY ALL),
sp AS (SELECT dataset_id, fold, attr, edge, sum(l) AS nl, sum(l * l) AS sql, sum(tt - l) AS nr,
              sum((tt - l) * (tt - l)) AS sqr, arg_max(y, (l, y)) AS ly, arg_max(y, (tt - l, y)) AS ry
       FROM sides GROUP BY ALL),
split AS (SELECT *, (nl - sql / nl) + (nr - sqr / nr) AS imp FROM sp WHERE nl > 0 AND nr > 0),
attrs AS (SELECT dataset_id, attr, dense_rank() OVER (PARTITION BY dataset_id ORDER BY attr) AS ai
          FROM (SELECT DISTINCT dataset_id, attr FROM cells WHERE NOT is_cat) a),
pick AS (SELECT dataset_id, arg_min(attr, (CAST('0x' || substr(md5(concat_ws(':', 3 + dataset_id, ai)), 1, 8) AS BIGINT), attr)) AS attr
         FROM attrs GROUP BY 1),
cand AS (SELECT 'best_node' AS name, * FROM split
         UNION ALL SELECT 'random_node', s.* FROM split s JOIN pick p USING (dataset_id, attr)),
best AS (SELECT name, dataset_id, fold, arg_min((attr, edge, ly, ry), (imp, attr, edge)) AS s FROM cand GROUP BY ALL),
acc AS (SELECT b.name, b.dataset_id, b.fold,
               avg(CAST((CASE WHEN bx.bin <= b.s[2] THEN b.s[3] ELSE b.s[4] END) = bx.y AS DOUBLE)) AS acc
        FROM best b JOIN bx ON bx.dataset_id = b.dataset_id AND bx.fold = b.fold AND bx.attr = b.s[1]
        GROUP BY ALL)
SELECT dataset_id, name, round(avg(acc), 10) AS value FROM acc GROUP BY ALL"""


def _union(*names: str) -> str:
    return "\nUNION ALL\n".join(f"SELECT * FROM ({ORACLE[n]}) AS part_{i}" for i, n in enumerate(names))


ORACLE["mf_full"] = _union("mf_simple", "mf_class", "mf_moments", "mf_missing", "mf_categorical")
ORACLE["mf_basic"] = _union("mf_simple", "mf_class", "mf_moments")

ORACLE["learner_report"] = f"""
SELECT r.metalearner_name, r.regret_mean, r.regret_std, a.avg_rank, w.n_first
FROM ({ORACLE["regret_mean_std"]}) r
JOIN ({ORACLE["avg_ranks"]}) a USING (metalearner_name)
JOIN (SELECT metalearner_name, CAST(sum(CAST(position = 1 AS BIGINT)) AS BIGINT) AS n_first
      FROM ({ORACLE["learner_positions"]}) lp GROUP BY 1) w USING (metalearner_name)"""

# Fixed values from published tables: q at 0.05 for five learners (Nemenyi), and the normal deviate of a
# two-sided test at 0.05 over four comparisons (Bonferroni).
_Q5, _Z4 = 2.728, 2.4977

ORACLE["cd_groups"] = _PROCESSED + f""",
ranks AS (SELECT metalearner_name, round(avg(rank), 10) AS avg_rank FROM rk GROUP BY 1),
kn AS (SELECT (SELECT count(*) FROM ranks) AS k, (SELECT count(DISTINCT dataset_id) FROM p) AS n),
c AS (SELECT {_Q5} * sqrt(k * (k + 1) / (6.0 * n)) AS cd FROM kn),
r AS (SELECT metalearner_name, avg_rank, row_number() OVER (ORDER BY avg_rank, metalearner_name) AS pos FROM ranks),
e AS (SELECT a.*, a.pos - 1 + (SELECT count(*) FROM r b, c WHERE b.pos >= a.pos AND b.avg_rank - a.avg_rank < c.cd) AS run_end
      FROM r a),
s AS (SELECT *, coalesce(max(run_end) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_end
      FROM e),
st AS (SELECT pos AS start, run_end, row_number() OVER (ORDER BY pos) AS grp FROM s
       WHERE run_end > prev_end AND run_end > pos)
SELECT st.grp AS "group", st.start, r.metalearner_name, r.avg_rank, round(c.cd, 2) AS cd
FROM st JOIN r ON r.pos BETWEEN st.start AND st.run_end, c"""


def _encoding(one_hot_max: int) -> str:
    """Each held fold's statistics straight from the other folds' rows."""
    return _CELLS + f""",
folds AS MATERIALIZED (SELECT dataset_id, row_id, y, CAST('0x' || substr(md5(concat_ws(':', 3, row_id)), 1, 8) AS BIGINT) % 5 AS fold FROM labels),
f AS MATERIALIZED (SELECT c.*, fold, y FROM cells c JOIN folds USING (dataset_id, row_id)),
fids AS (SELECT DISTINCT dataset_id, fold AS held FROM folds),
train AS MATERIALIZED (SELECT f.*, held FROM f JOIN fids USING (dataset_id) WHERE fold <> held),
means AS MATERIALIZED (SELECT dataset_id, held, attr, coalesce(avg(num_val), 0.0) AS mean FROM train WHERE NOT is_cat GROUP BY ALL),
cats AS MATERIALIZED (SELECT dataset_id, held, attr, cat_val, count(*) AS n FROM train WHERE is_cat AND cat_val IS NOT NULL GROUP BY ALL),
kinds AS MATERIALIZED (
  SELECT dataset_id, held, attr, min(cat_val) AS first_cat, CASE WHEN count(*) <= 2 THEN 'ordinal' WHEN count(*) <= {one_hot_max} THEN 'one_hot' ELSE 'target' END AS kind
  FROM cats GROUP BY ALL),
ys AS (SELECT dataset_id, held, y, count(*) AS n FROM folds JOIN fids USING (dataset_id) WHERE fold <> held GROUP BY ALL),
classes AS MATERIALIZED (SELECT * FROM (SELECT dataset_id, held, y, n / sum(n) OVER w AS share, min(y) OVER w AS first_y FROM ys WINDOW w AS (PARTITION BY dataset_id, held)) WHERE y <> first_y),
names AS (
  SELECT dataset_id, held, attr, '' AS part FROM means UNION ALL SELECT dataset_id, held, attr, '' FROM kinds WHERE kind = 'ordinal'
  UNION ALL SELECT dataset_id, held, attr, cat_val FROM cats JOIN kinds USING (dataset_id, held, attr) WHERE kind = 'one_hot'
  UNION ALL SELECT dataset_id, held, attr, y FROM kinds JOIN classes USING (dataset_id, held) WHERE kind = 'target'),
pos AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY dataset_id, held ORDER BY attr, part) - 1 AS pos, count(*) OVER (PARTITION BY dataset_id, held) AS size FROM names),
x AS MATERIALIZED (SELECT dataset_id, fold AS held, row_id, attr, is_cat, num_val, cat_val FROM f),
shares AS MATERIALIZED (
  SELECT t.dataset_id, t.held, t.attr, t.cat_val, c.y, (count(*) FILTER (WHERE t.y = c.y) + c.share) / (count(*) + 1) AS share
  FROM train t JOIN classes c USING (dataset_id, held) WHERE is_cat AND cat_val IS NOT NULL GROUP BY t.dataset_id, t.held, t.attr, t.cat_val, c.y, c.share),
vals AS (
  SELECT x.dataset_id, x.held, row_id, attr, '' AS part, coalesce(num_val, mean) AS value FROM x JOIN means USING (dataset_id, held, attr) WHERE NOT is_cat
  UNION ALL
  SELECT x.dataset_id, x.held, row_id, x.attr, CASE kind WHEN 'one_hot' THEN cat_val ELSE '' END, CASE WHEN kind = 'one_hot' OR cat_val = first_cat THEN 1.0 ELSE 2.0 END
  FROM x JOIN kinds USING (dataset_id, held, attr) JOIN cats USING (dataset_id, held, attr, cat_val) WHERE kind <> 'target'
  UNION ALL
  SELECT x.dataset_id, x.held, row_id, x.attr, c.y, coalesce(s.share, c.share)
  FROM x JOIN kinds USING (dataset_id, held, attr) JOIN classes c USING (dataset_id, held)
  LEFT JOIN shares s ON s.dataset_id = x.dataset_id AND s.held = x.held AND s.attr = x.attr AND s.cat_val = x.cat_val AND s.y = c.y WHERE kind = 'target')
SELECT dataset_id, held, row_id, size, pos, round(value, 6) AS value FROM vals JOIN pos USING (dataset_id, held, attr, part) WHERE value <> 0"""


ORACLE["encoded_frame"] = _encoding(10)
ORACLE["encoded_target"] = _encoding(3)


_SIMILAR = """
pairs AS (
  SELECT q.dataset_id AS query_id, v.dataset_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS value
  FROM {source} q JOIN {source} v ON q.dataset_id <> v.dataset_id WHERE q.dataset_id % 20 = 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, dataset_id) AS rank FROM pairs) WHERE rank <= 5)"""
_LODO_SIMILAR = with_fixtures("evaluations", "vectors") + """,
e AS (SELECT * FROM evaluations WHERE metric = 'neg_log_loss'),
stored AS (SELECT * FROM vectors WHERE dataset_id IN (SELECT dataset_id FROM evaluations)),""" + _SIMILAR.format(source="stored") + """,
own AS (SELECT dataset_id AS held_out_id, pipeline_id, avg(score) AS heldout_score FROM e GROUP BY 1, 2)"""

ORACLE["similarity_many"] = with_fixtures("vectors") + "," + _SIMILAR.format(source="vectors") + """
SELECT query_id, rank, dataset_id, round(value, 8) AS value FROM near"""

ORACLE["lodo_top_similarity"] = _LODO_SIMILAR + """,
best AS (SELECT dataset_id, pipeline_id, row_number() OVER (PARTITION BY dataset_id ORDER BY max(score) DESC, pipeline_id) AS pos FROM e GROUP BY 1, 2),
sized AS (SELECT *, greatest(25 // count(*) OVER (PARTITION BY query_id), 1) AS c FROM near),
lists AS (SELECT query_id, rank AS sim_rank, dataset_id, pipeline_id, pos, (pos - 1) // c AS turn FROM sized JOIN best USING (dataset_id)),
firsts AS (SELECT query_id, pipeline_id, min(struct_pack(turn := turn, sim_rank := sim_rank, pos := pos, dataset_id := dataset_id)) AS f FROM lists GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f) AS rank FROM firsts)
SELECT query_id AS held_out_id, rank, pipeline_id, f.dataset_id AS dataset_id, round(heldout_score, 10) AS heldout_score
FROM top LEFT JOIN own ON held_out_id = query_id AND own.pipeline_id = top.pipeline_id WHERE rank <= 25"""
ORACLE["lodo_top_similarity"] = ORACLE["lodo_top_similarity"].replace("rank, pipeline_id, f.dataset_id", "rank, top.pipeline_id AS pipeline_id, f.dataset_id")

ORACLE["lodo_utility"] = _LODO_SIMILAR + """,
bounds AS (SELECT dataset_id, min(score) AS lo, max(score) AS hi FROM e GROUP BY 1),
u AS (SELECT e.dataset_id, pipeline_id, 1 - CASE WHEN hi > lo THEN (hi - score) / (hi - lo) ELSE 0.0 END AS u FROM e JOIN bounds USING (dataset_id)),
scored AS (SELECT query_id, pipeline_id, round(avg(round(value, 10) * u), 10) AS utility, count(*) AS n_evals FROM u JOIN pairs USING (dataset_id) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY utility DESC, pipeline_id) AS rank FROM scored)
SELECT query_id AS held_out_id, rank, top.pipeline_id AS pipeline_id, utility, n_evals, round(heldout_score, 10) AS heldout_score
FROM top LEFT JOIN own ON held_out_id = query_id AND own.pipeline_id = top.pipeline_id WHERE rank <= 25"""

ORACLE["signed_rank"] = _PROCESSED + f""",
d AS (SELECT o.metalearner_name, c.score - o.score AS d FROM p o JOIN p c USING (dataset_id) WHERE c.metalearner_name = 'view' AND o.metalearner_name <> 'view' AND c.score <> o.score),
r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY metalearner_name, abs(d)) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY metalearner_name, abs(d)) AS t
      FROM d WINDOW w AS (PARTITION BY metalearner_name ORDER BY abs(d))),
s AS (SELECT metalearner_name, count(*) AS n, coalesce(sum(rank) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(sum(rank) FILTER (WHERE d < 0), 0) AS w_minus, sum(t * t - 1) AS ties
      FROM r GROUP BY 1),
z AS (SELECT *, (w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2.0 * n + 1) / 24 - ties / 48.0) AS z FROM s)
SELECT metalearner_name, n, round(w_plus, 1) AS w_plus, round(w_minus, 1) AS w_minus, round(z, 8) AS z, abs(z) > {_Z4} AS differs FROM z"""


def _lodo_portfolio_sql(k: int) -> str:
    """Greedy picks of every held-out dataset from all other datasets' cells, one by one."""
    parts = [_MATRIX + """,
held AS (SELECT DISTINCT dataset_id AS held_out_id FROM m WHERE dataset_id % 20 = 0),
best1 AS MATERIALIZED (SELECT held_out_id, dataset_id, 1.0 AS best FROM held, (SELECT DISTINCT dataset_id FROM m) WHERE dataset_id <> held_out_id),
total AS (SELECT held_out_id, count(*) AS others FROM best1 GROUP BY 1),
pick0 AS (SELECT NULL AS held_out_id, NULL AS pipeline_id, NULL AS position, NULL AS gain WHERE false)"""]
    for i in range(1, k + 1):
        parts.append(f"""
gain{i} AS (
  SELECT held_out_id, pipeline_id, round(sum(greatest(best - regret, 0.0)), 10) AS gain FROM best{i} JOIN m USING (dataset_id)
  WHERE (held_out_id, pipeline_id) NOT IN (SELECT (held_out_id, pipeline_id) FROM pick{i - 1}) GROUP BY 1, 2),
pick{i} AS MATERIALIZED (
  SELECT * FROM pick{i - 1} UNION ALL
  SELECT held_out_id, pipeline_id, {i}, gain FROM (SELECT *, row_number() OVER (PARTITION BY held_out_id ORDER BY gain DESC, pipeline_id) AS nth FROM gain{i}) WHERE nth = 1),
best{i + 1} AS MATERIALIZED (
  SELECT held_out_id, dataset_id, least(best, coalesce(regret, 1.0)) AS best
  FROM best{i} JOIN (SELECT held_out_id, pipeline_id FROM pick{i} WHERE position = {i}) USING (held_out_id) LEFT JOIN m USING (dataset_id, pipeline_id))""")
    return ",".join(parts) + f"""
SELECT held_out_id, CAST(position AS BIGINT) AS position, pipeline_id, gain, round(others - sum(gain) OVER (PARTITION BY held_out_id ORDER BY position), 10) AS total_regret
FROM pick{k} JOIN total USING (held_out_id)"""


ORACLE["lodo_portfolio"] = _lodo_portfolio_sql(3)
