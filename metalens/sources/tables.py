"""Driver tables and the stand-in tables derived from them.

The stand-ins are defined once, as SQL text that runs unchanged in Spark SQL
and in DuckDB. Spark binds the table names to parquet paths; the oracle uses
the same text as CTEs over DuckDB's pre-registered views. Keeping a single
definition means the two engines always see identical inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Stand-in definitions shared with the test-data notes.
FIXTURE_SQL: dict[str, str] = {
    "evaluations": """
SELECT o_orderkey AS eval_id, o_custkey AS dataset_id,
       (o_orderkey * 7 + o_custkey) % (SELECT count(*) FROM part) AS pipeline_id,
       -o_totalprice / 1e6 AS score,
       CASE WHEN o_orderstatus IN ('F', 'O') THEN 'neg_log_loss' ELSE 'accuracy' END AS metric,
       concat('d', CAST(o_custkey AS varchar(20)), '_',
              CASE o_orderkey % 3 WHEN 0 THEN 'AsyncEA' WHEN 1 THEN 'RandomSearch'
                   ELSE 'AsynchronousSuccessiveHalving' END) AS logs_name
FROM orders""",
    "vectors": """
SELECT vec_id AS dataset_id, embedding FROM embeddings""",
    "samples": """
SELECT c_nationkey AS dataset_id, o_orderkey AS row_id,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS num_total,
       c_acctbal AS num_bal, o_orderpriority AS cat_prio,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE c_mktsegment END AS cat_seg,
       o_orderstatus AS y
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "pipelines": """
SELECT p_partkey AS pipeline_id,
       CASE WHEN p_partkey % 3 = 0
            THEN concat('Tree(data, Tree.depth=', CAST(p_size AS varchar(20)), ')')
            WHEN p_partkey % 3 = 1
            THEN concat('Bayes(Scaler(data), Bayes.alpha=', CAST(p_size AS varchar(20)), ')')
            ELSE concat('Forest(Pca(data, Pca.k=', CAST(p_size AS varchar(20)), '), Forest.n=10)')
       END AS pipeline
FROM part""",
    "results": """
SELECT event_type AS metalearner_name, user_id AS dataset_id,
       row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS slot,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE -value / 100 END AS score
FROM events""",
    "run_log": """
SELECT user_id AS run_id, event_id AS eval_no, ts, -value / 100 AS score FROM events""",
    "probs": """
SELECT o_orderkey AS row_id, o_orderstatus AS y_true, (1 + o_custkey % 97) / 1e2 AS p_true FROM orders""",
}

_TABLE_REF = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(DRIVER_TABLES) + r")\b")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(table_path(sf_dir, name))


def bind_sql(sql: str, sf_dir: str) -> str:
    """Point driver-table names in ``sql`` at their parquet files."""
    return _TABLE_REF.sub(
        lambda m: f"{m.group(1)} parquet.`{table_path(sf_dir, m.group(2))}` AS {m.group(2)}", sql)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table as a lazy DataFrame over the driver parquet."""
    return spark.sql(bind_sql(FIXTURE_SQL[name], sf_dir))


def with_fixtures(*names: str) -> str:
    """``WITH`` prefix defining the named stand-ins, for oracle SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in names) + "\n"
