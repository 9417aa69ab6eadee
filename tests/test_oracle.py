"""Every registered query against its DuckDB oracle on the driver tables (sf0.001)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from metalens.plans.queries import REGISTRY
from metalens.sources.tables import DRIVER_TABLES, table_path

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {k: v for k, v in entry.queries().items() if k in REGISTRY}  # the training-data queries have tests of their own
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in REGISTRY}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)  # exact: both sides round in SQL
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_DIR, t)}')")
    return con


def test_every_query_has_an_oracle_or_is_listed():
    no_oracle = set(QUERIES) - set(ORACLE)
    # Model fits and p-values have no SQL equivalent; they are checked in unit tests.
    assert no_oracle <= {"rankml_topk", "rankml_pairwise", "fit_score_recommended", "kfold_score_recommended",
                         "pca_landmarkers", "lda_landmarker", "tree_landmarker"}, no_oracle


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["rank", "pipeline_id", "ranking_score", "n_evals"]
    assert df.count() >= 0


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLE[name])
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    for f in df.schema.fields:
        spark_type = f.dataType.simpleString()
        assert SPARK_TO_DUCK.get(spark_type, spark_type) == types.get(f.name), (f.name, spark_type, types.get(f.name))
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert _canon(df.columns, rows) == _canon(dcols, drows)
