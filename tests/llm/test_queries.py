import hashlib
import inspect
import zlib

import duckdb
import pytest
from llm_brute import contamination, fingerprint, quality, simhash, substring, words

import __spark_entry__ as entry
import corpus_pipeline
from metalens.llm import queries
from metalens.llm.common import written
from metalens.llm.oracle import ORACLE
from metalens.sources.tables import DRIVER_TABLES, table, table_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(ORACLE[name]).to_arrow_table()
    assert sorted(want.column_names) == columns
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    assert rows == sorted((tuple(r[c] for c in columns) for r in want.to_pylist()), key=str)


def test_each_operator_has_one_registered_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(ORACLE) <= set(entry.oracle_sql())


def test_simhash_query_equals_brute_force(spark, documents):
    want = simhash(documents)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", c) for (i, _), (f, c) in want.items()}
    assert fingerprint(None) == 0


def test_toxicity_query_learns_from_the_other_rows(spark, documents):
    out = queries.op3_toxicity(spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted for r in held if r.toxic) > 0.85 * sum(r.toxic for r in held)
    assert sum(r.predicted for r in held if not r.toxic) < 0.03 * sum(1 - r.toxic for r in held)


def test_quality_model_query_keeps_good_documents(spark):
    out = queries.op10_quality_model(spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert sum(r.kept for r in held if r.quality) > 0.99 * sum(r.quality for r in held)
    assert sum(not r.kept for r in held if not r.quality) > 0.9 * sum(1 - r.quality for r in held)


def test_pipeline_equals_brute_force_stage_by_stage(spark, duck, documents):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "best_fit_packing"]
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    docs = table(spark, SF, "documents")
    columns, rows = docs.columns, documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if stage is corpus_pipeline.quality:
            base = {i for i, t in rows if not quality(t)[5]}
            assert set(got) <= base and len(got) > 0.9 * len(base)
            verdict = dict(duck.execute(f"SELECT doc_id, kept FROM ({ORACLE['op5_quality_rules']})").fetchall())
            assert set(got) == {i for i, _ in rows if verdict[i]}
        elif stage is corpus_pipeline.near_dedup:
            assert set(got) == {c for _, c in simhash(rows).values()}
        elif stage is corpus_pipeline.substring_dedup:
            for (i, t), (n, removed, digest) in substring(rows).items():
                assert got[i] == t if not removed else hashlib.sha256(got[i].encode()).hexdigest() == digest and len(words(got[i])) == n - removed
        else:
            assert set(got) == {i for i, t in rows if not contamination(t, items)[1]}
        rows = list(got.items())
    pieces = corpus_pipeline.best_fit_packing(spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in rows}
    whole = corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()
    assert sorted(whole) == sorted(tuple(r)[:5] for r in pieces)
