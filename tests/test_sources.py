"""Readers, writers and the metadatabase store on small files."""

import os

import pytest
from pyspark.sql import functions as F

from metalens.operators.store import UnknownKeyError
from metalens.sources import io
from metalens.sources.metastore import MetaStore


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_missing_file_raises(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        io.read_evaluations(spark, os.path.join(tmp_dir, "nope.parquet"))


def test_read_evaluations_csv_with_index(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "m.csv"), ",dataset_id,pipeline_id,score,metric\n0,1,2,-0.5,neg_log_loss\n1,1,3,NaN,neg_log_loss\n")
    df = io.read_evaluations(spark, p, fmt="csv")
    rows = df.orderBy("pipeline_id").collect()
    assert [r["pipeline_id"] for r in rows] == [2, 3]
    assert rows[1]["score"] is None and rows[0]["logs_name"] is None


def test_timing_log_and_gaps(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "t.txt"),
               "start at 2024-01-01 00:00:00.000000\n"
               "done 0 at 2024-01-01 00:00:01.500000\n"
               "done 1 at 2024-01-01 00:00:04.000000\n")
    df = io.read_timing_log(spark, p)
    from metalens.operators.sequence import gap_seconds
    g = gap_seconds(df.withColumn("k", F.lit(0)), "k", "line_no", "ts").orderBy("line_no").collect()
    assert [r["gap_seconds"] for r in g] == [None, 1.5, 2.5]


def test_evaluation_log_first_tuple_item(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "e.log"),
               "a;b;c;d;e;score\n1;x;y;z;3.5;(-0.25, 3, 'p')\n2;x;y;z;4.5;(-0.125, 1)\n")
    assert [r["score"] for r in io.read_evaluation_log(spark, p).collect()] == [-0.25, -0.125]


def test_read_arff(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "d.arff"),
               "% comment\n@relation r\n@attribute a numeric\n@attribute 'b c' {x,y}\n@attribute class {p,n}\n"
               "@data\n1.5,x,p\n?,y,n\n")
    df, names, nominal = io.read_arff(spark, p)
    assert names == ["a", "b c", "class"] and nominal == ["b c", "class"]
    rows = df.collect()
    assert rows[0]["a"] == 1.5 and rows[1]["a"] is None and rows[1]["class"] == "n"
    q = _write(os.path.join(tmp_dir, "q.arff"), "@relation r\n@attribute a string\n@attribute b string\n@attribute y {p,n}\n@data\n'why?',\"x, y?\",p\n?, ? ,n\n")
    assert [tuple(r) for r in io.read_arff(spark, q)[0].collect()] == [("why?", "x, y?", "p"), (None, None, "n")]
    x, y = io.split_features_target(df)
    assert x.columns == ["a", "b c"] and y.columns == ["class"]


def test_characterization_csv(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "c.csv"), "dataset_id,f1,f2\n1,0.5,2\n2,1.5,3\n")
    df = io.read_characterizations(spark, p, "basic")
    r = df.orderBy("dataset_id").first()
    assert r["values"] == [0.5, 2.0] and r["names"] == ["f1", "f2"] and r["method"] == "basic"


def test_store_results_drops_empty(spark, tmp_dir):
    out = io.store_results(spark, [(1, [0.1, None]), (2, [None])], "avg", os.path.join(tmp_dir, "res"))
    rows = out.collect()
    assert {r["dataset_id"] for r in rows} == {1}
    back = io.read_results(spark, os.path.join(tmp_dir, "res")).collect()
    assert len(back) == 2


def test_metastore_roundtrip(spark, tmp_dir):
    root = os.path.join(tmp_dir, "mdb")
    ms = MetaStore.create(spark, root)
    recs = spark.createDataFrame([("iris", "Tree(data)", -0.3, "neg_log_loss", "run1"),
                                  ("iris", "Bayes(data)", -0.2, "neg_log_loss", "run1"),
                                  ("wine", "Tree(data)", -0.5, "neg_log_loss", "run1")],
                                 "dataset string, pipeline string, score double, metric string, logs_name string")
    added = ms.add_evaluations(recs)
    assert added.count() == 3
    assert ms.get_dataset_id("wine") == 1 and ms.get_pipeline_id("Tree(data)") == 1
    with pytest.raises(ValueError):
        ms.add_evaluations(recs)  # same run name again
    more = spark.createDataFrame([("wine", "Forest(data)", -0.4, "neg_log_loss", "run2")], recs.schema)
    ms.add_evaluations(more)
    assert ms.get_pipeline_id("Forest(data)") == 2
    assert ms.evaluations().filter(F.col("metric") == "neg_log_loss").count() == 4
    chars = spark.createDataFrame([(0, [1.0, 2.0], ["a", "b"]), (1, [3.0, 4.0], ["a", "b"])],
                                  "dataset_id long, values array<double>, names array<string>")
    ms.add_dataset_characterizations("simple", chars)
    with pytest.raises(ValueError):
        ms.add_dataset_characterizations("simple", chars)
    got = ms.get_dataset_characterizations("simple", [1, 0, 1]).collect()
    assert [r["dataset_id"] for r in got] == [1, 0, 1]
    with pytest.raises(UnknownKeyError):
        ms.get_dataset_characterizations("simple", [7])
    assert ms.list_dataset_characterizations().first()["n"] == 2


def test_read_lookup_with_index_and_quoted_names(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "lp.csv"),
               ',pipeline,pipeline_id\n0,"Tree(data, Tree.depth=3)",0\n1,"Bayes(Scaler(data), Bayes.alpha=1)",1\n')
    rows = io.read_lookup(spark, p, "pipelines").orderBy("pipeline_id").collect()
    assert [r["pipeline"] for r in rows] == ["Tree(data, Tree.depth=3)", "Bayes(Scaler(data), Bayes.alpha=1)"]
    assert [r["pipeline_id"] for r in rows] == [0, 1]


def test_metastore_lookups_and_run_top(spark, tmp_dir):
    ms = MetaStore.create(spark, os.path.join(tmp_dir, "mdb2"))
    recs = spark.createDataFrame(
        [("iris", f"P{i}(data)", -0.1 * i, "neg_log_loss", "runA") for i in range(6)],
        "dataset string, pipeline string, score double, metric string, logs_name string")
    added = ms.add_run_top(recs, 3)
    assert sorted(r["pipeline_id"] for r in added.collect()) == [0, 1, 2]
    assert {r["pipeline"] for r in ms.list_pipelines("name").collect()} == {"P0(data)", "P1(data)", "P2(data)"}
    assert ms.list_datasets("id").collect()[0]["dataset_id"] == 0
    assert ms.dataset_exists("iris") and not ms.dataset_exists("wine")
    assert ms.pipe_exists("P1(data)") and not ms.pipe_exists("P5(data)")
    with pytest.raises(UnknownKeyError):
        ms.get_pipeline_id("P5(data)")


def test_metastore_selections_views_and_listings(spark, tmp_dir):
    ms = MetaStore.create(spark, os.path.join(tmp_dir, "mdb3"))
    rows = [("iris", f"P{i}(data)", -0.1 * i, "neg_log_loss", "runA") for i in range(4)]
    rows += [("wine", "P1(data)", -0.7, "neg_log_loss", "runA"), ("iris", "P3(data)", -0.5, "neg_log_loss", "runA"), ("iris", "P0(data)", 0.9, "accuracy", "runA")]
    ms.add_evaluations(spark.createDataFrame(rows, "dataset string, pipeline string, score double, metric string, logs_name string"))
    iris, p3 = ms.get_dataset_id("iris"), ms.get_pipeline_id("P3(data)")
    assert ms.get_df(datasets=["iris"], metrics=["neg_log_loss"]).count() == 5
    assert ms.get_df(datasets=[iris], pipelines=["P1(data)", p3]).count() == 3
    mean = ms.get_df(datasets=[iris], pipelines=[p3], avg_equivalent=True).collect()
    assert [round(r["score"], 9) for r in mean] == [-0.4]
    best = ms.get_df(metrics=["neg_log_loss"], top_n=2).orderBy("dataset_id", "position").collect()
    assert [(r["dataset_id"], round(r["score"], 9), r["position"]) for r in best if r["dataset_id"] == iris] == [(iris, 0.0, 1), (iris, -0.1, 2)]
    with pytest.raises(UnknownKeyError):
        ms.get_df(datasets=["nowhere"])
    chars = spark.createDataFrame([(d, [1.0], ["a"]) for d in (0, 1)], "dataset_id long, values array<double>, names array<string>")
    ms.add_dataset_characterizations("simple", chars)
    ms.add_dataset_characterizations("other", chars.filter("dataset_id = 1"))
    ms.add_pipeline_characterizations("bits", spark.createDataFrame([(p3, ["1"], ["a"])], "pipeline_id long, values array<string>, names array<string>"))
    assert {(r["method"], r["n"]) for r in ms.list_dataset_characterizations().collect()} == {("simple", 2), ("other", 1)}
    assert [(r["method"], list(r["ids"])) for r in ms.list_dataset_characterizations(methods=["simple"], ids=[0]).collect()] == [("simple", [0])]
    assert [(r["method"], list(r["ids"])) for r in ms.list_pipeline_characterizations().collect()] == [("bits", [p3])]
    view = ms.view(spark.createDataFrame([(iris,)], "dataset_id long"))
    assert view.evaluations.count() == 6 and view.datasets.count() == 1 and view.pipelines.count() == 4
    _write(os.path.join(tmp_dir, f"{iris}.arff"), "@relation r\n@attribute a numeric\n@attribute y {p,n}\n@data\n1,p\n2,n\n")
    x, y = ms.get_dataset(tmp_dir, iris)
    assert x.columns == ["a"] and [r["y"] for r in y.collect()] == ["p", "n"]
    with pytest.raises(UnknownKeyError):
        ms.get_dataset(tmp_dir, 99)
