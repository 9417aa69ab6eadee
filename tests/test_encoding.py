"""Fold-wise encoding: nothing of the held-out rows enters it."""

import pytest
from pyspark.sql import functions as F

from metalens.operators import encoding, modeling

CELLS = "dataset_id long, row_id long, attr string, is_cat boolean, num_val double, cat_val string"
LABELS = "dataset_id long, row_id long, y string, fold long"


def rows(change_fold=None):
    """20 rows of dataset 1; with ``change_fold`` that fold's cells and labels are others altogether."""
    cells, labels = [], []
    for i in range(20):
        fold = i % 4
        odd = fold == change_fold
        labels.append((1, i, "other" if odd else ("a", "b", "c")[i % 3], fold))
        cells += [(1, i, "num", False, 1000.0 if odd else (None if i % 5 == 0 else float(i)), None),
                  (1, i, "two", True, None, "new" if odd else "xy"[i % 2]),
                  (1, i, "few", True, None, f"new{i}" if odd else (None if i == 3 else f"c{i % 3}")),
                  (1, i, "many", True, None, f"other{i}" if odd else f"m{i % 7}")]
    return cells, labels


def encode(spark, cells, labels, held=None, **options):
    frame = encoding.Encoding(spark.createDataFrame(cells, CELLS), spark.createDataFrame(labels, LABELS), held, **options)
    return frame, {(r.held, r.row_id): r for r in frame.encoded().collect()}


@pytest.mark.parametrize("one_hot_max", [3, 10])
def test_held_out_rows_do_not_change_the_encoding(spark, one_hot_max):
    plain, of_rows = encode(spark, *rows(), held=[2], one_hot_max=one_hot_max)
    changed, of_changed = encode(spark, *rows(2), held=[2], one_hot_max=one_hot_max)
    assert sorted(plain.columns.collect()) == sorted(changed.columns.collect())
    train = [k for k, r in of_rows.items() if not r.in_test]
    assert len(train) == 15 and all(of_rows[k] == of_changed[k] for k in train)
    # what only the changed rows have is unseen: zeros, or the shares of all training rows
    columns = {(r.attr, r.part): r.pos for r in changed.columns.collect()}
    test = dict(next(r for r in of_changed.values() if r.in_test).entries)
    assert test[columns["num", ""]] == 1000.0 and columns["two", ""] not in test
    if one_hot_max == 3:
        ys = [y for _, _, y, f in rows()[1] if f != 2]
        assert test[columns["many", "b"]] == pytest.approx(ys.count("b") / len(ys))


def test_values_by_kind(spark):
    cells, labels = rows()
    frame, got = encode(spark, cells, labels, held=[0], one_hot_max=3)
    columns = {(r.attr, r.part): r.pos for r in frame.columns.collect()}
    assert sorted(columns) == [("few", "c0"), ("few", "c1"), ("few", "c2"), ("many", "b"), ("many", "c"), ("num", ""), ("two", "")]
    of = {r.row_id: dict(r.entries) for r in got.values()}
    train = [i for i in range(20) if i % 4]
    known = [float(i) for i in train if i % 5]
    assert of[5][columns["num", ""]] == pytest.approx(sum(known) / len(known)) and of[7][columns["num", ""]] == 7.0
    assert of[1][columns["two", ""]] == 2.0 and of[2][columns["two", ""]] == 1.0
    assert of[1].get(columns["few", "c1"]) == 1.0 and all(columns["few", c] not in of[3] for c in ("c0", "c1", "c2"))
    m = [i for i in train if i % 7 == 1]
    prior = sum(i % 3 == 1 for i in train) / len(train)
    assert of[1][columns["many", "b"]] == pytest.approx((sum(i % 3 == 1 for i in m) + prior) / (len(m) + 1))


def test_each_row_by_its_own_fold_and_missing_labels(spark):
    cells, labels = rows()
    labels[4] = (1, 4, None, 0)
    cells += [(2, 0, "num", False, None, None), (2, 0, "few", True, None, None)]
    labels += [(2, 0, "a", 0)]
    _, got = encode(spark, cells, labels)
    assert len(got) == 20 and all(r.in_test for r in got.values())  # dataset 2 shares the key (0, 0)
    frame = encoding.Encoding(spark.createDataFrame(cells, CELLS), spark.createDataFrame(labels, LABELS))
    alone = frame.encoded().filter("dataset_id = 2").collect()
    assert [(r.size, r.entries) for r in alone] == [(2, [])]  # no training row at all: two constant columns
    assert encode(spark, [], [])[1] == {}


def test_vectors_are_sparse_and_hold_the_entries(spark):
    frame, got = encode(spark, *rows(), held=[1])
    for r in encoding.with_vectors(frame.encoded()).collect():
        assert {int(i): r.features[int(i)] for i in range(r.features.size) if r.features[int(i)]} == dict(got[r.held, r.row_id].entries)
        assert r.features.size == r.size


def test_recommended_pipelines_are_scored_on_encoded_splits(spark):
    cells, labels = rows()
    cells, labels = spark.createDataFrame(cells, CELLS), spark.createDataFrame(labels, LABELS).drop("fold")
    frame = modeling.encoded_splits(cells, labels, 1, folds=2)
    assert {(r.held, r.in_test) for r in frame.select("held", "in_test").distinct().collect()} == {(h, t) for h in (0, 1) for t in (True, False)}
    assert frame.count() == 40
    steps = spark.createDataFrame([(1, 1, 1, "Tree"), (2, 1, 1, "Pca"), (2, 2, 2, "Tree"), (3, 1, 1, "Tree")], "pipeline_id long, pos int, step_no int, algorithm string")
    params = spark.createDataFrame([(1, 1, "depth", "2"), (2, 1, "k", "99"), (3, 1, "depth", "99")], "pipeline_id long, step_no int, param string, value string")
    out = {r.pipeline_id: r.neg_log_loss for r in modeling.score_recommendations(spark, [1, 2, 3], frame, steps, params).collect()}
    assert out[1] is not None and out[1] <= 0 and out[2] is None and out[3] is None
    one = modeling.encoded_splits(cells, labels, 1)
    assert one.count() == 20 and {r.held for r in one.collect()} == {0}


def test_values_that_no_stage_has_raise():
    with pytest.raises(ValueError):
        modeling.build_pipeline([("Tree", {"depth": "99"})], 3)
    with pytest.raises(ValueError):
        modeling.build_pipeline([("Pca", {"k": "9"})], 2)
