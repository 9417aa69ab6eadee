"""Hand-made tables for each reference defect that must not be copied, and properties."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from metalens.functions.regret import normalized_regret, valid_score
from metalens.operators import analysis, store
from metalens.operators.portfolio import greedy_portfolio
from metalens.operators.sequence import gap_seconds, running_max
from metalens.plans import recommend
from metalens.plans.lodo import lodo_average_regret

EVAL_DDL = "eval_id long, dataset_id long, pipeline_id long, score double, metric string, logs_name string"


def test_average_equivalent_keeps_groups_of_three(spark):
    rows = [(1, 1, 7, 0.1, "m", "a"), (2, 1, 7, 0.2, "m", "b"), (3, 1, 7, 0.6, "m", "c"),
            (4, 1, 7, 0.6, "m", "c")]  # last is an exact duplicate of the third
    out = store.average_equivalent(spark.createDataFrame(rows, EVAL_DDL)).collect()
    assert len(out) == 1
    assert out[0]["score"] == pytest.approx(0.3)
    assert out[0]["logs_name"] == "a" and out[0]["n_records"] == 3


def test_regret_zero_when_all_scores_equal(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0)], "s double, lo double, hi double")
    assert df.select(normalized_regret("s", "lo", "hi")).first()[0] == 0.0


def test_nan_score_is_not_valid(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,), (2e6,)], "score double")
    assert df.filter(valid_score("score")).count() == 1


def test_top_n_tie_at_cut_uses_pipeline_id(spark):
    rows = [(1, 0, 5, 0.9, "m", "r"), (2, 0, 3, 0.5, "m", "r"), (3, 0, 2, 0.5, "m", "r")]
    out = store.top_n_per_dataset(spark.createDataFrame(rows, EVAL_DDL), 2, "m").collect()
    assert sorted(r["pipeline_id"] for r in out) == [2, 5]


def test_new_ids_continue_after_max_without_collision(spark):
    lookup = spark.createDataFrame([("a", 0), ("b", 4)], "pipeline string, pipeline_id long")
    names = spark.createDataFrame([("b",), ("d",), ("c",), ("d",)], "pipeline string")
    out = {r[0]: r[1] for r in store.assign_new_ids(lookup, names, "pipeline", "pipeline_id").collect()}
    assert out == {"c": 5, "d": 6}


def _brute_portfolio(cells, datasets, cands, k):
    best = {d: 1.0 for d in datasets}
    picks = []
    for _ in range(k):
        top = None
        for p in sorted(c for c in cands if c not in picks):
            gain = sum(max(0.0, best[d] - cells.get((d, p), 1.0)) for d in datasets)
            gain = round(gain, 10)
            if top is None or gain > top[1]:
                top = (p, gain)
        picks.append(top[0])
        for d in datasets:
            best[d] = min(best[d], cells.get((d, top[0]), 1.0))
    return picks, sum(best.values())


def test_portfolio_matches_brute_force_and_is_monotone(spark):
    rnd = random.Random(3)
    datasets, cands = list(range(6)), list(range(10))
    cells = {(d, p): round(rnd.random(), 3) for d in datasets for p in cands if rnd.random() < 0.6}
    m = spark.createDataFrame([(d, p, r) for (d, p), r in cells.items()],
                              "dataset_id long, pipeline_id long, regret double")
    out = greedy_portfolio(m, 4).orderBy("position").collect()
    picks, total = _brute_portfolio(cells, sorted({d for d, _ in cells}), sorted({p for _, p in cells}), 4)
    assert [r["pipeline_id"] for r in out] == picks
    assert out[-1]["total_regret"] == pytest.approx(total)
    totals = [r["total_regret"] for r in out]
    assert all(a >= b for a, b in zip(totals, totals[1:]))


def test_ranks_sum_per_dataset(spark):
    rows = [("a", 1, 0.5), ("b", 1, 0.5), ("c", 1, 0.1), ("a", 2, 0.3), ("b", 2, 0.2), ("c", 2, 0.9)]
    df = spark.createDataFrame(rows, "metalearner_name string, dataset_id long, score double")
    ranked = analysis.tie_averaged_rank(df, "dataset_id", "score")
    sums = {r[0]: r[1] for r in ranked.groupBy("dataset_id").agg(F.sum("rank")).collect()}
    assert sums == {1: 6.0, 2: 6.0}
    ranks = {(r["metalearner_name"], r["dataset_id"]): r["rank"] for r in ranked.collect()}
    assert ranks[("a", 1)] == 1.5 and ranks[("c", 1)] == 3.0


def test_friedman_against_hand_computation(spark):
    rows = [(l, d, float(s)) for d, scores in enumerate([[3, 2, 1], [3, 1, 2], [2, 3, 1], [3, 2, 1]])
            for l, s in zip("abc", scores)]
    df = spark.createDataFrame(rows, "metalearner_name string, dataset_id long, score double")
    r = analysis.friedman_test(df).first()
    # ranks (best = 1): a: 1,1,2,1 -> 5; b: 2,3,1,2 -> 8; c: 3,2,3,3 -> 11
    n, k = 4, 3
    stat = 12 / (n * k * (k + 1)) * (25 + 64 + 121) - 3 * n * (k + 1)
    assert r["statistic"] == pytest.approx(stat)
    assert r["p_value"] == pytest.approx(math.exp(-stat / 2))  # chi2 with 2 dof


def test_chi2_sf_known_values():
    assert analysis.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert analysis.chi2_sf(7.814727903251178, 3) == pytest.approx(0.05, abs=1e-9)
    assert analysis.chi2_sf(2.0, 2) == pytest.approx(math.exp(-1.0))
    assert analysis.chi2_sf(40.0, 3) < 1e-7


def test_running_max_and_gaps_across_blocks(spark):
    rnd = random.Random(5)
    rows = [(r, i, rnd.random(), 1000 * i + rnd.randint(0, 999)) for r in range(3) for i in rnd.sample(range(100), 40)]
    df = spark.createDataFrame(rows, "run_id long, eval_no long, score double, t long") \
        .withColumn("ts", F.timestamp_seconds("t"))
    got = {(r["run_id"], r["eval_no"]): r["best_so_far"] for r in running_max(df, "run_id", "eval_no", "score", block_size=7).collect()}
    gaps = {(r["run_id"], r["eval_no"]): r["gap_seconds"] for r in gap_seconds(df, "run_id", "eval_no", "ts", block_size=7).collect()}
    for run in range(3):
        seq = sorted((i, s, t) for r, i, s, t in rows if r == run)
        best, prev = -1.0, None
        for i, s, t in seq:
            best = max(best, s)
            assert got[(run, i)] == best
            assert gaps[(run, i)] == (None if prev is None else float(t - prev))
            prev = t


def test_lodo_never_uses_held_out_rows(spark):
    rnd = random.Random(11)
    rows = [(i, d, p, -rnd.random(), "m", "r") for i, (d, p) in
            enumerate((d, p) for d in range(5) for p in range(8) if rnd.random() < 0.8)]
    ev = spark.createDataFrame(rows, EVAL_DDL)
    pipes = spark.createDataFrame([(p,) for p in range(9)], "pipeline_id long")
    got = lodo_average_regret(ev, pipes, k=3, min_evals=2, metric="m")
    # brute force per held-out dataset
    for h in range(5):
        rest = ev.filter(F.col("dataset_id") != h)
        off = recommend.average_regret_offline(rest, pipes, "m")
        want = [r["pipeline_id"] for r in recommend.average_regret_online(off, 3, 2).orderBy("rank").collect()]
        mine = [r["pipeline_id"] for r in got.filter(F.col("held_out_id") == h).orderBy("rank").collect()]
        assert mine == want
    # changing the held-out dataset's own scores changes nothing for it
    changed = ev.withColumn("score", F.when(F.col("dataset_id") == 0, -F.col("score") * 3).otherwise(F.col("score")))
    a = got.filter("held_out_id = 0").select("rank", "pipeline_id").collect()
    b = lodo_average_regret(changed, pipes, 3, 2, "m").filter("held_out_id = 0").select("rank", "pipeline_id").collect()
    assert a == b


def test_similarity_symmetry_and_self(spark):
    from metalens.functions import vectors as V
    from metalens.operators.similarity import one_vs_all
    vecs = [(i, [float(x) for x in v]) for i, v in enumerate(itertools.islice(
        ([1, 2, 3], [2, 0, 1], [0, 1, 1], [5, 5, 0]), 4))]
    df = spark.createDataFrame(vecs, "dataset_id long, embedding array<double>")
    q = df.filter("dataset_id = 0")
    sims = {r["dataset_id"]: r for r in one_vs_all(df, q).collect()}
    assert sims[0]["cosine"] == pytest.approx(1.0) and sims[0]["euclidean"] == 0.0
    pair = df.alias("a").join(df.alias("b"), F.col("a.dataset_id") < F.col("b.dataset_id")).select(
        V.cosine_similarity("a.embedding", "b.embedding").alias("ab"),
        V.cosine_similarity("b.embedding", "a.embedding").alias("ba"))
    for r in pair.collect():
        assert r["ab"] == pytest.approx(r["ba"])
    q1 = df.filter("dataset_id = 1")
    assert {r["dataset_id"]: r["cosine"] for r in one_vs_all(df, q1).collect()}[0] == pytest.approx(sims[1]["cosine"])


def test_shape_mismatch_and_several_query_rows_are_errors(spark):
    from metalens.operators.similarity import most_similar, one_vs_all
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0]), (2, [1.0])], "dataset_id long, embedding array<double>")
    q = df.filter("dataset_id = 0")
    assert one_vs_all(q, q).first()["cosine"] == pytest.approx(1.0)
    for other in (1, 2):
        with pytest.raises(Exception, match="vector length differs"):
            most_similar(one_vs_all(df.filter(f"dataset_id = {other}"), q), 1).collect()
    for query in (df, df.limit(0)):
        with pytest.raises(ValueError):
            one_vs_all(df, query)


def test_seeds_batches_and_datasets_draw_differently(spark):
    from metalens.functions.hashing import seeded_hash
    from metalens.operators.landmarkers import hash_folds
    from metalens.operators.subtables import sample_rows
    from metalens.operators.views import holdout_split
    rows = spark.range(2000).select(F.lit(1).cast("long").alias("dataset_id"), F.col("id").alias("row_id"), F.lit("a").alias("y"))
    picks = {b: {r["row_id"] for r in sample_rows(rows, 3, 5).filter(F.col("batch") == b).collect()} for b in range(3)}
    assert all(len(p) == 256 for p in picks.values())
    assert all(len(picks[a] & picks[b]) < 80 for a in range(3) for b in range(a))  # chance alone gives about 33
    train = {s: {r["row_id"] for r in holdout_split(rows, "row_id", 0.8, s).filter("is_train").collect()} for s in (0, 7)}
    assert all(1500 < len(t) < 1700 for t in train.values()) and len(train[0] & train[7]) < 1400
    folds = {s: {r["row_id"]: r["fold"] for r in hash_folds(rows, 4, s).collect()} for s in (0, 3)}
    pairs = {(folds[0][i], folds[3][i]) for i in range(2000)}
    assert len(pairs) == 16  # no relabelling of the same folds
    ai = spark.range(1, 40).select(seeded_hash(F.lit(0), F.lit(3) + F.col("id")).alias("a"), seeded_hash(F.lit(1), F.lit(3) + F.col("id")).alias("b"))
    first = [r["a"] < r["b"] for r in ai.collect()]
    assert 5 < sum(first) < 35  # no attribute wins in every dataset


def test_unusable_scores_leave_others_alone(spark):
    from metalens.plans.recommend import with_regret
    rows = [(1, 1, -1.0), (1, 2, -3.0), (1, 3, float("nan")), (1, 4, float("-inf")), (1, 5, None), (1, 6, 2e6), (1, 7, -2.0)]
    ev = spark.createDataFrame([(d, p, s, "m") for d, p, s in rows], "dataset_id long, pipeline_id long, score double, metric string")
    got = {r["pipeline_id"]: r["regret"] for r in with_regret(ev, "m").collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 1.0, 6: 1.0, 7: 0.5}


PARSED = {
    "Forest(Poly(Poly(ord-enc(data), Poly.degree=2), Poly.degree=3), alpha=0.1, Forest.layers=(100, 50), Forest.n='a b')": (
        [("Poly", 1), ("Poly", 2), ("Forest", 3)],
        [(1, "Poly", "degree", "2"), (2, "Poly", "degree", "3"), (3, "Forest", "alpha", "0.1"), (3, "Forest", "layers", "(100, 50)"), (3, "Forest", "n", "'a b'")]),
    "Tree(oh-enc(imputation(data)), max_depth=5)": ([("Tree", 2)], [(2, "Tree", "max_depth", "5")]),
    "Tree(data)": ([("Tree", 0)], []),
}


def test_pipelines_with_repeated_dropped_and_unprefixed_parts(spark):
    from metalens.operators.configs import parse_params, parse_steps, step_text
    pipes = spark.createDataFrame(list(enumerate(PARSED)), "pipeline_id long, pipeline string")
    steps, params = parse_steps(pipes), parse_params(pipes)
    for i, (want_steps, want_params) in enumerate(PARSED.values()):
        own = steps.filter(f"pipeline_id = {i}").orderBy("pos").collect()
        assert [(r["algorithm"], r["step_no"]) for r in own] == want_steps and [r["pos"] for r in own] == list(range(len(own)))
        got = params.filter(f"pipeline_id = {i}").orderBy("step_no", "param").collect()
        assert [(r["step_no"], r["algorithm"], r["param"], r["value"]) for r in got] == want_params
    text = {(r["pipeline_id"], r["pos"]): r["text"] for r in step_text(steps, params).collect()}
    assert text[0, 0] == "Poly(degree=2)" and text[0, 1] == "Poly(degree=3)" and text[0, 2] == "Forest(alpha=0.1, layers=(100, 50), n='a b')"


def test_grid_fill_of_a_missing_pair(spark):
    from metalens.operators.analysis import processed_scores, regret_summary
    rows = [("a", 1, 1, -1.0), ("a", 2, 1, -2.0), ("b", 1, 1, -3.0), ("a", 1, 26, 5.0)]
    res = spark.createDataFrame(rows, "metalearner_name string, dataset_id long, slot int, score double")
    got = {(r["metalearner_name"], r["dataset_id"]): (r["score"], r["filled"]) for r in processed_scores(res, 5).collect()}
    assert got["b", 2] == (pytest.approx(-2.01), True) and got["b", 1] == (-3.0, False)
    assert {r["metalearner_name"] for r in regret_summary(res, 25).collect()} == {"a", "b"}


def test_log_loss_with_absent_class(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.25)], "row_id long, y_true string, p_true double")
    r = analysis.log_loss(df).first()
    assert r["log_loss"] == pytest.approx(-(math.log(0.5) + math.log(0.25)) / 2)


def test_regret_summary_pads_to_slots(spark):
    rows = [("a", 1, 1, 0.0), ("a", 1, 2, 1.0), ("b", 1, 1, 0.5)]
    df = spark.createDataFrame(rows, "metalearner_name string, dataset_id long, slot int, score double")
    out = {r[0]: (r[1], r[2]) for r in analysis.regret_summary(df, n_slots=4).collect()}
    # a: regrets [1, 0, 1, 1]; b: [0.5, 1, 1, 1]
    import statistics
    assert out["a"][0] == pytest.approx(0.75) and out["a"][1] == pytest.approx(statistics.stdev([1, 0, 1, 1]))
    assert out["b"][0] == pytest.approx(0.875) and out["b"][1] == pytest.approx(statistics.stdev([0.5, 1, 1, 1]))


def _tiny_cells(spark, seed=1, n=60):
    rnd = random.Random(seed)
    rows, labels = [], []
    for ds in range(2):
        for r in range(n):
            y = rnd.choice("abc")
            shift = {"a": 0.0, "b": 1.5, "c": 3.0}[y]
            a, b = rnd.gauss(shift, 1.0), rnd.gauss(-shift, 2.0)
            rows += [(ds, ds * 1000 + r, "a", False, a, None), (ds, ds * 1000 + r, "b", False, b, None)]
            labels.append((ds, ds * 1000 + r, y))
    cells = spark.createDataFrame(rows, "dataset_id long, row_id long, attr string, is_cat boolean, num_val double, cat_val string")
    lab = spark.createDataFrame(labels, "dataset_id long, row_id long, y string")
    return cells, lab, rows, labels


def test_lda_matches_numpy(spark):
    import numpy as np
    from metalens.operators.landmarkers import hash_folds, linear_discriminant_accuracy
    cells, lab, rows, labels = _tiny_cells(spark)
    folds = hash_folds(lab, 3, 0)
    got = {r["dataset_id"]: r["value"] for r in linear_discriminant_accuracy(cells, folds).collect()}
    fmap = {(r["dataset_id"], r["row_id"]): r["fold"] for r in folds.collect()}
    feat = {}
    for ds, rid, attr, _, v, _ in rows:
        feat.setdefault((ds, rid), {})[attr] = v
    for ds in range(2):
        items = [(rid, np.array([feat[(ds, rid)]["a"], feat[(ds, rid)]["b"]]), y) for d, rid, y in labels if d == ds]
        accs = []
        for f in range(3):
            tr = [(x, y) for rid, x, y in items if fmap[(ds, rid)] != f]
            te = [(x, y) for rid, x, y in items if fmap[(ds, rid)] == f]
            cls = sorted({y for _, y in tr})
            mus = {c: np.mean([x for x, y in tr if y == c], axis=0) for c in cls}
            sw = sum(np.outer(x - mus[y], x - mus[y]) for x, y in tr) / (len(tr) - len(cls))
            inv = np.linalg.pinv(sw)
            pri = {c: sum(1 for _, y in tr if y == c) / len(tr) for c in cls}
            def pred(x):
                return max(cls, key=lambda c: (x @ inv @ mus[c] - 0.5 * mus[c] @ inv @ mus[c] + np.log(pri[c]), c))
            accs.append(np.mean([pred(x) == y for x, y in te]))
        assert got[ds] == pytest.approx(float(np.mean(accs)), abs=1e-9)


def test_pca_first_component_statistics(spark):
    import numpy as np
    from metalens.operators.landmarkers import pca_features
    cells, _, rows, _ = _tiny_cells(spark, seed=4, n=200)
    got = {(r["dataset_id"], r["name"]): r["value"] for r in pca_features(cells).collect()}
    feat = {}
    for ds, rid, attr, _, v, _ in rows:
        feat.setdefault(ds, {}).setdefault(rid, {})[attr] = v
    for ds in range(2):
        x = np.array([[v["a"], v["b"]] for v in feat[ds].values()])
        xc = x - x.mean(axis=0)
        vals, vecs = np.linalg.eigh(np.cov(xc.T, bias=True))
        pc = vecs[:, np.argmax(vals)]
        pc = pc if pc[np.argmax(np.abs(pc))] >= 0 else -pc
        s = xc @ pc
        m2, m3, m4 = (s ** 2).mean(), (s ** 3).mean(), (s ** 4).mean()
        assert got[(ds, "pca.skewness")] == pytest.approx(m3 / m2 ** 1.5, rel=1e-6)
        assert got[(ds, "pca.kurtosis")] == pytest.approx(m4 / m2 ** 2 - 3, rel=1e-6)
        assert got[(ds, "pca.95%")] == pytest.approx(float(np.quantile(s, 0.95)), abs=0.05 * s.std())


def test_naive_bayes_beats_chance_on_separable_data(spark):
    from metalens.operators.landmarkers import hash_folds, naive_bayes_accuracy
    cells, lab, _, _ = _tiny_cells(spark, seed=2, n=150)
    got = [r["value"] for r in naive_bayes_accuracy(cells, hash_folds(lab, 5, 1)).collect()]
    assert all(v > 0.6 for v in got)


def test_stratified_folds_balance(spark):
    from metalens.operators.landmarkers import stratified_folds
    _, lab, _, labels = _tiny_cells(spark, seed=3, n=90)
    f = stratified_folds(lab, 3, 0, block_bits=29)  # 8 hash blocks
    counts = {}
    for r in f.collect():
        counts.setdefault((r["dataset_id"], r["y"]), []).append(r["fold"])
    for folds in counts.values():
        sizes = [folds.count(i) for i in range(3)]
        assert max(sizes) - min(sizes) <= 1


def test_global_row_number_across_partitions(spark):
    from metalens.operators.store import global_row_number
    rnd = random.Random(9)
    vals = [(i, rnd.randint(0, 50)) for i in range(300)]
    df = spark.createDataFrame(vals, "id long, v long").repartition(7)
    out = global_row_number(df, [F.col("v").desc(), F.col("id").asc()], "pos").collect()
    want = sorted(vals, key=lambda t: (-t[1], t[0]))
    got = sorted(((r["id"], r["v"]), r["pos"]) for r in out)
    assert sorted(r["pos"] for r in out) == list(range(1, 301))
    assert {k: p for k, p in got} == {k: i + 1 for i, k in enumerate(want)}


def _py_tree_f1(rows, labels, fold_of, k, max_depth, n_bins=32):
    """Reference implementation of the binned Gini tree landmarker in plain Python."""
    vals = {}
    for ds, rid, attr, _, v, _ in rows:
        vals.setdefault(ds, {}).setdefault(rid, {})[attr] = v
    y_of = {(ds, rid): y for ds, rid, y in labels}
    out = {}
    for ds, rmap in vals.items():
        attrs = sorted(next(iter(rmap.values())))
        bins = {}
        for a in attrs:
            lo, hi = min(r[a] for r in rmap.values()), max(r[a] for r in rmap.values())
            for rid, r in rmap.items():
                bins[(rid, a)] = 0 if hi <= lo else min(math.floor((r[a] - lo) / (hi - lo) * n_bins), n_bins - 1)
        f1s = []
        for f in range(k):
            train = [rid for rid in rmap if fold_of[(ds, rid)] != f]
            test = [rid for rid in rmap if fold_of[(ds, rid)] == f]
            if not test:
                continue

            def grow(ids, depth):
                cnt = {}
                for rid in ids:
                    cnt[y_of[(ds, rid)]] = cnt.get(y_of[(ds, rid)], 0) + 1
                major = min(cnt, key=lambda c: (-cnt[c], c))
                if depth == max_depth or len(cnt) < 2:
                    return ("leaf", major)
                best = None
                for a in attrs:
                    for e in range(n_bins - 1):
                        left = [r for r in ids if bins[(r, a)] <= e]
                        right = [r for r in ids if bins[(r, a)] > e]
                        if not left or not right:
                            continue
                        def sq(g):
                            c = {}
                            for r in g:
                                c[y_of[(ds, r)]] = c.get(y_of[(ds, r)], 0) + 1
                            return sum(v * v for v in c.values())
                        imp = (len(left) - sq(left) / len(left)) + (len(right) - sq(right) / len(right))
                        if best is None or (imp, a, e) < best[0]:
                            best = ((imp, a, e), left, right)
                if best is None:
                    return ("leaf", major)
                (_, a, e), left, right = best
                return ("split", a, e, grow(left, depth + 1), grow(right, depth + 1))

            tree = grow(train, 0)

            def predict(rid):
                t = tree
                while t[0] == "split":
                    t = t[3] if bins[(rid, t[1])] <= t[2] else t[4]
                return t[1]

            pairs = [(y_of[(ds, r)], predict(r)) for r in test]
            classes = sorted({p for pr in pairs for p in pr})
            fs = []
            for c in classes:
                tp = sum(1 for y, p in pairs if y == c and p == c)
                fp = sum(1 for y, p in pairs if y != c and p == c)
                fn = sum(1 for y, p in pairs if y == c and p != c)
                fs.append(2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0)
            f1s.append(sum(fs) / len(fs))
        out[ds] = sum(f1s) / len(f1s)
    return out


def test_decision_tree_f1_matches_plain_python(spark):
    from metalens.operators.landmarkers import decision_tree_f1, hash_folds
    cells, lab, rows, labels = _tiny_cells(spark, seed=6, n=45)
    folds = hash_folds(lab, 3, 2)
    fold_of = {(r["dataset_id"], r["row_id"]): r["fold"] for r in folds.collect()}
    got = {r["dataset_id"]: r["value"] for r in decision_tree_f1(cells, folds, max_depth=3).collect()}
    want = _py_tree_f1(rows, labels, fold_of, 3, 3)
    for ds in want:
        assert got[ds] == pytest.approx(want[ds], abs=1e-12)


def test_decision_tree_levels_hold_rows_alike_once(spark, monkeypatch):
    from metalens.operators import landmarkers
    import metalens.session

    rows = [(r, a, r % 8 + (a == "v") * (r % 3)) for r in range(600) for a in ("u", "v")]
    cells = spark.createDataFrame([(1, r, a, False, float(x), None) for r, a, x in rows], "dataset_id long, row_id long, attr string, is_cat boolean, num_val double, cat_val string")
    folds = spark.createDataFrame([(1, r, str((r % 8) * (r % 3) % 4), r % 2) for r in range(600)], "dataset_id long, row_id long, y string, fold long")
    sizes, write = [], metalens.session.materialize

    def counted(df):
        out = write(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(metalens.session, "materialize", counted)
    monkeypatch.setattr(landmarkers, "materialize", counted)
    [got] = landmarkers.decision_tree_f1(cells, folds, max_depth=4).collect()
    want = _py_tree_f1([tuple(r) for r in cells.collect()], [(r.dataset_id, r.row_id, r.y) for r in folds.collect()],
                       {(r.dataset_id, r.row_id): r.fold for r in folds.collect()}, 2, 4)
    assert got.value == pytest.approx(want[1], abs=1e-12)
    assert max(sizes) <= 2 * 24 * 2  # 24 kinds of rows, in two folds, for two trees


def test_blocked_rank_matches_plain_rank(spark):
    from metalens.operators.sequence import blocked_rank
    rnd = random.Random(12)
    rows = [(k, p) for k in range(3) for p in rnd.sample(range(1000), 120)]
    df = spark.createDataFrame(rows, "k long, p long")
    got = {(r["k"], r["p"]): r["rank_in_key"] for r in blocked_rank(df, "k", "p", block_size=16).collect()}
    for k in range(3):
        for i, p in enumerate(sorted(p for kk, p in rows if kk == k), start=1):
            assert got[(k, p)] == i


def test_cd_groups_two_clusters(spark):
    from metalens.operators.analysis import cd_groups, critical_difference
    assert critical_difference(5, 6) / math.sqrt(5 * 6 / 36) == pytest.approx(2.728, abs=1e-3)
    ranks = spark.createDataFrame([("a", 1.0), ("b", 1.2), ("c", 3.0), ("d", 3.1)],
                                  "metalearner_name string, avg_rank double")
    got = {}
    for r in cd_groups(ranks, 22).collect():
        got.setdefault(r["group"], set()).add(r["metalearner_name"])
    assert sorted(map(sorted, got.values())) == [["a", "b"], ["c", "d"]]


def test_pca_with_different_attribute_sets(spark):
    import numpy as np
    from metalens.operators.landmarkers import pca_features
    rnd = random.Random(8)
    rows = []
    for ds, attrs in ((0, ["a", "b"]), (1, ["a", "b", "c"])):
        for r in range(80):
            base = rnd.gauss(0, 1)
            for j, a in enumerate(attrs):
                rows.append((ds, ds * 1000 + r, a, False, base * (j + 1) + rnd.gauss(0, 0.3), None))
    cells = spark.createDataFrame(rows, "dataset_id long, row_id long, attr string, is_cat boolean, num_val double, cat_val string")
    got = {(r["dataset_id"], r["name"]): r["value"] for r in pca_features(cells).collect()}
    for ds in (0, 1):
        by_row = {}
        for d, rid, a, _, v, _ in rows:
            if d == ds:
                by_row.setdefault(rid, {})[a] = v
        attrs = sorted(next(iter(by_row.values())))
        x = np.array([[row[a] for a in attrs] for row in by_row.values()])
        xc = x - x.mean(axis=0)
        vals, vecs = np.linalg.eigh(np.cov(xc.T, bias=True))
        s = xc @ vecs[:, np.argmax(vals)]
        m2, m4 = (s ** 2).mean(), (s ** 4).mean()
        assert got[(ds, "pca.kurtosis")] == pytest.approx(m4 / m2 ** 2 - 3, rel=1e-6)


def test_similarity_learners_on_store_characterizations(spark):
    from metalens.operators.views import partial_view
    from metalens.plans.learners import TopSimilarityLearner, UtilityEstimateLearner
    rows = [(i, d, p, -0.1 * ((d + p) % 5), "m", "r") for i, (d, p) in
            enumerate((d, p) for d in range(1, 5) for p in range(6))]
    ev = spark.createDataFrame(rows, EVAL_DDL)
    ds = spark.createDataFrame([(f"d{d}", d) for d in range(5)], "dataset string, dataset_id long")
    pipes = spark.createDataFrame([(f"p{p}", p) for p in range(6)], "pipeline string, pipeline_id long")
    chars = spark.createDataFrame([("m1", d, [float(d), 1.0], ["a", "b"]) for d in range(5)],
                                  "method string, dataset_id long, values array<double>, names array<string>")
    keep = ds.filter("dataset_id > 0").select("dataset_id")
    view = partial_view(ev, ds, pipes, keep, dataset_chars=chars)
    q = chars.filter("dataset_id = 0")
    u = UtilityEstimateLearner(metric="m", vec_col="values").fit(view).recommend(q, total_n_configs=3).collect()
    t = TopSimilarityLearner(metric="m", n_datasets=2, vec_col="values").fit(view).recommend(q, total_n_configs=4).collect()
    assert [r["rank"] for r in u] == [1, 2, 3] and len(t) == 4


@pytest.mark.parametrize("stored", [False, True])
def test_utility_learner_has_one_join_a_stage(spark, stored):
    """Joins on one key run in one stage, whose tasks hold all their sides; so what they need is written first."""
    from metalens.operators.views import partial_view
    from metalens.plans.learners import UtilityEstimateLearner
    rows = [(i, d, p, -0.1 * ((3 * d + p) % 5) - d, "m" if i % 7 else "other", "r") for i, (d, p) in
            enumerate((d, p) for d in range(9) for p in range(6))]
    rows += [(100, 2, 3, None, "m", "r"), (101, None, 3, -0.5, "m", "r"), (102, 4, None, -0.5, "m", "r"), (103, 4, 5, -4.2, "m", "r")]
    ev = spark.createDataFrame(rows, EVAL_DDL)
    ds = spark.createDataFrame([(f"d{d}", d) for d in range(9)], "dataset string, dataset_id long")
    pipes = spark.createDataFrame([(f"p{p}", p) for p in range(8)], "pipeline string, pipeline_id long")
    vectors = {d: [1.0, d / 4] for d in range(6)}  # datasets 6 to 8 have none
    chars = spark.createDataFrame(list(vectors.items()), "dataset_id long, embedding array<double>")
    known = [r for r in rows if r[1] in range(1, 6) and r[4] == "m"]
    want = {p: [] for p in range(6)}
    for _, d, p, score, _, _ in known:
        own = [r[3] for r in known if r[1] == d and r[3] is not None]
        regret = 1.0 if score is None else (max(own) - score) / (max(own) - min(own))
        cosine = 1 / math.hypot(*vectors[d])  # the query is (1, 0)
        if p is not None:
            want[p].append(cosine * (1 - regret))
    want = {p: sum(u) / len(u) for p, u in want.items()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = partial_view(ev, ds, pipes, ds.filter("dataset_id > 0").select("dataset_id"), dataset_chars=chars, stored=stored)
        out = UtilityEstimateLearner(metric="m").fit(view).recommend(chars.filter("dataset_id = 0"), total_n_configs=8)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        got = out.orderBy("rank").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [r["pipeline_id"] for r in got] == sorted(want, key=lambda p: (-round(want[p], 10), p))
    assert [r["score"] for r in got] == pytest.approx([want[r["pipeline_id"]] for r in got], abs=1e-9)
    # Evaluations with the datasets' bounds, lookup with scores; a view that isn't stored joins the kept ids too.
    assert plan.count("SortMergeJoin") == (2 if stored else 3), plan


def test_rankml_learner_mechanics(spark):
    from metalens.operators.views import partial_view
    from metalens.plans.learners import RankMLLearner
    rnd = random.Random(4)
    rows = [(i, d, p, -rnd.random(), "m", "r") for i, (d, p) in enumerate((d, p) for d in range(1, 6) for p in range(8))]
    ev = spark.createDataFrame(rows, EVAL_DDL)
    ds = spark.createDataFrame([(f"d{d}", d) for d in range(6)], "dataset string, dataset_id long")
    pipes = spark.createDataFrame([(f"p{p}", p) for p in range(8)], "pipeline string, pipeline_id long")
    dchars = spark.createDataFrame([(d, [float(d), float(d % 2)]) for d in range(6)], "dataset_id long, values array<double>")
    pchars = spark.createDataFrame([(p, [float(p % 3), float(p % 2)]) for p in range(8)], "pipeline_id long, values array<double>")
    view = partial_view(ev, ds, pipes, ds.filter("dataset_id > 0").select("dataset_id"), dchars, pchars)
    lrn = RankMLLearner(metric="m", n_models=4, max_iter=3, max_depth=3).fit(view)
    out = lrn.recommend([0.0, 0.0], total_n_configs=5, max_n_models=4).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, len(out) + 1)) and 0 < len(out) <= 5
    assert len({r["pipeline_id"] for r in out}) == len(out)
