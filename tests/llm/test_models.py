import random

import numpy as np
import pytest
from llm_brute import awkward, awkward_rows, sentence
from pyspark.sql import functions as F

from metalens.llm import quality_model, toxicity

BAD = ["scumbag", "vilefool", "rotbrain", "lousyrat", "grimscum", "dolt", "churl", "knavish", "louty", "brute"]


def _corpus(n=700, seed=9):
    """(doc_id, text, toxic): toxic texts hold some bad words; junk doesn't matter here."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = sentence(rng, 30 + rng.randrange(60), 300).split()
        toxic = int(rng.random() < 0.2)
        for _ in range(toxic * (1 + rng.randrange(4))):
            own[rng.randrange(len(own))] = rng.choice(BAD)
        rows.append((i, " ".join(own), toxic))
    return rows


def _frames(spark, rows, labelled=0.6, seed=1):
    rng = random.Random(seed)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if rng.random() < labelled], "doc_id long, toxic int")
    return docs, labels


def test_toxicity_finds_held_out_toxic_texts_and_leaves_clean_ones(spark):
    rows = _corpus()
    docs, labels = _frames(spark, rows)
    scored = {r.doc_id: r.score for r in toxicity.train(docs, labels).score(docs).collect()}
    held = {r.doc_id for r in docs.filter(toxicity.is_held_out(F.col("doc_id"))).collect()}
    assert 0.1 < len(held) / len(rows) < 0.3
    right = [(scored[i] >= 0.5) == bool(x) for i, _, x in rows if i in held]
    assert np.mean(right) > 0.95
    assert np.mean([scored[i] < 0.5 for i, _, x in rows if i in held and not x]) > 0.97


def test_toxicity_ignores_labels_of_held_out_rows(spark):
    rows = _corpus(300)
    docs, labels = _frames(spark, rows)
    turned = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, turned))
    assert a.weights == pytest.approx(b.weights, abs=1e-9) and a.intercept == pytest.approx(b.intercept, abs=1e-9)  # sums differ in order


def test_toxicity_counts_tokens_and_votes_of_all_labelled_rows(spark, monkeypatch):
    rows = _corpus(500)
    toxic = [i for i, _, x in rows if x]
    rare = set(toxic[::5])
    docs, labels = _frames(spark, [(i, t + " rareslur" if i in rare else t, x) for i, t, x in rows], labelled=0.8)
    fitted, own = [], toxicity.LabelModel.fit

    def fit(self, patterns, counts, said, *rest):
        fitted.append((counts.sum(), counts[said >= 0].sum()))
        return own(self, patterns, counts, said, *rest)

    monkeypatch.setattr(toxicity.LabelModel, "fit", fit)
    model = toxicity.train(docs, labels, max_labelled=40)
    assert "rareslur" in model.weights
    free = ~toxicity.is_held_out(F.col("doc_id"))
    assert fitted == [(docs.filter(free).count(), labels.filter(free).count())]


def test_toxicity_scores_awkward_rows(spark):
    docs, labels = _frames(spark, _corpus(300))
    model = toxicity.train(docs, labels)
    out = model.score(awkward(spark)).collect()
    assert len(out) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in out)
    blank = {r.score for r in out if r.doc_id in (4, 5, 6)}
    assert len(blank) == 1 and blank.pop() < 0.5
    assert len({r.score for r in out if r.doc_id == 15}) == 1
    assert model.score(awkward(spark, [])).count() == 0
    toxic = model.score(spark.createDataFrame([(1, "You SCUMBAG, you vilefool!")], "doc_id long, text string")).first()
    assert toxic.score >= 0.5


def test_toxicity_trains_on_awkward_tables(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (5, 1), (5, 1)], "doc_id long, toxic int")
    for docs, said in ((awkward(spark), labels), (awkward(spark, []), labels), (awkward(spark), labels.limit(0)), (awkward(spark), labels.filter("toxic = 1"))):
        out = toxicity.train(docs, said).score(docs).collect()
        assert all(0 <= r.score <= 1 for r in out)
    none = toxicity.train(awkward(spark), labels.limit(0)).score(awkward(spark)).first()
    assert none.score < 0.5


def test_toxicity_deals_labelled_texts_alike_at_every_size(spark):
    docs, labels = _frames(spark, _corpus(300))
    found = toxicity.with_labels(docs, labels)
    assert found.count() == labels.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan  # few labels would be broadcast, many would not
    assert toxicity.filter_bits(0) == toxicity.filter_bits(1000) == toxicity.FILTER_BITS
    assert toxicity.filter_bits(toxicity.FILTER_BITS) == 8 * toxicity.FILTER_BITS == toxicity.MAX_FILTER_BITS == toxicity.filter_bits(10**9)


def test_toxicity_counts_only_tokens_that_occur(spark):
    own = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))  # no word is frequent in it
    labelled = spark.createDataFrame([(own, 1), (own + " scumbag scumbag scumbag", 0)], "text string, toxic int")
    counts = {r.token: (r.toxic, r.clean) for r in toxicity.token_counts(labelled).collect()}
    assert counts["wordaa"] == (1, 1) and counts["scumbag"] == (0, 1) and counts["*scumbag"] == (0, 1)
    assert "*wordaa" not in counts and all(a + b for a, b in counts.values())


def test_label_model_recovers_accuracies_and_ties_correlated_voters():
    rng = np.random.default_rng(4)
    n, k = 20_000, 5
    y = rng.random(n) < 0.3
    fires = np.array([0.9, 0.7, 0.5, 0.6, 0.8])
    false = np.array([0.02, 0.05, 0.1, 0.02, 0.1])
    bits = rng.random((n, k)) < np.where(y[:, None], fires, false)
    bits = np.concatenate([bits, bits[:, 4:5] ^ (rng.random((n, 1)) < 0.02)], axis=1)  # a near copy of the last voter
    masks = (bits * (1 << np.arange(k + 1))).sum(axis=1)
    labels = np.where(rng.random(n) < 0.1, y.astype(int), -1)
    keys, counts = np.unique(np.stack([masks, labels]), axis=1, return_counts=True)
    model = toxicity.LabelModel(k + 1).fit(keys[0], counts.astype(float), keys[1])
    assert abs(model.prior - 0.3) < 0.03
    assert model.parent[5] == 4 or model.parent[4] == 5
    for v in range(4):
        q = model.posterior(np.array([0]), np.array([-1]))
        assert q[0] < 0.1
    q = model.posterior(masks, np.full(n, -1))
    assert np.mean((q > 0.5) == y) > 0.93
    free = toxicity.LabelModel(k + 1).fit(keys[0][keys[1] < 0], counts[keys[1] < 0].astype(float), keys[1][keys[1] < 0])  # without any label
    assert np.isfinite(free.fires).all()


def test_tokens_marked_frequent_and_voters_dealt():
    codes, offsets = np.array([0, 1, 0, 0, 2]), np.array([0, 4, 5, 5])
    words = ["badword", "ok", "badly"]
    index = {"badword": 0, "*badword": 1, "4:badw": 2, "4:badl": 3}
    row, number = toxicity.features(codes, words, offsets, index)
    assert sorted(zip(row.tolist(), number.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (1, 3)]
    dealt = toxicity.voters_of([f"w{i}" for i in range(12)] + ["4:abcd", "*4:abce", "5:abcde"])
    assert set(dealt.values()) <= set(range(toxicity.N_VOTERS)) and dealt["w0"] == dealt["w6"] and dealt["4:abcd"] != dealt["*4:abce"]


def _quality_rows(n=500, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "\n".join(sentence(rng, 20, 3000) + "." for _ in range(2 + rng.randrange(5)))
        good = rng.random() < 0.7
        if not good:
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "*** "), lambda t: "\n".join([t[:60]] * 9), lambda t: " ".join(w + " " + w for w in t.split())])(text)
        rows.append((i, text, rng.choice(["en", "de", None]), f"src{rng.randrange(9)}", int(good)))
    return rows


def _quality_frames(spark, rows):
    rng = random.Random(3)
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    return docs, spark.createDataFrame([(r[0], r[4]) for r in rows if rng.random() < 0.6], "doc_id long, quality int")


def test_quality_model_separates_held_out_documents(spark):
    rows = _quality_rows()
    docs, labels = _quality_frames(spark, rows)
    out = {r.doc_id: r for r in quality_model.score_quality(docs, labels).collect()}
    assert set(out) == {r[0] for r in rows} and all(0 <= x <= 1 for r in out.values() for x in (r.text_score, r.meta_score, r.score))
    held = [(out[r[0]].score >= 0.5, bool(r[4])) for r in rows if out[r[0]].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95 and np.mean([a for a, b in held if b]) > 0.97


def test_quality_model_on_awkward_and_empty_tables(spark):
    said = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 0), (4, 0), (7, 0), (10, 1), (11, 1), (12, 1), (13, 1), (-5, 1), (20, 0)], "doc_id long, quality int")
    for docs, labels in ((awkward(spark), said), (awkward(spark), said.limit(0)), (awkward(spark, []), said), (awkward(spark, []), said.limit(0))):
        out = quality_model.score_quality(docs, labels).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality_model.score_quality(awkward(spark), said.limit(0)).collect()} == {0.5}
    docs, labels = _quality_frames(spark, _quality_rows(200) + [(1000 + i, t, None, None, None) for i, (_, t) in enumerate(awkward_rows())])
    out = quality_model.score_quality(docs, labels).collect()
    assert len(out) == 200 + len(awkward_rows()) and all(np.isfinite([r.text_score, r.meta_score, r.score]).all() for r in out)


@pytest.mark.parametrize("bits", [64, 1 << 10, 1 << 23])
def test_labels_meet_their_texts_whatever_the_filter_lets_through(spark, bits):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)] + [(5, "again"), (None, "none")], "doc_id long, text string")
    said = spark.createDataFrame([(i, i % 2) for i in range(0, 600, 7)], "doc_id long, toxic int")
    got = toxicity.with_labels(docs, said, bits).select("doc_id", "text", "toxic")
    assert sorted(got.collect()) == sorted(docs.join(said, "doc_id").select("doc_id", "text", "toxic").collect())
    assert toxicity.with_labels(docs, said.limit(0), bits).count() == 0
