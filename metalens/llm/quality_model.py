"""Quality classifier by co-training of two views.

The text view describes a document's words (symbols, case, repetition, variety,
punctuation); the metadata view describes the page that carried it (language,
source, length, line layout). Each view has a logistic regression of its own. In
every round, each view labels the documents of an unlabelled pool that it is
most sure of, and those are added to what the other view learns from. At the
end both are calibrated on labelled rows kept apart, and a last regression on
the two calibrated views scores all documents.

Labels are used by crc32(doc_id as text) modulo 5: remainder 0 is held out for
measuring, 1 calibrates, the others train. Bounds, all parameters:
``max_labelled`` labelled rows and a pool of about ``pool`` others. Features and
scores cover every document; features are computed once and written.

Cases: a null or empty text has zero features; a null language or source is one
of its own; null labels are no labels; a null doc_id lends no label; without
both classes to learn from, every score is the share of good labels (0.5 without
labels, so that nothing is thrown out); repeated rows get equal scores; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, per_text, text_slices, written
from .quality_rules import View
from .toxicity import fold

MAX_LABELLED = 20_000
POOL = 20_000
ROUNDS = 3
#: In a round, a view labels the documents that it gives at least this chance, up to this share of the pool for each class.
SURE, SHARE = 0.95, 0.1
#: Languages and sources are told apart by hash into so many groups.
GROUPS = 32


def _text_view(v: View) -> np.ndarray:
    n = np.maximum(v.n_words, 1)
    codes, _, offsets = v.split
    row = np.repeat(np.arange(len(v.texts)), v.n_words)
    size = int(codes.max()) + 1 if len(codes) else 1
    pairs, times = np.unique(row * size + codes, return_counts=True)
    distinct = np.bincount(pairs // size, minlength=len(v.texts))
    most = np.zeros(len(v.texts))
    np.maximum.at(most, pairs // size, times)
    marked = v.summed(pc.cast(pc.match_substring_regex(v.vocabulary, r"[!?*#$%&|<>]{2}"), pa.int64()))
    stops = v.summed(pc.cast(pc.match_substring_regex(v.vocabulary, r"[.!?]$"), pa.int64()))
    digits = v.summed(pc.count_substring_regex(v.vocabulary, r"[0-9]"))
    return np.stack([
        np.log1p(v.n_words), v.word_chars / n, np.minimum(v.n_symbols / n, 3), marked / n, v.n_upper_words / n, v.n_echo_words / n,
        v.n_repeat_words / n, distinct / n, most / n, stops / n, np.minimum(digits / n, 3), (v.n_words < 20).astype(float),
        (v.n_symbols > 0.1 * n).astype(float), (v.n_upper_words > 0.5 * n).astype(float), (v.n_repeat_words > 0.3 * n).astype(float), (v.n_echo_words > 0.3 * n).astype(float)], axis=1)


def _metadata_view(v: View, lang: pa.Array, source: pa.Array) -> np.ndarray:
    chars = pc.utf8_length(v.texts).to_numpy(zero_copy_only=False).astype(float)
    lists = pc.split_pattern(v.texts, "\n")
    ends = lists.offsets.to_numpy().astype(np.int64)
    line_chars = pc.utf8_length(lists.flatten()).to_numpy(zero_copy_only=False).astype(float)
    n_lines = np.diff(ends)
    mean = chars / np.maximum(n_lines, 1)
    longest = np.maximum.reduceat(line_chars, ends[:-1] - ends[0]) if len(line_chars) else np.zeros(len(chars))
    short = per_text((line_chars < 20).astype(np.int64), ends - ends[0]) / np.maximum(n_lines, 1)
    worded, again = v.lines
    octets = pc.binary_length(v.texts).to_numpy(zero_copy_only=False) / np.maximum(chars, 1)
    layout = np.stack([np.log1p(chars), np.log1p(n_lines), np.log1p(mean), np.log1p(longest), short, again / np.maximum(worded, 1), (2 * again > worded).astype(float), octets], axis=1)
    groups = [np.eye(GROUPS)[(pc.fill_null(c, -1).to_numpy(zero_copy_only=False) % GROUPS)] for c in (lang, source)]
    return np.concatenate([layout, *groups], axis=1)


def views(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, text_view, meta_view): both views' features of each document."""
    group = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(GROUPS)).cast("long")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), group(lang_col).alias("lang"), group(source_col).alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, 1)
            for start, length in text_slices(texts):
                v = View(texts.slice(start, length))
                both = _text_view(v), _metadata_view(v, batch.column(2).slice(start, length), batch.column(3).slice(start, length))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(length + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel())) for m in both]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, length), *lists], names=["doc_id", "text_view", "meta_view"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_view array<double>, meta_view array<double>")


def _fit(rows: DataFrame, view: str) -> LogisticRegressionModel:
    return LogisticRegression(labelCol="y", featuresCol="features", regParam=1e-3, maxIter=40).fit(rows.select("y", array_to_vector(view).alias("features")))


def _chance(model: LogisticRegressionModel, rows: DataFrame, view: str, out: str) -> DataFrame:
    """``rows`` with the model's probability of good in ``out``."""
    scored = model.transform(rows.withColumn("features", array_to_vector(view)))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _logit(p: str) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    return F.log(q / (1 - q))


def _models(taught: dict[str, DataFrame], given: dict[str, list[DataFrame]]) -> dict[str, LogisticRegressionModel]:
    """Each view's model, from the labelled rows and from what the other view has labelled."""
    return {v: _fit(reduce(DataFrame.unionByName, [g.drop("row") for g in given[v]], rows), v) for v, rows in taught.items()}


def _has_both(rows: DataFrame) -> bool:
    return {r["y"] for r in rows.select("y").distinct().collect()} == {0.0, 1.0}


def score_quality(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, sure: float = SURE, share: float = SHARE, max_labelled: int = MAX_LABELLED,
                  pool: int = POOL, seed: int = 5, **columns: str) -> DataFrame:
    """(doc_id, held_out, text_score, meta_score, score) of every document; scores are chances of good quality."""
    features = written(views(docs, **columns), "quality-views")
    said = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("quality").cast("double")).alias("y"))
    said = written(said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "quality-labels")
    labelled = written(features.join(said, "doc_id").select("doc_id", "text_view", "meta_view", "y"), "quality-labelled")
    held_out = fold(F.col("doc_id")) == 0
    train, calibrate = labelled.filter(fold(F.col("doc_id")) > 1), labelled.filter(fold(F.col("doc_id")) == 1)
    if not (_has_both(train) and _has_both(calibrate)):
        n = labelled.filter(fold(F.col("doc_id")) > 0).agg(F.count("*").alias("n"), F.sum("y").alias("good")).first()
        p = n["good"] / n["n"] if n["n"] else 0.5
        return features.select("doc_id", held_out.alias("held_out"), *(F.lit(float(p)).alias(c) for c in ("text_score", "meta_score", "score")))

    total = features.count()
    rest = features.join(said.select("doc_id"), "doc_id", "left_anti").filter(~held_out)
    rest = written(rest.sample(min(1.0, pool / total), seed).select("text_view", "meta_view").withColumn("row", F.monotonically_increasing_id()), "quality-pool")
    most = max(1, int(share * rest.count() / rounds))
    taught = {v: train.select("text_view", "meta_view", "y") for v in ("text_view", "meta_view")}
    given: dict[str, list[DataFrame]] = {v: [] for v in taught}  # pseudo-labels from the other view
    for _ in range(rounds):
        models = _models(taught, given)
        for view, other in (("text_view", "meta_view"), ("meta_view", "text_view")):
            left = rest
            for before in given[other]:
                left = left.join(before.select("row"), "row", "left_anti")
            chance = _chance(models[view], left, view, "p")
            good = chance.filter(F.col("p") >= sure).orderBy(F.desc("p"), "row").limit(most).withColumn("y", F.lit(1.0))
            bad = chance.filter(F.col("p") <= 1 - sure).orderBy("p", "row").limit(most).withColumn("y", F.lit(0.0))
            picked = written(good.unionByName(bad).select("row", "text_view", "meta_view", "y"), "quality-pseudo")
            given[other].append(picked)
    models = _models(taught, given)

    def both(rows: DataFrame) -> DataFrame:
        for view, out in (("text_view", "text_score"), ("meta_view", "meta_score")):
            rows = _chance(models[view], rows, view, out)
        return rows

    known = written(both(calibrate).select("y", "text_score", "meta_score"), "quality-calibration")
    plain = LogisticRegression(labelCol="y", featuresCol="features", regParam=1e-4, maxIter=40)
    calibrated = {c: plain.fit(known.select("y", array_to_vector(F.array(_logit(c))).alias("features"))) for c in ("text_score", "meta_score")}

    def calibrate_views(rows: DataFrame) -> DataFrame:
        for c, model in calibrated.items():
            rows = rows.withColumn(c, 1 / (1 + F.exp(-(F.lit(float(model.intercept)) + F.lit(float(model.coefficients[0])) * _logit(c)))))
        return rows

    pair = F.array(_logit("text_score"), _logit("meta_score"))
    last = plain.fit(calibrate_views(known).select("y", array_to_vector(pair).alias("features")))
    weighed = F.lit(float(last.intercept)) + sum(F.lit(float(w)) * x for w, x in zip(last.coefficients, (_logit("text_score"), _logit("meta_score")), strict=True))
    scored = calibrate_views(both(features)).withColumn("score", 1 / (1 + F.exp(-weighed)))
    return scored.select("doc_id", held_out.alias("held_out"), "text_score", "meta_score", "score")
