"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Voters. Words and word beginnings that go with the toxic label (counted on
   the labelled training rows) are dealt to several lexicon voters; a general
   list of insults and a few patterns make further ones. A voter fires or not.
2. Label model. All training documents are summed up as counts of vote patterns
   (at most 2^voters), and expectation-maximisation estimates how often each
   voter fires on toxic and on clean text. Correlated voters are tied by a tree:
   a voter's chance depends on the class and on its parent's vote. A given label
   counts as one more vote of known accuracy.
3. Classifier. A logistic regression over the presence of words and word
   beginnings learns the model's posterior labels, and scores every document.

Only rows for which ``is_held_out`` is false lend their labels. Scores depend on
the text alone.

Bounds, all parameters: ``max_labelled`` labelled and ``max_unlabelled`` other
rows to fit the classifier on (chosen by hash of doc_id), ``max_features`` tokens
with a weight, ``LEXICON`` tokens for voters. Token counts and vote counts cover
all rows that aren't held out, with all their labels; scores cover all rows.

Cases: a null or empty text has no tokens and gets the intercept's score; null
labels are no labels; a null doc_id is held out; without both classes among the
labelled rows every text gets the share of toxic labels, drawn towards 0;
repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, split_words, text_slices, translated, written
from .decontaminate import NORMALISE

MAX_LABELLED = 20_000
MAX_UNLABELLED = 20_000
MAX_FEATURES = 4096
LEXICON = 512
WORD_VOTERS, START_VOTERS = 6, 2
STARTS = (4, 5)
#: A token is frequent in a text if it comes at least once in so many words; "*" marks that as a token of its own.
FREQUENT = 250
LABEL_ACCURACY = 0.97
#: Bits of the filter that keeps most unlabelled texts out of the join with labels: at least, at most, and per label. A row for each 64 of them is broadcast.
FILTER_BITS, MAX_FILTER_BITS, BITS_PER_LABEL = 1 << 23, 1 << 26, 8

INSULTS = ("idiot", "idiots", "moron", "morons", "imbecile", "stupid", "dumb", "loser", "scum", "bastard", "bitch", "asshole", "trash", "filth", "vermin",
           "idiota", "imbécil", "estúpido", "estúpida", "cabrón", "basura", "crétin", "connard", "salaud", "ordure", "stupide",
           "dummkopf", "arschloch", "trottel", "abschaum", "drecksack", "dumm")
#: Shouting, repeated exclamation, masked words.
PATTERNS = (r"\p{Lu}{3,}\W+\p{Lu}{3,}\W+\p{Lu}{3,}", r"!\s*!", r"\p{L}[*#@$]{2,}\p{L}*")
N_VOTERS = WORD_VOTERS + START_VOTERS * len(STARTS) + 2 + len(PATTERNS)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def is_held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def tokens_of_words(words: list[str]) -> list[list[str]]:
    """Each word's tokens: itself and its beginnings."""
    return [[w, *(f"{n}:{w[:n]}" for n in STARTS if len(w) > n)] for w in words]


def _texts(batch: pa.RecordBatch, i: int) -> Iterator[tuple[int, int, pa.Array, np.ndarray, list[str], np.ndarray]]:
    texts = column(batch, i)
    for start, length in text_slices(texts):
        part = texts.slice(start, length)
        yield start, length, part, *split_words(translated(part, NORMALISE))


def _occurring(codes: np.ndarray, offsets: np.ndarray, own: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, whether frequent) of the tokens in each text, where distinct word c has the tokens own[c].

    A token is frequent in a text if it makes up at least one in FREQUENT words.
    """
    lengths, size = np.diff(offsets), max(len(own), 1)
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    row = np.repeat(np.arange(len(lengths)), lengths)
    has = sizes[codes] > 0 if len(codes) else np.empty(0, bool)
    pairs, times = np.unique(row[has] * size + codes[has], return_counts=True)  # distinct words first
    row, word = pairs // size, pairs % size
    flat = np.array([t for ts in own for t in ts], np.int64)
    begins, n = np.cumsum(sizes) - sizes, sizes[word]
    at = np.repeat(begins[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    pairs, place = np.unique((np.repeat(row, n) << 32) | flat[at], return_inverse=True)
    times = np.bincount(place, weights=np.repeat(times, n), minlength=len(pairs))
    row, token = pairs >> 32, pairs & 0xFFFFFFFF
    return row, token, times * FREQUENT >= lengths[row]


def features(codes: np.ndarray, words: list[str], offsets: np.ndarray, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the tokens of ``index`` in each text; "*" before a token asks for it to be frequent."""
    base = {t: i for i, t in enumerate(dict.fromkeys(t.removeprefix("*") for t in index))}
    plain = np.array([index.get(t, -1) for t in base] or [-1])
    often = np.array([index.get("*" + t, -1) for t in base] or [-1])
    row, token, frequent = _occurring(codes, offsets, [[base[t] for t in ts if t in base] for ts in tokens_of_words(words)])
    row, number = np.concatenate((row, row[frequent])), np.concatenate((plain[token], often[token[frequent]]))
    return row[number >= 0], number[number >= 0]


def token_counts(labelled: DataFrame) -> DataFrame:
    """(token, toxic, clean): how many toxic and clean texts of ``labelled`` (text, toxic) have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for start, _, _, codes, words, offsets in _texts(batch, 0):
                known: dict[str, int] = {}
                own = [[known.setdefault(t, len(known)) for t in ts] for ts in tokens_of_words(words)]
                row, token, frequent = _occurring(codes, offsets, own)
                names = list(known)
                for mark, chosen in (("", slice(None)), ("*", frequent)):
                    bad = np.bincount(token[chosen], weights=toxic[row[chosen] + start], minlength=len(known)).astype(np.int64)
                    total = np.bincount(token[chosen], minlength=len(known))
                    has = np.flatnonzero(total)  # most tokens are frequent in no text
                    yield pa.RecordBatch.from_arrays([pa.array([mark + names[i] for i in has.tolist()], pa.string()), pa.array(bad[has]), pa.array((total - bad)[has])], names=["token", "toxic", "clean"])

    counted = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "token string, toxic long, clean long")
    return counted.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def associated(counts: DataFrame, n_toxic: int, n_clean: int, min_texts: int = 5) -> DataFrame:
    """``counts`` with smoothed log odds ``odds`` and the signed root ``z`` of the G statistic, for tokens in ``min_texts`` texts."""
    toxic, clean, n = F.col("toxic").cast("double"), F.col("clean").cast("double"), float(n_toxic + n_clean)
    odds = F.log((toxic + 0.5) * (n_clean - clean + 0.5) / ((clean + 0.5) * (n_toxic - toxic + 0.5)))

    def cell(seen: Column, row: Column, total: int) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n / (row * total))).otherwise(0.0)

    has = toxic + clean
    g = cell(toxic, has, n_toxic) + cell(clean, has, n_clean) + cell(n_toxic - toxic, n - has, n_toxic) + cell(n_clean - clean, n - has, n_clean)
    return counts.filter(has >= min_texts).withColumn("odds", odds).withColumn("z", F.signum(odds) * F.sqrt(F.greatest(F.lit(0.0), 2 * g)))


def voters_of(lexicon: list[str]) -> dict[str, int]:
    """Bit of the lexicon voter to which each token is dealt, tokens given strongest first."""
    out, seen = {}, dict.fromkeys((0, *STARTS), 0)
    for token in lexicon:
        kind = next((n for n in STARTS if token.removeprefix("*").startswith(f"{n}:")), 0)
        first = WORD_VOTERS + START_VOTERS * STARTS.index(kind) if kind else 0
        out[token] = first + seen[kind] % (START_VOTERS if kind else WORD_VOTERS)
        seen[kind] += 1
    return out


def votes(texts: pa.Array, codes: np.ndarray, words: list[str], offsets: np.ndarray, voter_of: dict[str, int]) -> np.ndarray:
    """Bit set of the voters that fire on each text."""
    row, token = features(codes, words, offsets, {t: i for i, t in enumerate(voter_of)})
    out = np.zeros(len(texts), np.int64)
    np.bitwise_or.at(out, row, np.int64(1) << np.array([*voter_of.values(), 0], np.int64)[token])
    next_bit = WORD_VOTERS + START_VOTERS * len(STARTS)
    insult = np.isin(codes, [i for i, w in enumerate(words) if w in INSULTS])
    np.bitwise_or.at(out, np.repeat(np.arange(len(texts)), np.diff(offsets))[insult], 1 << next_bit)
    out |= (np.bincount(row, minlength=len(texts)) >= 3).astype(np.int64) << (next_bit + 1)
    for i, pattern in enumerate(PATTERNS):
        out |= pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64) << (next_bit + 2 + i)
    return out


class LabelModel:
    """P(class, votes) = P(class) prod P(vote | parent's vote, class), fitted to pattern counts by EM."""

    def __init__(self, n_voters: int = N_VOTERS) -> None:
        self.n, self.parent = n_voters, [-1] * n_voters
        self.prior, self.fires = 0.1, np.zeros((n_voters, 2, 2))  # [voter, parent's vote, class]

    def fit(self, patterns: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 30) -> LabelModel:
        """``labels`` are 0, 1, or -1 where not known; they also set the start."""
        bits = (patterns[:, None] >> np.arange(self.n)) & 1
        q = np.where(labels < 0, 0.0, labels.astype(float))
        start = np.where(labels < 0, 0.0, counts) if (labels >= 0).any() else counts
        self._maximise(bits, start, q)
        for step in range(2 * rounds):
            q = self.posterior(patterns, labels)
            if step == rounds:
                self.parent = self._tree(bits, counts, q)
            self._maximise(bits, counts, q)
        return self

    def posterior(self, patterns: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """P(toxic | votes, label if known)."""
        bits = (patterns[:, None] >> np.arange(self.n)) & 1
        log = np.log(np.array([[1 - self.prior, self.prior]])).repeat(len(bits), axis=0)
        for v in range(self.n):
            fires = self.fires[v][bits[:, self.parent[v]] if self.parent[v] >= 0 else np.zeros(len(bits), int)]
            log += np.log(np.where(bits[:, v:v + 1] == 1, fires, 1 - fires))
        said = np.log([1 - LABEL_ACCURACY, LABEL_ACCURACY])
        log[:, 1] += np.where(labels < 0, 0, np.where(labels == 1, said[1], said[0]))
        log[:, 0] += np.where(labels < 0, 0, np.where(labels == 1, said[0], said[1]))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))

    def _maximise(self, bits: np.ndarray, counts: np.ndarray, q: np.ndarray) -> None:
        mass = np.stack([counts * (1 - q), counts * q], axis=1)
        self.prior = float(np.clip((mass[:, 1].sum() + 1) / (mass.sum() + 20), 1e-4, 0.5))
        for v in range(self.n):
            above = bits[:, self.parent[v]] if self.parent[v] >= 0 else np.zeros(len(bits), int)
            for a in (0, 1):
                own = mass[above == a]
                self.fires[v, a] = (own[bits[above == a, v] == 1].sum(axis=0) + 0.1) / (own.sum(axis=0) + 0.2)

    def _tree(self, bits: np.ndarray, counts: np.ndarray, q: np.ndarray) -> list[int]:
        """Maximum spanning tree of the voters' mutual information given the class."""
        info = np.zeros((self.n, self.n))
        for weight in (counts * (1 - q), counts * q):
            total = weight.sum() + 1e-9
            for i in range(self.n):
                for j in range(i):
                    joint = np.array([[weight[(bits[:, i] == a) & (bits[:, j] == b)].sum() for b in (0, 1)] for a in (0, 1)]) / total + 1e-9
                    info[i, j] += total * (joint * np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True))).sum()
        info += info.T
        parent, tied = [-1] * self.n, {0}
        while len(tied) < self.n:
            _, up, down = max((info[i, j], -i, -j) for i in tied for j in range(self.n) if j not in tied)
            parent[-down] = -up
            tied.add(-down)
        return parent


class ToxicityModel:
    """Weights of tokens; ``score`` gives each document's probability."""

    def __init__(self, intercept: float, weights: dict[str, float]) -> None:
        self.intercept, self.weights = intercept, weights

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score) of every row."""
        source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        model = docs.sparkSession.sparkContext.broadcast((self.intercept, self.weights))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            intercept, weights = model.value
            index, value = {t: i for i, t in enumerate(weights)}, np.array([*weights.values(), 0.0])
            for batch in batches:
                for start, length, _, codes, words, offsets in _texts(batch, 1):
                    row, token = features(codes, words, offsets, index)
                    logit = intercept + np.bincount(row, weights=value[token], minlength=length)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, length), pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))], names=["doc_id", "score"])

        return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def filter_bits(n_labels: int) -> int:
    """Size of the filter: a power of two, so many bits per label within the bounds."""
    return min(MAX_FILTER_BITS, max(FILTER_BITS, 1 << (BITS_PER_LABEL * n_labels - 1).bit_length()))


def with_labels(rows: DataFrame, said: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` (doc_id, text) that ``said`` (doc_id, toxic) has labels for, with them.

    A bit set of hashed labelled ids holds back other rows before texts are
    shuffled; the few that it lets through fall out in the join. Labels grow with
    the texts, so the join deals both by id at every size.
    """
    def bit(doc_id: str) -> Column:
        return F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(bits))

    words = said.select(bit("doc_id").alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("mask"))
    maybe = rows.withColumn("bit", bit("doc_id")).withColumn("word", F.floor(F.col("bit") / 64)).join(F.broadcast(words), "word")
    return maybe.filter(F.expr("getbit(mask, cast(bit % 64 AS int)) = 1")).select("doc_id", "text").join(said.hint("merge"), "doc_id")


def _chosen(rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows by hash of doc_id."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def train(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column] = is_held_out, max_labelled: int = MAX_LABELLED,
          max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES, seed: int = 11) -> ToxicityModel:
    """Fit on the rows of ``docs`` (doc_id, text) that aren't held out, with ``labels`` (doc_id, toxic).

    Of two labels of a doc_id the larger counts. Rows to fit on are drawn by hash of doc_id.
    """
    said = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter(~held_out(F.col("doc_id")))
    said = written(said, "toxic-labels")
    rows = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    labelled = written(with_labels(rows, said, filter_bits(said.count())), "toxic-labelled")
    totals = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        share = (n_toxic + 1) / (n_toxic + n_clean + 20)
        return ToxicityModel(float(np.log(share / (1 - share))), {})
    tokens = written(associated(token_counts(labelled), n_toxic, n_clean), "toxic-tokens")
    lexicon = [r["token"] for r in tokens.filter("odds > 2 AND z > 4").orderBy(F.desc("z"), "token").limit(LEXICON).collect()]
    vocabulary = [r["token"] for r in tokens.filter("abs(odds) > 1 AND abs(z) > 4").orderBy(F.desc(F.abs("z")), "token").limit(max_features).collect()]
    if not vocabulary:
        share = n_toxic / (n_toxic + n_clean)
        return ToxicityModel(float(np.log(share / (1 - share))), {})

    voter_of = voters_of(lexicon)
    schema = "doc_id long, votes long, toxic int, tokens array<string>"

    def observe(with_tokens: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order = {t: i for i, t in enumerate(vocabulary)}
            for batch in batches:
                for start, length, part, codes, words, offsets in _texts(batch, 1):
                    found: list = [None] * length
                    if with_tokens:
                        row, token = features(codes, words, offsets, order)
                        found = [[] for _ in range(length)]
                        for r, t in zip(row.tolist(), token.tolist(), strict=True):
                            found[r].append(vocabulary[t])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, length), pa.array(votes(part, codes, words, offsets, voter_of)), batch.column(2).slice(start, length), pa.array(found, pa.list_(pa.string()))],
                        names=["doc_id", "votes", "toxic", "tokens"])
        return run

    everything = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("int").alias("toxic"))
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic")
    said = said.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    voted = everything.mapInArrow(observe(False), schema).select("doc_id", "votes").join(said, "doc_id", "left")  # ids and votes alone are shuffled
    left = {(r["votes"], -1 if r["toxic"] is None else r["toxic"]): r["n"] for r in voted.groupBy("votes", "toxic").agg(F.count("*").alias("n")).collect()}  # at most 3 * 2^N_VOTERS rows
    keys = [k for k, n in left.items() if n > 0]
    seen, said_as = np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64)
    model = LabelModel().fit(seen, np.array([left[k] for k in keys], float), said_as)

    n_unknown = sum(n for (_, label), n in left.items() if label < 0)
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) < min(1.0, max_unlabelled / max(n_unknown, 1)) * (1 << 30)
    unlabelled = everything.select("doc_id").filter(drawn).join(said.select("doc_id"), "doc_id", "left_anti")  # about max_unlabelled ids, drawn from ids alone
    sample = everything.join(F.broadcast(unlabelled.distinct()), "doc_id", "left_semi")
    to_fit = known.join(F.broadcast(_chosen(said, max_labelled).select("doc_id")), "doc_id", "left_semi")  # at most max_labelled ids
    examples = to_fit.mapInArrow(observe(True), schema).unionByName(sample.mapInArrow(observe(True), schema))
    posterior = dict(zip(keys, model.posterior(seen, said_as).tolist(), strict=True))
    table = docs.sparkSession.createDataFrame([(v, label, p) for (v, label), p in posterior.items()], "votes long, label int, p double")
    examples = examples.withColumn("label", F.coalesce("toxic", F.lit(-1))).join(table, ["votes", "label"]).select("tokens", "p")
    both = examples.select("tokens", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - F.col("p")).alias("w")))).alias("e"))
    both = written(both.select("tokens", "e.y", "e.w").filter("w > 0.001"), "toxic-examples")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "tokens", "features")
    fitted = LogisticRegression(labelCol="y", weightCol="w", regParam=3e-4, elasticNetParam=0.5, maxIter=100, standardization=False).fit(vectors.setBinary(True).transform(both))
    weights = fitted.coefficients.toArray().tolist()
    return ToxicityModel(float(fitted.intercept), dict(zip(vocabulary, weights, strict=True)))
