"""Quality rules as a short-circuit cascade.

Every rule rejects documents by itself; a document is kept if no rule rejects
it, so the order never changes a verdict. The order is chosen for speed: on a
sample, each rule's cost (CPU time per row) and the rows it rejects are
measured, then rules are taken greedily by rejections per cost among the rows
that earlier rules leave. Tasks run the cascade on Arrow batches; a rule sees
only the rows that are still undecided.

Cases: a null or empty text has no words, lines or symbols and is rejected as
too short; very long texts are handled alone; repeated rows each get the same
verdict; an empty table gives an empty result (rules in their given order).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, covered_by, per_text, room, split_words, text_slices

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
#: Rows of the sample on which cost and selectivity are measured.
SAMPLE_ROWS = 2000

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


class View:
    """Texts of some rows, with what rules have asked about them so far."""

    def __init__(self, texts: pa.Array) -> None:
        self.texts = texts

    @cached_property
    def split(self) -> tuple[np.ndarray, list[str], np.ndarray]:
        return split_words(self.texts)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.split[2])

    @cached_property
    def vocabulary(self) -> pa.Array:
        return pa.array(self.split[1], pa.string())

    def summed(self, of_word: pa.Array) -> np.ndarray:
        """Sum over each text's words of a value given per distinct word."""
        codes, words, offsets = self.split
        return per_text(of_word.to_numpy(zero_copy_only=False).astype(np.int64)[codes], offsets) if len(words) else np.zeros(len(self.texts), np.int64)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.summed(pc.utf8_length(self.vocabulary))

    @cached_property
    def n_upper_words(self) -> np.ndarray:
        upper = pc.and_(pc.match_substring_regex(self.vocabulary, r"\p{Lu}"), pc.invert(pc.match_substring_regex(self.vocabulary, r"\p{Ll}")))
        return self.summed(upper)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(self.texts).to_numpy(zero_copy_only=False), dtype=np.int64)))
        joined = np.frombuffer("".join(self.texts.to_pylist()).encode(), np.uint8)
        return per_text(_IS_SYMBOL[joined], ends)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Per text: lines that have a word, and those of them equal to an earlier line."""
        lists = pc.split_pattern(self.texts, "\n")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        enc = lists.flatten().dictionary_encode()
        codes = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(codes):
            return np.zeros(len(self.texts), np.int64), np.zeros(len(self.texts), np.int64)
        worded = pc.match_substring_regex(enc.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[codes]
        text_of = np.repeat(np.arange(len(self.texts)), np.diff(offsets))
        again = pd.Series(text_of * len(enc.dictionary) + codes).duplicated().to_numpy()
        return per_text(worded, offsets), per_text(worded & again, offsets)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in windows of REPEAT_WINDOW words that their text has twice or more."""
        codes, _, offsets = self.split
        n, left = len(codes), room(offsets)
        ranks, size = codes.astype(np.int64), 1
        while size < REPEAT_WINDOW and len(ranks):  # number pairs of equal windows alike, then pairs of those
            ranks = pd.factorize(ranks[:-size] * (n + 1) + ranks[size:])[0]
            size *= 2
        at = np.flatnonzero(left[:len(ranks)] >= REPEAT_WINDOW)
        text_of = np.repeat(np.arange(len(self.texts)), np.diff(offsets))[at]
        twice = pd.Series(text_of * (n + 1) + ranks[at]).duplicated(keep=False).to_numpy()
        return per_text(covered_by(at[twice], REPEAT_WINDOW, n), offsets)

    @cached_property
    def n_echo_words(self) -> np.ndarray:
        """Words equal to the word before them."""
        codes, _, offsets = self.split
        same = np.zeros(len(codes), bool)
        same[1:] = codes[1:] == codes[:-1]
        same[offsets[:-1][self.n_words > 0]] = False
        return per_text(same, offsets)

    def take(self, keep: np.ndarray) -> View:
        out = View(self.texts.filter(pa.array(keep)))
        if "split" in self.__dict__:
            codes, words, offsets = self.split
            counts = np.diff(offsets)
            out.__dict__["split"] = codes[np.repeat(keep, counts)], words, np.concatenate(([0], np.cumsum(counts[keep])))
        return out


@dataclass(frozen=True)
class Rule:
    """``rejects(view)`` tells for each text whether this rule throws it out."""

    name: str
    rejects: Callable[[View], np.ndarray]


def too_short(v: View) -> np.ndarray:
    return v.n_words < MIN_WORDS


def repeats_itself(v: View) -> np.ndarray:
    return 100 * v.n_repeat_words > MAX_REPEAT_PERCENT * v.n_words


def odd_word_length(v: View) -> np.ndarray:
    """Mean word length under 3 or over 10 characters."""
    return (v.word_chars < 3 * v.n_words) | (v.word_chars > 10 * v.n_words)


def many_symbols(v: View) -> np.ndarray:
    """More than a symbol in ten words."""
    return 10 * v.n_symbols > v.n_words


def repeated_lines(v: View) -> np.ndarray:
    """Over half of the lines that have a word repeat an earlier one."""
    lines, again = v.lines
    return 2 * again > lines


def shouting(v: View) -> np.ndarray:
    """Over half of the words are upper case only."""
    return 2 * v.n_upper_words > v.n_words


def stammering(v: View) -> np.ndarray:
    """Over three words in ten equal the word before them."""
    return 10 * v.n_echo_words > 3 * v.n_words


BASE_RULES = (Rule("too_short", too_short), Rule("repeats_itself", repeats_itself))
RULES = (*BASE_RULES, Rule("odd_word_length", odd_word_length), Rule("many_symbols", many_symbols),
         Rule("repeated_lines", repeated_lines), Rule("shouting", shouting), Rule("stammering", stammering))


def passes(view: View, rules: tuple[Rule, ...]) -> np.ndarray:
    """Which texts no rule rejects; each rule looks at those the earlier ones left."""
    kept = np.arange(len(view.texts))
    total = len(kept)
    for rule in rules:
        if not len(kept):
            break
        good = ~rule.rejects(view)
        if not good.all():
            kept, view = kept[good], view.take(good)
    out = np.zeros(total, bool)
    out[kept] = True
    return out


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7, text_col: str = "text") -> tuple[Rule, ...]:
    """``rules`` in cascade order, from cost and selectivity on a sample of about ``sample_rows`` rows."""
    texts = docs.select(F.col(text_col).alias("text"))
    total = texts.count()
    if not total:
        return rules

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = column(batch)
            for start, length in text_slices(all_texts):
                part = all_texts.slice(start, length)
                mask, costs = np.zeros(length, np.int64), []
                for i, rule in enumerate(rules):
                    began = time.process_time()
                    mask |= rule.rejects(View(part)).astype(np.int64) << i
                    costs.append(time.process_time() - began)
                found, counts = np.unique(mask, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(counts), pa.array([costs if k == 0 else [0.0] * len(rules) for k in range(len(found))], pa.list_(pa.float64()))],
                    names=["mask", "n", "costs"])

    sample = texts.sample(min(1.0, sample_rows / total), seed) if sample_rows < total else texts
    measured = sample.mapInArrow(measure, "mask long, n long, costs array<double>")
    rows = measured.groupBy("mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("costs")[i]).alias(f"c{i}") for i in range(len(rules)))).collect()
    left = {r["mask"]: r["n"] for r in rows}  # at most a row for each combination of rules
    cost = [max(sum(r[f"c{i}"] for r in rows), 1e-9) for i in range(len(rules))]
    order: list[int] = []
    while len(order) < len(rules):
        gain = {i: sum(n for m, n in left.items() if m >> i & 1) / cost[i] for i in range(len(rules)) if i not in order}
        best = max(gain, key=lambda i: (gain[i], -cost[i]))
        order.append(best)
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return tuple(rules[i] for i in order)


def judge(docs: DataFrame, rules: tuple[Rule, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the base statistics of the whole text, ``base_failed`` and ``kept``."""
    rules = ordered(docs, text_col=text_col) if rules is None else rules
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, 1)
            for start, length in text_slices(texts):
                v = View(texts.slice(start, length))
                kept = passes(v, rules)
                stats = [v.n_words, v.word_chars, v.n_symbols, v.lines[1], v.n_repeat_words]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, length), *(pa.array(x, pa.int64()) for x in stats), pa.array(too_short(v) | repeats_itself(v)), pa.array(kept)],
                    names=["doc_id", *names, "base_failed", "kept"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] | None = None, text_col: str = "text") -> DataFrame:
    """The documents that every rule lets pass, with all their columns."""
    rules = ordered(docs, text_col=text_col) if rules is None else rules
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, at)
            for start, length in text_slices(texts):
                yield batch.slice(start, length).filter(pa.array(passes(View(texts.slice(start, length)), rules)))

    return docs.mapInArrow(run, docs.schema)
