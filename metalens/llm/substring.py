"""Removal of repeated passages by difference-cover anchors.

A window of ``words`` words is removed if the same words start earlier in the
corpus. Hashing every window of the corpus and shuffling it would move several
times the input. Instead anchors of ``words - period + 1`` words are hashed only
at positions whose residue modulo ``period`` lies in a difference cover D: for
any two positions i and j there is a shift d < period with (i + d) and (j + d)
both in D modulo the period, so two equal windows share an aligned anchor.

1. Anchors are grouped by hash. Only positions whose anchor occurs again go on.
2. Each document extends its repeated anchors to the windows around them; those
   are grouped by a 96-bit hash, and the first occurrence of each is found.
3. A document loses the words of its candidate windows that aren't first.

Hot passages: each slice of a task folds the occurrences that it sees of one
hash into one row before the shuffle, in steps 1 and 2, so a passage that a
third of all documents share sends one row per slice to its group. Groups are
read in sorted order, a row at a time, and never gathered.

Cases: null or word-free texts give no words; documents of fewer than ``words``
words keep all; a null doc_id comes before all ids; rows sharing a doc_id are
ordered by a digest of their text, and rows equal in id and text count as one
document (each is returned, with the same result); empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, covered_by, per_text, room, split_words, text_slices, window_hashes, word_hashes, written

WINDOW_WORDS = 20
#: A perfect difference cover: every residue mod 13 is a difference of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)

_REP = np.iinfo(np.int64).min  # marks a row that stands for repeated anchors of a slice
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _position(tie: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (tie.astype(np.int64) << 32) | pos


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Document order in ``doc`` and ``tie``; every column of ``docs`` in ``row``."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(doc.alias("doc"))
    repeated = not ids.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") if repeated else F.lit(0)
    return docs.select(doc.alias("doc"), tie.alias("tie"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _anchors(keyed: DataFrame, words: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """(h, doc, at): anchors at cover positions.

    An anchor met once in its slice has at >= 0. Those met again there are known
    to repeat: they get at < 0 and an ``h`` that spreads documents, and one row
    with at = _REP tells the group of their hash.
    """
    width, in_cover = words - period + 1, np.isin(np.arange(period), cover)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_docs, ties, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), column(batch, 2)
            for start, length in text_slices(texts):
                codes, vocabulary, offsets = split_words(texts.slice(start, length))
                n_words = np.diff(offsets)
                h = window_hashes(word_hashes(vocabulary)[codes], width)
                row = np.repeat(np.arange(length), n_words)[:len(h)]
                pos = np.arange(len(h)) - offsets[row]
                at = np.flatnonzero(in_cover[pos % period] & (room(offsets)[:len(h)] >= width) & (n_words[row] >= words))
                h, row = h[at].view(np.int64), row[at] + start
                where, doc = _position(ties[row], pos[at]), all_docs[row]
                again = pd.Series(h).duplicated(keep=False).to_numpy()
                reps = np.unique(h[again])
                spread = doc * np.int64(0x9E3779B97F4A7C1) ^ np.int64(0x5851F42D4C957F2D)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((np.where(again, spread, h), reps))), pa.array(np.concatenate((doc, np.zeros(len(reps), np.int64)))),
                     pa.array(np.concatenate((np.where(again, -1 - where, where), np.full(len(reps), _REP))))], names=["h", "doc", "at"])

    return keyed.select("doc", "tie", "text").mapInArrow(run, "h long, doc long, at long")


def _repeated(anchors: DataFrame) -> DataFrame:
    """(doc, at) of every anchor whose hash occurs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, rest_again = np.empty((3, 0), np.int64), False  # the last row, as the next may equal it
        for batch in _with_end(batches):
            rows = rest if batch is None else np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            if not rows.shape[1]:
                continue
            same = rows[0, 1:] == rows[0, :-1]
            again = np.concatenate((same, [False])) | np.concatenate(([rest_again if rest.shape[1] else False], same))
            if batch is not None:
                rest, rest_again = rows[:, -1:], bool(again[-1])
                rows, again = rows[:, :-1], again[:-1]
            known = (rows[2] < 0) & (rows[2] != _REP)
            keep = known | (again & (rows[2] >= 0))
            at = np.where(known, -1 - rows[2], rows[2])[keep]
            yield pa.RecordBatch.from_arrays([pa.array(rows[1][keep]), pa.array((at >> 32).astype(np.int32)), pa.array((at & 0xFFFFFFFF).astype(np.int32))], names=["doc", "tie", "pos"])

    return anchors.repartition("h").sortWithinPartitions("h").mapInArrow(run, "doc long, tie int, pos int")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _lists(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the elements of a list column."""
    c = c if c.type == pa.list_(pa.int32()) else c.cast(pa.list_(pa.int32()))
    return pc.list_parent_indices(c).to_numpy().astype(np.int64), c.flatten().to_numpy().astype(np.int64)


def _candidates(anchors: pa.Array, offsets: np.ndarray, words: int, period: int) -> np.ndarray:
    """Which words begin a window that holds a repeated anchor at a shift below the period."""
    row, pos = _lists(anchors)
    first = np.maximum(offsets[row] + pos - period + 1, offsets[row])
    marked = covered_by(first, offsets[row] + pos + 1 - first, int(offsets[-1]))
    return marked & (room(offsets) >= words)


def _windows(found: DataFrame, words: int, period: int) -> DataFrame:
    """(h, h2, doc, at) of candidate windows; of those that a slice has in common, only the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("anchors")))
            docs, ties, texts = batch.column("doc").to_numpy(), batch.column("tie").to_numpy(), column(batch, batch.schema.get_field_index("text"))
            for start, length in text_slices(texts):
                codes, vocabulary, offsets = split_words(texts.slice(start, length))
                hashes = word_hashes(vocabulary)
                at = np.flatnonzero(_candidates(batch.column("anchors").slice(start, length), offsets, words, period))
                row = np.searchsorted(offsets, at, side="right") - 1
                h = window_hashes(hashes[codes], words)[at].view(np.int64)
                h2 = window_hashes(((hashes * _SECOND) ^ (hashes >> np.uint64(17)))[codes], words)[at]
                frame = pd.DataFrame({"h": h, "h2": (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32), "doc": docs[row + start], "at": _position(ties[row + start], at - offsets[row])})
                frame = frame.sort_values(["doc", "at"]).drop_duplicates(["h", "h2"])
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return found.mapInArrow(run, "h long, h2 int, doc long, at long")


def _firsts(windows: DataFrame) -> DataFrame:
    """(doc, tie, pos) of the first window of each hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            h, h2, doc, at = (c.to_numpy() for c in batch.columns)
            if not len(h):
                continue
            new = np.concatenate(([last != (h[0], h2[0])], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])))
            last = (h[-1], h2[-1])
            yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array((at[new] >> 32).astype(np.int32)), pa.array((at[new] & 0xFFFFFFFF).astype(np.int32))], names=["doc", "tie", "pos"])

    return windows.repartition("h").sortWithinPartitions("h", "h2", "doc", "at").mapInArrow(run, "doc long, tie int, pos int")


def without_repeats(docs: DataFrame, words: int = WINDOW_WORDS, period: int = PERIOD, cover: tuple[int, ...] = COVER,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``row`` (its columns as they are), ``kept_text``, ``n_words``, ``n_removed``.

    ``kept_text`` has the kept words, joined by one space.
    """
    if words < period or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("cover must be a difference cover of the period, and the period at most the window")
    keyed = _keyed(docs, id_col, text_col)
    by_doc = ["doc", "tie"]
    anchors = written(_repeated(_anchors(keyed, words, period, cover)).groupBy(*by_doc).agg(F.collect_list("pos").alias("anchors")), "anchors")
    found = keyed.join(anchors, by_doc, "left")
    firsts = _firsts(_windows(found, words, period)).groupBy(*by_doc).agg(F.collect_list("pos").alias("firsts"))
    kind = keyed.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, batch.schema.get_field_index("text"))
            for start, length in text_slices(texts):
                part = batch.slice(start, length)
                codes, vocabulary, offsets = split_words(texts.slice(start, length))
                again = _candidates(pc.fill_null(part.column("anchors"), []) if part.column("anchors").null_count else part.column("anchors"), offsets, words, period)
                row, pos = _lists(part.column("firsts"))
                again[offsets[row] + pos] = False
                gone = covered_by(np.flatnonzero(again), words, len(codes))
                removed = per_text(gone, offsets)
                plain = texts.slice(start, length).to_pylist()
                kept = []
                for i, n in enumerate(removed):
                    own = codes[offsets[i]:offsets[i + 1]]
                    kept.append(" ".join([vocabulary[c] for c in own[~gone[offsets[i]:offsets[i + 1]]]]) if n else b" ".join(plain[i].encode().split()).decode())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(kept, pa.string()), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64())], names=["row", "kept_text", "n_words", "n_removed"])

    return found.join(firsts, by_doc, "left").mapInArrow(run, f"row {kind}, kept_text string, n_words long, n_removed long")


def strip_repeats(docs: DataFrame, words: int = WINDOW_WORDS, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with repeated passages cut from the texts that have any (and ``length_col``, if there, set anew)."""
    out = without_repeats(docs, words, text_col=text_col)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col(f"row.`{text_col}`"))
    new = {text_col: text, length_col: F.when(cut, F.length("kept_text").cast(docs.schema[length_col].dataType)).otherwise(F.col(f"row.`{length_col}`")) if length_col in docs.columns else None}
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
