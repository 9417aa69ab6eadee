"""Benchmark decontamination: a broadcast hash set of the benchmark's word n-grams.

Each task scans the windows of its documents against the set, verifies every
hash hit on the words themselves, and reports hit words and items. Documents
are neither shuffled nor joined. The set is broadcast only up to
``max_broadcast_bytes``; a larger benchmark is split by window hash into blocks
under that bound, documents are scanned once per block, and the blocks' hits
are merged per document.

Cases: null or word-free texts have no words and no hits; benchmark rows with
null id or text, or without words, have no windows; repeated documents each
give a row; repeated items count once; empty tables give empty or clean results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, covered_by, per_text, room, split_words, text_slices, translated, window_hashes, word_hashes, written

WINDOW_WORDS = 10
MAX_BROADCAST_BYTES = 64 << 20
_ROW_BYTES = 120  # a window's share of dictionaries and lists, beside its text

#: Lower-cases A-Z; every other ASCII character that is no letter or digit ends a word.
NORMALISE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_FILTER_BITS = 20


def benchmark_windows(items: DataFrame, n: int = WINDOW_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (window, n_words, item_id); an item of fewer than ``n`` words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = translated(column(batch, 1), NORMALISE), batch.column(0).to_pylist()
            codes, words, offsets = split_words(texts)
            found = []
            for i, item in enumerate(ids):
                own = [words[c] for c in codes[offsets[i]:offsets[i + 1]]]
                width = min(n, len(own))
                found += [(" ".join(own[j:j + width]), width, item) for j in range(len(own) - width + 1 if own else 0)]
            found = list(dict.fromkeys(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))],
                names=["window", "n_words", "item_id"])

    kept = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).dropna()
    return kept.mapInArrow(run, "window string, n_words int, item_id long").distinct()


class WindowSet:
    """One block of benchmark windows, as it is broadcast."""

    def __init__(self, rows: list) -> None:
        self.items: dict[str, list[int]] = {}
        by_width: dict[int, set[str]] = {}
        for window, width, item in rows:
            self.items.setdefault(window, []).append(item)
            by_width.setdefault(width, set()).add(window)
        self.hashes = {}
        for width, windows in by_width.items():
            split = [w.split(" ") for w in windows]
            flat = word_hashes([x for s in split for x in s])
            self.hashes[width] = np.unique(window_hashes(flat, width)[::width]) if width else np.empty(0, np.uint64)

    def filters(self) -> dict[int, np.ndarray]:
        """By width: which leading hash bits occur."""
        out = {}
        for width, hashes in self.hashes.items():
            out[width] = np.zeros(1 << _FILTER_BITS, bool)
            out[width][hashes >> np.uint64(64 - _FILTER_BITS)] = True
        return out


def _scan(texts: pa.Array, known: WindowSet, filters: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Per text: number of words, of hit words, hit windows (start, words) and items."""
    codes, words, offsets = split_words(translated(texts, NORMALISE))
    left, hashes = room(offsets), word_hashes(words)[codes] if len(codes) else np.empty(0, np.uint64)
    hits = []
    for width, sorted_hashes in known.hashes.items():
        h = window_hashes(hashes, width)
        at = np.flatnonzero(filters[width][h >> np.uint64(64 - _FILTER_BITS)] & (left[:len(h)] >= width))
        if len(at):
            place = np.minimum(np.searchsorted(sorted_hashes, h[at]), len(sorted_hashes) - 1)
            at = at[sorted_hashes[place] == h[at]]
        for i in at:
            window = " ".join([words[c] for c in codes[i:i + width]])
            if window in known.items:
                hits.append((int(i), width, known.items[window]))
    starts = np.array([h[0] for h in hits], np.int64)
    hit = covered_by(starts, np.array([h[1] for h in hits], np.int64), len(codes))
    spans: list = [[] for _ in range(len(texts))]
    items: list = [set() for _ in range(len(texts))]
    for (i, width, of), row in zip(hits, np.searchsorted(offsets, starts, side="right") - 1, strict=True):
        spans[row].append((i - int(offsets[row]), width))
        items[row].update(of)
    return np.diff(offsets), per_text(hit, offsets), spans, items


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))


def _blocks(windows: DataFrame, max_bytes: int) -> list[DataFrame]:
    size = windows.agg(F.sum(F.octet_length("window") + F.lit(_ROW_BYTES))).first()[0] or 0
    n = -(-size // max_bytes) or 1
    n = n if n == 1 else 2 * n  # hash blocks are uneven
    return [windows.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == b) if n > 1 else windows for b in range(n)]


def find_benchmark(docs: DataFrame, items: DataFrame, n: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text",
                   max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, spans (word start, words), sorted item_ids, items_sha256.

    ``spans`` are the verified benchmark windows in the document's words.
    ``items_sha256`` digests the item ids sorted as strings, joined by commas.
    """
    windows = written(benchmark_windows(items, n), "benchmark-windows")
    blocks = _blocks(windows, max_broadcast_bytes)
    sc = docs.sparkSession.sparkContext

    def scanned(source: DataFrame, block: DataFrame) -> DataFrame:
        known = sc.broadcast(WindowSet([tuple(r) for r in block.toLocalIterator()]))
        keys = source.schema[0].name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = known.value.filters()
            for batch in batches:
                texts = column(batch, 1)
                for start, length in text_slices(texts):
                    n_words, n_hit, spans, found = _scan(texts.slice(start, length), known.value, filters)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, length), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                         pa.array(spans, _SPANS), pa.array([sorted(x) for x in found], pa.list_(pa.int64()))],
                        names=[keys, "n_words", "n_hit", "spans", "item_ids"])

        kind = source.schema[0].dataType.simpleString()
        return source.mapInArrow(run, f"`{keys}` {kind}, n_words long, n_hit long, spans array<struct<start:int,words:int>>, item_ids array<long>")

    if len(blocks) == 1:
        out = scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), blocks[0])
    else:
        out = _merged(docs, blocks, scanned, id_col, text_col)
    digest = F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ","), 256)
    return out.withColumn("items_sha256", digest)


def _merged(docs: DataFrame, blocks: list[DataFrame], scanned, id_col: str, text_col: str) -> DataFrame:
    """Hits of all blocks put together; rows of equal id and text share their hits."""
    key = F.struct(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))
    source = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    parts = None
    for block in blocks:
        part = scanned(source, block)
        parts = part if parts is None else parts.unionByName(part)
    one = parts.groupBy("key").agg(
        F.max("n_words").alias("n_words"),
        (F.count("*") / F.lit(len(blocks))).cast("long").alias("copies"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    words = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["words"] - 1)))
    return (one.withColumn("n_hit", F.size(F.array_distinct(words)).cast("long"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(F.col("key.doc_id").alias("doc_id"), "n_words", "n_hit", "spans", "item_ids"))


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = WINDOW_WORDS, max_hit_share: float = 0.0,
                      max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Documents whose share of hit words is at most ``max_hit_share``; all columns stay as they are.

    Scans each batch and filters it in place, so that texts are not shuffled.
    """
    blocks = _blocks(written(benchmark_windows(items, n), "benchmark-windows"), max_broadcast_bytes)
    at = docs.columns.index("text")
    out = docs
    if max_hit_share and len(blocks) > 1:
        raise ValueError("a share of hit words needs all windows in one block; raise max_broadcast_bytes")
    for block in blocks:  # with no share allowed, a document goes with its first block that hits
        known = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in block.toLocalIterator()]))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            filters = known.value.filters()
            for batch in batches:
                texts = column(batch, at)
                for start, length in text_slices(texts):
                    n_words, n_hit, _, _ = _scan(texts.slice(start, length), known.value, filters)
                    yield batch.slice(start, length).filter(pa.array(n_hit <= max_hit_share * n_words))

        out = out.mapInArrow(run, docs.schema)
    return out


