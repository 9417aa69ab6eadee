"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are cut into ``blocks`` blocks of bits. Two fingerprints that
differ in at most ``max_bits`` bits agree on at least ``blocks - max_bits``
blocks, so each fingerprint is filed under every choice of that many blocks and
close pairs meet under one of them; the Hamming distance is then verified.

Equal fingerprints are one node from the start, so copies cost nothing. A key
that many fingerprints share (a large group of near copies) is cut into chunks,
and every pair of chunks is compared in a task of its own; a task emits at most
one link for each fingerprint it compares, never all pairs.

Cases: a null, empty or blank text has fingerprint zero and links like any
other; texts shorter than a shingle are one shingle; a null doc_id takes part
and gets the smallest non-null id it reaches (null if none); rows that share a
doc_id are linked by their own fingerprints; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, text_slices, written
from .components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
BLOCKS = 6
SEED = 42
#: Fingerprints of one key that are compared with each other at once.
CHUNK = 1024

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each shingle of the text's words, A-Z lower-cased; bytes.split has the word definition."""
    own = text.encode().lower().split()
    if not own:
        return []
    joined = b" ".join(own)
    if len(own) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    starts = [0, *ends[:-words].tolist()]
    return list(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, (ends[words - 1:] - 1).tolist(), strict=True)], repeat(SEED)))


def majority(hashes: list[list[int]]) -> np.ndarray:
    """One fingerprint for each list: the bits set in over half of its hashes."""
    counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
    flat = np.array([h for own in hashes for h in own], np.uint64)
    row = np.repeat(np.arange(len(hashes)), counts) * 256
    out = np.zeros(len(hashes), np.uint64)
    for k in range(8):
        byte = ((flat >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)
        ones = np.bincount(row + byte, minlength=len(hashes) * 256).reshape(-1, 256) @ _BITS
        for j in range(8):
            out |= (2 * ones[:, j] > counts).astype(np.uint64) << np.uint64(8 * k + j)
    return out


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): each row's 64-bit fingerprint as a signed long."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, 1)
            for start, length in text_slices(texts):
                fp = majority([shingle_hashes(t, shingle_words) for t in texts.slice(start, length).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, length), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """Bit masks of every choice of ``blocks - max_bits`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(own, blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _compare(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is close among these fingerprints, at most one for each."""
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
    label = np.arange(len(fps))
    while True:
        new = np.where(close, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            return fps[label != np.arange(len(fps))], fps[label[label != np.arange(len(fps))]]
        label = new


def links(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) of distinct fingerprints ``fp`` that connect all within ``max_bits`` bits."""
    masks = block_masks(blocks, max_bits)
    keys: list[Column] = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks)]
    filed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    shared = filed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("chunks", F.ceil(F.col("n") / chunk))
    dealt = (filed.join(shared, "key")
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
             .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
             .repartition("key", "a", "b").sortWithinPartitions("key", "a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((4, 0), np.int64)  # the group that the next batch may go on with
        for batch in _arrays(batches):
            rows = rest if batch is None else np.concatenate([rest, batch], axis=1)
            if not rows.shape[1]:
                continue
            new = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
            bounds = np.concatenate(([0], new, [rows.shape[1]]))
            if batch is not None:
                rest = rows[:, bounds[-2]:]
                bounds = bounds[:-1]
            fps, sizes = rows[3].view(np.uint64), np.diff(bounds)
            pair = bounds[:-1][sizes == 2]
            near = pair[np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= max_bits]
            us, vs = [fps[near]], [fps[near + 1]]
            for i in np.flatnonzero(sizes > 2):
                u, v = _compare(fps[bounds[i]:bounds[i + 1]], max_bits)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray | None]:
    for batch in batches:
        yield np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
    yield None


def _rooted(docs: DataFrame, shingle_words: int, max_bits: int, blocks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, root (the component's least fingerprint), component_id."""
    own = written(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), max_bits, blocks)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, blocks: int = BLOCKS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable by links)."""
    return _rooted(docs, shingle_words, max_bits, blocks, id_col, text_col).select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    """16 lower-case hexadecimal digits of a signed long's 64 bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with one document of each component: the row with its smallest doc_id.

    Of several rows with that id, the one with the least fingerprint stays. Components
    are told apart by their root: unlinked ones can share a component_id, or have none.
    """
    found = written(_rooted(docs, shingle_words, max_bits, blocks), "components")
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id").agg(F.min("fp").alias("fp"))
    ids = docs.schema["doc_id"].dataType
    keep = written(first.select(F.col("component_id").cast(ids).alias("doc_id"), "fp"), "kept")
    if not _repeats(found):
        keep = keep.select("doc_id")
        return docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")
    names = docs.columns
    with_fp = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, 2)
            fp = majority([shingle_hashes(t, shingle_words) for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["row", "id", "fp"])

    rows = with_fp.mapInArrow(run, f"row {with_fp.schema['row'].dataType.simpleString()}, id {ids.simpleString()}, fp long")
    keep = keep.select(F.col("doc_id").alias("kept_id"), F.col("fp").alias("kept_fp"))
    kept = rows.join(keep, rows["id"].eqNullSafe(keep["kept_id"]) & (rows["fp"] == keep["kept_fp"]), "left_semi")
    return kept.dropDuplicates(["id", "fp"]).select("row.*")


def _repeats(found: DataFrame) -> bool:
    """Whether several rows share a doc_id."""
    n = found.agg(F.count("*").alias("n")).first()["n"]
    return n != found.select("doc_id").distinct().count()
