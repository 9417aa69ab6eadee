"""Best-fit packing of token pieces into sequences, with large-item matching.

Lengths are at most the capacity, so the whole corpus is summed up by how many
pieces each length has (one aggregate, at most ``capacity`` numbers). The plan is
made on those numbers, whatever the corpus's size: first pieces above a third
of the capacity, longest first, are matched: each joins the fullest sequence of
one large piece that has room, so a sequence holds at most two; then smaller
pieces, longest first, go to the sequences with the smallest gap that fits. All
pieces of a length are placed together, as runs over ranges of sequences.

A piece finds its run by its rank among the pieces of its length. Ranks are the
piece's count within the task that cut it, written with it, plus the number of
such pieces in the parts before; so nothing is sorted or gathered by length, and
a length that most pieces share is no hot key.

Cases: a null text is empty (its end id is one piece of length 1); longer texts
than the capacity are cut, all pieces but the first full; repeated rows and null
ids are packed like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, text_slices, written
from .tokens import ENCODE_BYTES, encoder_for, tokenizer_spec, with_end

CAPACITY = 2048


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
        with_ids: bool = True) -> DataFrame:
    """Pieces (part, nth, doc_id, piece, start, length, ids_crc32, ids) of at most ``capacity`` ids, written once.

    (part, length, nth) is unique: nth counts the pieces of that length in the part.
    ``with_ids`` tells whether the ids themselves are written, for ``sequences``.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_spec(tokenizer_path))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = encoder_for(spec.value), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = column(batch, 1)
            for begin, rows in text_slices(texts, ENCODE_BYTES):
                ids, counts = with_end(*encoder.encode(texts.slice(begin, rows)), end_id)
                pieces = -(-counts // capacity)
                row = np.repeat(np.arange(rows), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = counts - (pieces - 1) * capacity
                length = np.where(piece == 0, first[row], capacity)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                nth = _counted(length, seen)
                ends = np.concatenate(([0], np.cumsum(length)))
                data = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
                crcs = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns = [pa.array(np.full(len(row), part, np.int32)), pa.array(nth), batch.column(0).slice(begin, rows).take(pa.array(row)), pa.array(piece.astype(np.int32)),
                           pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names=["part", "nth", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])

    schema = "part int, nth long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return written(source.mapInArrow(run, schema), "pieces")


def _counted(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many pieces of the same length came before each; ``seen`` goes on counting."""
    order = np.argsort(length, kind="stable")
    ranked = length[order]
    first = np.searchsorted(ranked, ranked)
    out = np.empty(len(length), np.int64)
    out[order] = seen[ranked] + np.arange(len(length)) - first
    seen += np.bincount(length, minlength=len(seen))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, first sequence, offset): rank r >= first rank goes to first sequence + r - first rank.

    Best fit in order of falling length. Large pieces come first, so while they
    are placed every open sequence has one and the best fit is their matching.
    """
    runs: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free ids: ranges of sequences
    opened = 0
    for length in range(capacity, 0, -1):
        rank, n = 0, counts.get(length, 0)
        while rank < n:
            gap = next((g for g in range(length, capacity) if gaps.get(g)), None)
            if gap is None:  # as many new ones as hold the rest
                new = -(-(n - rank) // (capacity // length))
                gap, opened = capacity, opened + new
                gaps[gap].append((opened - new, opened))
            first, end = gaps[gap].pop()
            take = min(n - rank, end - first)
            runs.append((length, rank, first, capacity - gap))
            if first + take < end:
                gaps[gap].append((first + take, end))
            if gap > length:
                gaps[gap - length].append((first, first + take))
            rank += take
    return np.array(runs, np.int64).reshape(-1, 4)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (part, nth, length and any other columns) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counted = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    totals = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = plan(totals, capacity)
    runs = spark.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before.hint("merge"), ["length", "part"])  # grows with the parts, so it is never broadcast
    others = [c for c in pieces.columns if c not in ("length", "part", "nth")]
    source = ranked.select("length", (F.col("before") + F.col("nth")).alias("rank"), *others)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = runs.value
        keys = (known[:, 0] << 48) + known[:, 1]
        for batch in batches:
            length, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = known[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(own[:, 2] + rank - own[:, 1]), pa.array(own[:, 3])],
                                             names=["length", *others, "sequence_id", "offset"])

    return source.mapInArrow(run, f"{kept}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(docs, tokenizer_path, end_id, capacity, with_ids=False)
    return place(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from the pieces that ``cut`` wrote."""
    placed = place(pieces, capacity)
    inner = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(inner, lambda x: x["ids"])).alias("ids"))
