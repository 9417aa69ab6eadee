"""Helpers shared by the operators: scratch tables and word splitting on Arrow."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

#: Text handled at once inside a task; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Row groups of written tables; a writing task holds about one in memory.
ROW_GROUP_BYTES = 32 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder the session names (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one intermediate feeds several jobs or a loop: it cuts the
    lineage, and a lost executor costs a re-read, not a recomputation.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_local(key: str, make: Callable[[], object]) -> object:
    """``make()``, once for each Python worker process."""
    kept = sys.modules.setdefault("_metalens_worker", types.ModuleType("_metalens_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def column(batch: pa.RecordBatch, i: int = 0) -> pa.Array:
    """Column ``i`` as plain strings, null as the empty text."""
    c = batch.column(i)
    return pc.fill_null(c if c.type == pa.string() else c.cast(pa.string()), "")


def text_slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive rows holding up to ``max_bytes`` of text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, len(texts)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield start, stop - start
        start = stop


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text.

    Returns the codes of all words in order, the distinct words that the codes
    number, and the ``len(texts) + 1`` offsets of the texts' words.
    """
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy()
    enc = lists.flatten().dictionary_encode()
    codes, words = enc.indices.to_numpy(zero_copy_only=False), enc.dictionary.to_pylist()
    offsets = (offsets - offsets[0]).astype(np.int64)
    if "" in words:  # left by white space at either end
        keep = codes != words.index("")
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
    return codes, words, offsets


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """The texts with every byte replaced by ``table`` (which leaves bytes from 0x80 alone)."""
    _, offsets, data = texts.buffers()
    data = pa.py_buffer(data.to_pybytes().translate(table)) if data is not None else pa.py_buffer(b"")
    return pa.StringArray.from_buffers(len(texts), offsets, data, offset=texts.offset)


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in words), dtype=np.uint64, count=len(words))


_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the pair (a, b)."""
    x = (a * _K1) ^ ((b << np.uint64(31)) | (b >> np.uint64(33)))
    x = (x ^ (x >> np.uint64(29))) * _K2
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive entries, from hashes of halves."""
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    power, covered, out = hashes, 0, None
    size = 1
    while True:
        if width & size:
            part = power[covered:]
            out = part if out is None else mixed(out[:len(part)], part[:len(out)])
            covered += size
        if covered == width:
            return out[:len(hashes) - width + 1]
        power = mixed(power[:-size], power[size:])
        size *= 2


def room(offsets: np.ndarray) -> np.ndarray:
    """For each word, how many words its text has from it on."""
    lengths = np.diff(offsets)
    return np.repeat(offsets[1:], lengths) - np.arange(offsets[-1])


def covered_by(starts: np.ndarray, width: np.ndarray | int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window beginning at one of ``starts``."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + width, -1)
    return np.cumsum(marks[:-1]) > 0


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text's words."""
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[offsets])
