"""Token-ID files: Parquet with one list of ids per document, in ascending doc_id order.

Layout of a store: ``tokens/`` holds (part, doc_id, local_start, n_tokens, ids),
a file or more per part, range-partitioned and sorted by doc_id; ``index/`` holds
a row per part with the number of ids in all parts before it. Ids are dictionary
encoded; the metadata columns are delta encoded (format version 2). Row groups
and pages are small enough that, with the page indexes that the writer adds,
a read of some documents or of metadata alone touches little else.

Cases: a null text is empty (its end id is still written); null doc_ids come
first; rows of equal doc_id are ordered by a digest of their text; very long
texts are one list; an empty table makes an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, text_slices
from .tokens import ENCODE_BYTES, encoder_for, tokenizer_spec, with_end

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
_METADATA = ("part", "doc_id", "local_start", "n_tokens")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, row_group_bytes: int = ROW_GROUP_BYTES,
                 page_bytes: int = PAGE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, and write a store at ``path``."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(tokenizer_spec(tokenizer_path))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = source.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = encoder_for(spec.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = column(batch, 1)
            for start, length in text_slices(texts, ENCODE_BYTES):
                ids, counts = with_end(*encoder.encode(texts.slice(start, length)), end_id)
                ends = np.concatenate(([0], np.cumsum(counts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(length, part, np.int32)), batch.column(0).slice(start, length), pa.array(before + ends[:-1]), pa.array(counts.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=[*_METADATA, "ids"])
                before += int(ends[-1])

    writer = (dealt.mapInArrow(run, "part int, doc_id long, local_start long, n_tokens int, ids array<int>").write
              .option("compression", "zstd").option("parquet.writer.version", "v2")
              .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes))
    for name in _METADATA:
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.parquet(f"{path}/tokens")
    parts = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/index")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) of each document, without reading ids; start counts all ids before it."""
    return _started(spark, path).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids); a filter on doc_id reaches row groups and pages."""
    return _started(spark, path).select("doc_id", "start", "n_tokens", "ids")


def _started(spark: SparkSession, path: str) -> DataFrame:
    index = spark.read.parquet(f"{path}/index").select("part", F.col("start").alias("part_start"))
    tokens = spark.read.parquet(f"{path}/tokens").withColumn("n_tokens", F.col("n_tokens").cast("long"))
    return tokens.join(index, "part").withColumn("start", F.col("part_start") + F.col("local_start"))


def with_crc32(tokens: DataFrame, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``ids_crc32`` of each list's ids as little-endian 32-bit integers, in place of the list."""
    names = [c for c in tokens.columns if c != ids_col]
    source = tokens.select(*names, ids_col)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], crc32s(batch.column(len(names)))], names=[*names, "ids_crc32"])

    return source.mapInArrow(run, f"{kept}, ids_crc32 long")


def crc32s(lists: pa.Array) -> pa.Array:
    """crc32 of each list's ids."""
    ends = lists.offsets.to_numpy()
    data = memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B")
    return pa.array([zlib.crc32(data[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())
