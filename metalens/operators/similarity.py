"""Dataset-to-dataset similarity, one query dataset against all stored ones.

Vectors are exploded to (dataset_id, pos, x). The query vector, exploded the
same way, has one row per dimension: its size is bounded by the vector length,
so it is broadcast, and every stored dimension row meets its query dimension
in an equi-join on ``pos``. One hash aggregate per dataset then yields dot
product, norms and squared distance at once. No pair of datasets is formed
beyond (query, stored), and no vector passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_vectors(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "dataset_id") -> DataFrame:
    return vectors.select(id_col, F.posexplode(vec_col).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def one_vs_all(vectors: DataFrame, query: DataFrame, vec_col: str = "embedding", id_col: str = "dataset_id",
               gamma: float = 1.0) -> DataFrame:
    """Similarity of each stored vector to the query vector.

    ``query`` has one row and the same vector column. Returns dataset_id,
    cosine, euclidean, kernel (``exp(-gamma * euclidean)``), dims. A stored
    vector whose length differs from the query's is an error (raised by the
    plan when its row is computed); so is a query that hasn't exactly one row.
    """
    if query.limit(2).count() != 1:
        raise ValueError("the query must have exactly one row")
    whole = Window.partitionBy()  # over the query's own dimension rows only
    q = (query.select(F.posexplode(vec_col).alias("pos", "q"))
         .withColumn("q", F.col("q").cast("double"))
         .withColumn("qq", F.sum(F.col("q") * F.col("q")).over(whole))
         .withColumn("q_dims", F.count(F.lit(1)).over(whole)))
    x = explode_vectors(vectors, vec_col, id_col)
    # Left join on pos: extra stored dimensions keep a null query value, so a
    # length mismatch is visible in the counts below.
    joined = x.join(F.broadcast(q), "pos", "left")
    agg = joined.groupBy(id_col).agg(
        F.sum(F.col("x") * F.col("q")).alias("dot"),
        F.sum(F.col("x") * F.col("x")).alias("xx"),
        F.sum((F.col("x") - F.col("q")) ** 2).alias("dd"),
        F.max("qq").alias("qq"),
        F.max("q_dims").alias("q_dims"),
        F.count(F.lit(1)).alias("dims"),
        F.count("q").alias("matched"))
    den = F.sqrt("xx") * F.sqrt("qq")
    same_shape = F.coalesce((F.col("dims") == F.col("q_dims")) & (F.col("matched") == F.col("dims")), F.lit(False))

    def checked(value):
        message = F.concat(F.lit(f"vector length differs from the query for {id_col}: "), F.col(id_col).cast("string"))
        return F.when(same_shape, value).otherwise(F.raise_error(message).cast("double"))

    return agg.select(
        id_col,
        checked(F.when(den > 0, F.col("dot") / den)).alias("cosine"),
        checked(F.sqrt("dd")).alias("euclidean"),
        checked(F.exp(F.lit(-gamma) * F.sqrt("dd"))).alias("kernel"))


def most_similar(sims: DataFrame, n: int, by: str = "cosine", id_col: str = "dataset_id") -> DataFrame:
    """The ``n`` most similar datasets with rank 1..n.

    Similarities sort descending, distances (``euclidean``) ascending.
    """
    ascending = by == "euclidean"
    order = [F.col(by).asc() if ascending else F.col(by).desc(), F.col(id_col).asc()]
    top = sims.filter(F.col(by).isNotNull()).orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


#: Stored vectors that a task holds while queries stream past them, about; and queries compared at once.
SHARD_ROWS, MIN_SHARDS, QUERY_BLOCK = 65_536, 16, 256


def usable_vectors(vectors: DataFrame, by: str = "cosine", vec_col: str = "embedding", id_col: str = "dataset_id") -> DataFrame:
    """(id, x): vectors without null or non-finite components; for the cosine, not all zero."""
    if by not in ("cosine", "euclidean", "kernel"):
        raise ValueError(f"no similarity {by}")
    x = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter(
        (F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))))
    return rows.filter(F.exists("x", lambda e: e != 0)) if by == "cosine" else rows


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` at length 1, whose inner products are cosines."""
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def many_vs_all(vectors: DataFrame, is_query: Callable[[Column], Column], n: int | None = None, by: str = "cosine", vec_col: str = "embedding",
                id_col: str = "dataset_id", gamma: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, dataset_id, value): each query dataset against all others, exactly.

    ``is_query`` names the queries by id. ``by`` is cosine, euclidean or kernel;
    ``n`` keeps each query's n nearest (ties: smaller id). Stored vectors are dealt
    to shards by hash, and a copy of the queries streams past each shard in blocks,
    so a task holds one shard and the work is queries x rows, in matrix products.
    A shard sends on n rows per query. Vectors that are null, or hold a null or
    non-finite component, take no part, nor do zero ones for the cosine; a dataset
    is compared with vectors of its own length.
    """
    rows = usable_vectors(vectors, by, vec_col, id_col)
    shards = max(MIN_SHARDS, -(-rows.count() // shard_rows))
    stored = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.size("x").alias("dims"), F.lit(0).alias("kind"), "id", "x")
    asked = rows.filter(is_query(F.col("id"))).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("x").alias("dims"), F.lit(1).alias("kind"), "id", "x")
    both = stored.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dims", "kind", "id")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, parts, own = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                shard, dims, kind = keys[a].tolist()
                ids = batch.column(3).slice(a, b - a).to_numpy(zero_copy_only=False)
                x = batch.column(4).slice(a, b - a).flatten().to_numpy().reshape(-1, dims)
                x = unit_rows(x) if by == "cosine" else x
                if (shard, dims) != now:
                    now, parts, own = (shard, dims), [], None
                if kind == 0:
                    parts.append((ids, x))
                    continue
                if own is None:
                    if not parts:
                        continue
                    own, parts = tuple(np.concatenate(p) for p in zip(*parts, strict=True)), []
                for at in range(0, len(ids), QUERY_BLOCK):
                    q, q_ids = x[at:at + QUERY_BLOCK], ids[at:at + QUERY_BLOCK]
                    if by == "cosine":
                        value = q @ own[1].T
                    else:
                        value = np.stack([np.sqrt(np.einsum("ij,ij->i", own[1] - v, own[1] - v)) for v in q])
                        value = np.exp(-gamma * value) if by == "kernel" else value
                    far = np.where(own[0][None, :] == q_ids[:, None], np.inf, value if by == "euclidean" else -value)
                    order = np.argsort(far, axis=1, kind="stable")[:, :n]  # stored ids ascend, so ties go to the smaller
                    row = np.repeat(np.arange(len(q)), order.shape[1])
                    col = order.ravel()
                    other = np.isfinite(far[row, col])
                    row, col = row[other], col[other]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(own[0][col]), pa.array(value[row, col])], names=["query_id", "dataset_id", "value"])

    out = both.mapInArrow(run, "query_id long, dataset_id long, value double")
    if n is None:
        return out
    order = Window.partitionBy("query_id").orderBy(F.col("value").asc() if by == "euclidean" else F.col("value").desc(), F.col("dataset_id").asc())
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
