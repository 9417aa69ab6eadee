"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in each shard.

Distinct vectors are dealt to shards by hash. In a shard vectors are inserted in
growing batches, long ones first: a greedy beam search through the graph so far
proposes neighbours (every node that it expanded), and relaxed distance pruning
keeps diverse ones: walking from the nearest outwards, a candidate goes if it is
``RELAX`` times nearer to a kept one than to the new node. Links back are added,
and a node that gets more than ``DEGREE`` is pruned the same way. A node that
cannot be reached from an entry gets a link from the nearest reached one, so
every vector is indexed. A query walks each shard's graph with a beam, measures
what the beam holds in double precision, and the shards' best are merged.

Inner products become distances by one more component that brings all vectors of
a shard to the same norm; a query has 0 there, so its order is by inner product.

The index is a table of nodes with their vectors and links, written once. A
search deals nodes and a copy of the queries to the shards; a task holds one
shard (``SHARD_ROWS`` vectors, a bound) and streams the queries past it in blocks.
Equal vectors are one node; their ids are put back afterwards, for each node and
each query as many of the smallest as its result can hold, so a vector that a
third of all rows share is neither one task's work nor a knot in the graph.

Cases: vectors that are null, empty, zero or hold a null or non-finite component
take no part; vectors are compared with those of their own length; a query finds
all other rows, its copies included; rows that share an id are rows of their own;
null ids are found, last among ties, but are no queries; with fewer candidates
all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors in a shard, about; there are at least ``MIN_SHARDS`` shards, so that as many tasks can work.
SHARD_ROWS, MIN_SHARDS = 65_536, 16
#: Links of a node, beams while building and searching, factor of the relaxed pruning.
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX = 32, 64, 128, 1.2
#: Nodes expanded at once in a beam; nodes or queries that walk the graph together.
EXPANDED, TOGETHER = 4, 256
#: Nodes, evenly spread over the order of insertion, from which a walk starts, so that far groups of near vectors are all in sight.
ENTRIES = 32


class Graph:
    """A directed graph over vectors of equal norm (rows of ``x``), built by inserting them in order."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> None:
        x = np.asarray(x, np.float64)
        norms = np.einsum("ij,ij->i", x, x)
        self.top = float(norms.max(initial=0.0))
        scale = 1 / np.sqrt(self.top) if self.top else 1.0
        self.scale, self.dims = scale, x.shape[1]
        self.x = np.concatenate((x * scale, np.sqrt(np.maximum(1 - norms * scale * scale, 0))[:, None]), axis=1).astype(np.float32)
        self.links = np.full((len(x), degree), -1, np.int32)
        self.degree, self.relax = degree, relax
        self._build(beam)

    @classmethod
    def of_links(cls, x: np.ndarray, links: list[np.ndarray]) -> Graph:
        """A graph that was built before, for searches."""
        self = cls.__new__(cls)
        top = np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0.0))
        self.scale, self.dims = 1 / top if top else 1.0, x.shape[1]
        self.x = np.concatenate((x * self.scale, np.zeros((len(x), 1))), axis=1).astype(np.float32)
        self.links = np.full((len(x), max(map(len, links), default=0) or 1), -1, np.int32)
        for i, own in enumerate(links):
            self.links[i, :len(own)] = own
        return self

    def neighbours(self) -> list[np.ndarray]:
        return [own[own >= 0] for own in self.links]

    def query(self, q: np.ndarray, beam: int) -> np.ndarray:
        """Nodes in each query's beam, nearest first; -1 where there are no more."""
        top = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
        flat = np.concatenate((q / np.where(top > 0, top, 1), np.zeros((len(q), 1))), axis=1).astype(np.float32)
        return self.walk(flat, beam)[0]

    def walk(self, q: np.ndarray, beam: int, size: int | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Greedy beam search through the first ``size`` nodes: (beams, what each round expanded as (query, node, nearness))."""
        n, rows = len(q), np.arange(len(q))
        start = entries(len(self.x) if size is None else size)[:beam]
        ids, near, done = np.full((n, beam), -1, np.int32), np.full((n, beam), -np.inf, np.float32), np.ones((n, beam), bool)
        seen = np.zeros((n, len(self.x)), bool)
        first = q @ self.x[start].T
        order = np.argsort(-first, axis=1, kind="stable")
        ids[:, :len(start)], near[:, :len(start)], done[:, :len(start)], seen[:, start] = start[order], np.take_along_axis(first, order, axis=1), False, True
        expanded = []
        while len(rows):
            pick = np.argsort(done[rows], axis=1, kind="stable")[:, :EXPANDED]
            r = np.repeat(rows, pick.shape[1])
            at = pick.ravel()
            new = ~done[r, at]
            r, at = r[new], at[new]
            done[r, at] = True
            node = ids[r, at]
            expanded.append((r, node, near[r, at]))
            to = self.links[node]
            r, to = np.repeat(r, to.shape[1]), to.ravel()
            fresh = to >= 0
            fresh[fresh] = ~seen[r[fresh], to[fresh]]
            r, to = r[fresh], to[fresh]
            pair = np.unique(r * np.int64(len(self.x)) + to)
            r, to = pair // len(self.x), pair % len(self.x)
            seen[r, to] = True
            s = np.einsum("ij,ij->i", self.x[to], q[r])
            better = s > near[r, -1]  # than the beam's last
            r, to, s = r[better], to[better], s[better]
            if len(r):
                touched, first, count = np.unique(r, return_index=True, return_counts=True)
                place = np.repeat(np.arange(len(touched)), count), beam + np.arange(len(r)) - np.repeat(first, count)
                width = beam + int(count.max())
                i2, s2, d2 = np.full((len(touched), width), -1, np.int32), np.full((len(touched), width), -np.inf, np.float32), np.ones((len(touched), width), bool)
                i2[:, :beam], s2[:, :beam], d2[:, :beam] = ids[touched], near[touched], done[touched]
                i2[place], s2[place], d2[place] = to, s, False
                best = np.argsort(-s2, axis=1, kind="stable")[:, :beam]
                ids[touched], near[touched], done[touched] = (np.take_along_axis(a, best, axis=1) for a in (i2, s2, d2))
            rows = rows[~done[rows].all(axis=1)]
        return ids, expanded

    def _build(self, beam: int) -> None:
        at = 1
        while at < len(self.x):
            new = np.arange(at, min(len(self.x), at + max(1, min(TOGETHER, at // 8))))
            _, expanded = self.walk(self.x[new], beam, at)
            who, node, near = (np.concatenate(a) for a in zip(*expanded, strict=True))
            self._relink(new, who, node, near)
            back = self.links[new]
            source, target = np.repeat(new, back.shape[1])[back.ravel() >= 0], back[back >= 0]
            self._link_back(source.astype(np.int32), target)
            at = int(new[-1]) + 1
        self._reach(beam)

    def _link_back(self, source: np.ndarray, target: np.ndarray) -> None:
        """Add links target -> source; full nodes are pruned."""
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        has = (self.links[nodes] >= 0).sum(axis=1)
        nth = np.arange(len(target)) - np.repeat(first, count)
        room = np.repeat(has + count <= self.degree, count)
        self.links[target[room], (np.repeat(has, count) + nth)[room]] = source[room]
        full = np.flatnonzero(has + count > self.degree)
        for part in np.array_split(full[np.argsort(count[full], kind="stable")], max(1, -(-len(full) // TOGETHER))):
            if not len(part):
                continue
            old = self.links[nodes[part]]
            mine = np.isin(np.repeat(np.arange(len(nodes)), count), part)
            number = np.full(len(nodes), -1)
            number[part] = np.arange(len(part))
            who = np.concatenate((np.repeat(np.arange(len(part)), (old >= 0).sum(axis=1)), number[np.repeat(np.arange(len(nodes)), count)[mine]]))
            node = np.concatenate((old[old >= 0], source[mine]))
            self._relink(nodes[part], who, node, np.einsum("ij,ij->i", self.x[node], self.x[nodes[part]][who]))

    def _relink(self, nodes: np.ndarray, who: np.ndarray, node: np.ndarray, near: np.ndarray) -> None:
        """Robust pruning: links of ``nodes[i]`` become diverse ones of its candidates (who = i, node, inner product)."""
        keep = node != nodes[who]
        who, node, near = who[keep], node[keep], near[keep]
        order = np.lexsort((node, -near, who))
        who, node, near = who[order], node[order], near[order]
        count = np.bincount(who, minlength=len(nodes))
        place = who, np.arange(len(who)) - (np.cumsum(count) - count)[who]
        ids, own = np.full((len(nodes), int(count.max(initial=0))), -1, np.int32), np.full((len(nodes), int(count.max(initial=0))), -1.0, np.float32)
        ids[place], own[place] = node, near
        own, alive = 2 - 2 * own, ids >= 0  # squared distances, all norms being 1
        points = self.x[np.maximum(ids, 0)]
        between = 2 - 2 * (points @ points.transpose(0, 2, 1))
        out, rows = np.full((len(nodes), self.degree), -1, np.int32), np.arange(len(nodes))
        for k in range(min(self.degree, ids.shape[1])):
            first = alive.argmax(axis=1)
            has = alive[rows, first]
            if not has.any():
                break
            out[has, k] = ids[rows[has], first[has]]
            alive &= self.relax**2 * between[rows, first] > own
            alive[rows, first] = False
        self.links[nodes] = out

    def _reach(self, beam: int) -> None:
        """Link nodes that no path from an entry leads to."""
        reached = np.zeros(len(self.x), bool)
        front = entries(len(self.x))
        while True:
            while len(front):
                reached[front] = True
                to = np.unique(self.links[front])
                front = to[to >= 0]
                front = front[~reached[front]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return
            lost = lost[:TOGETHER]
            hosts = self.walk(self.x[lost], beam)[0][:, 0]
            wider = np.full((len(self.x), int(np.unique(hosts, return_counts=True)[1].max())), -1, np.int32)
            used = np.zeros(len(self.x), np.int64)
            for node, host in zip(lost.tolist(), hosts.tolist(), strict=True):
                wider[host, used[host]] = node
                used[host] += 1
            self.links = np.concatenate((self.links, wider), axis=1)
            front = lost


def entries(size: int) -> np.ndarray:
    return np.unique(np.linspace(0, size - 1, ENTRIES).astype(np.int64)) if size else np.empty(0, np.int64)


def by_norm(x: np.ndarray) -> np.ndarray:
    """Order of insertion: long vectors, which most inner products favour, first."""
    return np.argsort(-np.einsum("ij,ij->i", x, x), kind="stable")


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x, key): vectors that take part, as doubles, with a 128-bit hash that names equal ones."""
    x = F.transform(F.col(vec_col).cast("array<double>"), lambda e: e + F.lit(0.0))  # -0.0 becomes 0.0
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = rows.filter(F.col("x").isNotNull() & finite & F.exists("x", lambda e: e != 0))
    return rows.withColumn("key", F.unhex(F.md5(F.col("x").cast("string").cast("binary"))))


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of the batches whose first ``n_keys`` columns are the same all along."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(n_keys)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield tuple(keys[a].tolist()), batch.slice(a, b - a)


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def build_index(distinct: DataFrame, n_rows: int, shard_rows: int = SHARD_ROWS, min_shards: int = MIN_SHARDS, degree: int = DEGREE,
                beam: int = BUILD_BEAM, relax: float = RELAX) -> tuple[DataFrame, int]:
    """(nodes, number of shards) for ``n_rows`` distinct vectors (key, x, least: the smallest id).

    Nodes: shard, dims, node, key, least, x, links; a graph for each shard and length.
    """
    shards = max(min_shards, -(-n_rows // shard_rows))
    schema = "shard int, dims int, node int, key binary, least long, x array<double>, links array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def built(own: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(parts)
            whole = whole.take(pa.array(by_norm(_matrix(whole.column("x").combine_chunks(), own[1]))))
            keys, least, lists = (whole.column(c).combine_chunks() for c in ("key", "least", "x"))
            links = Graph(_matrix(lists, own[1]), degree, beam, relax).neighbours()
            for at in range(0, len(keys), 4096):
                some = links[at:at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), own[0], np.int32)), pa.array(np.full(len(some), own[1], np.int32)), pa.array(np.arange(at, at + len(some), dtype=np.int32)),
                     keys.slice(at, len(some)), least.slice(at, len(some)), lists.slice(at, len(some)), pa.array(some, pa.list_(pa.int32()))],
                    names=["shard", "dims", "node", "key", "least", "x", "links"])

        now, parts = None, []
        for own, piece in _runs(batches, 2):
            if own != now and parts:
                yield from built(now, parts)
                parts = []
            now = own
            parts.append(piece)
        if parts:
            yield from built(now, parts)

    dealt = distinct.select(_shard(F.col("key"), shards).alias("shard"), F.size("x").alias("dims"), "key", "least", "x")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dims", "key")
    return written(dealt.mapInArrow(run, schema), "graph"), shards


def search_index(nodes: DataFrame, shards: int, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query, key, least, score): for each of ``queries`` (key, x) the ``k`` best nodes of each shard, ties to the smaller id."""
    spread = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spread = spread.select("shard", F.size("x").alias("dims"), F.lit(1).alias("kind"), F.lit(0).alias("node"), "key", F.lit(None).cast("long").alias("least"), "x", F.lit(None).cast("array<int>").alias("links"))
    both = nodes.select("shard", "dims", F.lit(0).alias("kind"), "node", "key", "least", "x", "links").unionByName(spread)
    both = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dims", "kind", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, graph, keys, least, order_of, x = None, [], None, None, None, None, None
        for (shard, dims, kind), piece in _runs(batches, 3):
            if (shard, dims) != now:
                now, parts, graph = (shard, dims), [], None
            if kind == 0:
                parts.append(piece)
                continue
            if graph is None:
                if not parts:  # no vector of this length here
                    continue
                whole = pa.Table.from_batches(parts)
                keys, least, x, parts = whole.column("key").combine_chunks(), whole.column("least").combine_chunks(), _matrix(whole.column("x").combine_chunks(), dims), []
                order_of = np.argsort(pc.array_sort_indices(least, order="ascending").to_numpy())  # nulls last
                graph = Graph.of_links(x, [np.asarray(own, np.int32) for own in whole.column("links").combine_chunks().to_pylist()])
            for at in range(0, piece.num_rows, TOGETHER):
                some = piece.slice(at, TOGETHER)
                q = _matrix(some.column("x"), dims)
                found = graph.query(q, max(beam, k))
                row, place = np.nonzero(found >= 0)
                node = found[row, place]
                score = np.einsum("ij,ij->i", x[node], q[row])
                order = np.lexsort((order_of[node], -score, row))
                row, node, score = row[order], node[order], score[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                yield pa.RecordBatch.from_arrays([some.column("key").take(pa.array(row[best])), keys.take(pa.array(node[best])), least.take(pa.array(node[best])), pa.array(score[best])],
                                                 names=["query", "key", "least", "score"])

    return both.mapInArrow(run, "query binary, key binary, least long, score double")


def _first(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each ``by``, with their ``place`` from 1; cut in each task before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= n)


def nearest(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            search_beam: int = SEARCH_BEAM, **index_options) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product found for each row that ``is_query`` of the id names."""
    rows = written(usable(vectors, id_col, vec_col), "vectors")
    distinct = written(rows.groupBy("key").agg(F.any_value("x").alias("x"), F.min("vec_id").alias("least")), "distinct-vectors")
    nodes, shards = build_index(distinct, distinct.count(), **index_options)
    asked = written(rows.filter(is_query(F.col("vec_id"))).select("vec_id", "key"), "queries")
    distinct_asked = distinct.join(asked.select("key").distinct(), "key", "left_semi")
    by_id = [F.col("vec_id").asc_nulls_last()]
    members = _first(rows.select("key", "vec_id"), "key", by_id, k + 1).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id"))).alias("members"))
    found = _first(search_index(nodes, shards, distinct_asked, k + 1, search_beam), "query", [F.col("score").desc(), F.col("least").asc_nulls_last(), F.col("key")], k + 1)
    each = found.select("query", "key", "score").join(members, "key").select("query", "key", "score", F.explode("members").alias("m")).select("query", "key", "score", "m.vec_id")
    best = _first(each, "query", [F.col("score").desc(), *by_id], k + 1)
    best = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", (F.col("key") == F.col("query")).alias("copy")))).alias("found"))
    results = asked.join(best, asked["key"] == best["query"])
    own = F.filter("found", lambda f: f["copy"] & (f["vec_id"] == F.col("vec_id")))  # of rows that share id and vector, one is the query itself
    others = F.filter("found", lambda f: F.size(own).eqNullSafe(F.lit(0)) | (f["place"] != F.get(own, F.lit(0))["place"]))
    listed = results.select(F.col("vec_id").alias("query_id"), F.slice(others, 1, k).alias("others"))
    return listed.select("query_id", F.posexplode("others").alias("at", "f")).select("query_id", (F.col("at") + 1).alias("rank"), "f.vec_id", "f.score")
