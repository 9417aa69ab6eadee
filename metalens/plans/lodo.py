"""Leave-one-dataset-out evaluation as one plan, without a held-out x rows product.

Average-regret scores are sums over datasets, and a dataset's regrets depend
only on its own rows. So the score of pipeline ``p`` with dataset ``h`` held
out is ``(S_p - s_hp) / (C_p - c_hp)``: global sums minus ``h``'s own part.
Only pipelines evaluated on ``h`` (the set ``E_h``) change; all others keep
their global score, whose ranking ``G`` is computed once.

The ``k`` best unchanged pipelines for ``h`` are the first ``k`` entries of
``G`` outside ``E_h``. With ``q_1 < q_2 < ...`` the global positions of
``E_h``'s members, they lie within the first ``T_h = k + j_h`` positions, where
``j_h = #{i : q_i - i < k}``. Each held-out dataset therefore reads at most
``k + |E_h|`` rows of ``G`` (a range expanded by ``sequence`` and an equi-join
on the position), and the final top-k per dataset runs over those plus its
adjusted ``E_h`` rows. Total work is linear in the evaluations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metalens.functions.regret import ROUND_DIGITS, ranking_score, rnd, valid_score
from metalens.operators.sequence import blocked_rank
from metalens.operators.similarity import unit_rows, usable_vectors
from metalens.operators.store import global_row_number
from metalens.session import materialize
from metalens.plans.recommend import with_regret


def lodo_average_regret(evals: DataFrame, pipelines: DataFrame, k: int = 25, min_evals: int = 10,
                        metric: str = "neg_log_loss", higher_is_better: bool = True) -> DataFrame:
    """Top-``k`` average-regret recommendations for every held-out dataset.

    Returns held_out_id, rank, pipeline_id, ranking_score, n_evals and
    heldout_score: the held-out dataset's own mean stored score for the
    recommended pipeline (null when never evaluated there).
    """
    r = with_regret(evals, metric).withColumn("u", ranking_score("regret", higher_is_better))
    # The (dataset, pipeline) aggregate feeds every branch below; it is written
    # once so the evaluations are scanned once.
    own = materialize(r.groupBy("dataset_id", "pipeline_id")
                      .agg(F.sum("u").alias("s_own"), F.count(F.lit(1)).alias("c_own"),
                           F.avg("score").alias("own_score")))
    tot = own.groupBy("pipeline_id").agg(F.sum("s_own").alias("s_all"), F.sum("c_own").alias("c_all"))
    glob = (pipelines.select("pipeline_id").join(tot, "pipeline_id", "left")
            .select("pipeline_id",
                    F.coalesce("c_all", F.lit(0)).cast("long").alias("c_all"),
                    F.coalesce("s_all", F.lit(0.0)).alias("s_all"))
            .withColumn("ranking_score", rnd(F.when(F.col("c_all") > 0, F.col("s_all") / F.col("c_all"))
                                             .otherwise(F.lit(0.0)))))

    # G: eligible pipelines by global score, numbered 1..|G| (distributed sort
    # and zipWithIndex over the pipeline dimension).
    g = global_row_number(glob.filter(F.col("c_all") >= min_evals),
                          [F.col("ranking_score").desc(), F.col("pipeline_id").asc()], "grank")

    held = own.select(F.col("dataset_id").alias("held_out_id")).distinct()
    mine = own.select(F.col("dataset_id").alias("held_out_id"), "pipeline_id", "s_own", "c_own")

    # j_h from the global positions of E_h's eligible members; their ranks
    # inside each held-out dataset come from blocked counts, not a window
    # over the whole (possibly huge) set.
    eg = mine.join(g.select("pipeline_id", "grank"), "pipeline_id")
    eg = blocked_rank(eg, "held_out_id", "grank", "i")
    j = eg.groupBy("held_out_id").agg(F.sum(F.when(F.col("grank") - F.col("i") < k, 1).otherwise(0)).alias("j"))
    reach = (held.join(j, "held_out_id", "left")
             .select("held_out_id", (F.lit(k) + F.coalesce("j", F.lit(0))).alias("t")))
    window_rows = reach.select("held_out_id", F.explode(F.sequence(F.lit(1), F.col("t"))).alias("grank"))
    unchanged = (window_rows.join(g.select("grank", "pipeline_id", "ranking_score", F.col("c_all").alias("n_evals")),
                                  "grank")
                 .join(mine.select("held_out_id", "pipeline_id"), ["held_out_id", "pipeline_id"], "left_anti")
                 .select("held_out_id", "pipeline_id", "ranking_score", "n_evals"))

    adjusted = (mine.join(glob.select("pipeline_id", "s_all", "c_all"), "pipeline_id")
                .withColumn("n_evals", F.col("c_all") - F.col("c_own"))
                .filter(F.col("n_evals") >= min_evals)
                .select("held_out_id", "pipeline_id",
                        rnd(F.when(F.col("n_evals") > 0, (F.col("s_all") - F.col("s_own")) / F.col("n_evals"))
                            .otherwise(F.lit(0.0))).alias("ranking_score"),
                        "n_evals"))

    both = unchanged.unionByName(adjusted)
    w = Window.partitionBy("held_out_id").orderBy(F.col("ranking_score").desc(), F.col("pipeline_id").asc())
    top = both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    scores = own.select(F.col("dataset_id").alias("held_out_id"), "pipeline_id", F.col("own_score").alias("heldout_score"))
    return (top.join(scores, ["held_out_id", "pipeline_id"], "left")
            .select("held_out_id", F.col("rank").cast("long").alias("rank"), "pipeline_id", "ranking_score",
                    F.col("n_evals").cast("long").alias("n_evals"), "heldout_score"))


def _own_scores(evals: DataFrame, metric: str) -> DataFrame:
    """(held_out_id, pipeline_id, heldout_score): each dataset's mean stored score of a pipeline."""
    e = evals.filter(F.col("metric") == metric)
    return e.groupBy(F.col("dataset_id").alias("held_out_id"), "pipeline_id").agg(F.avg("score").alias("heldout_score"))


def lodo_top_similarity(evals: DataFrame, neighbours: DataFrame, k: int = 25, metric: str = "neg_log_loss") -> DataFrame:
    """Top-``k`` most-similar-datasets recommendations for every held-out dataset.

    ``neighbours`` has (query_id, dataset_id, rank): the n datasets nearest to each
    held-out one, itself excluded, so nothing of it takes part. Each neighbour
    lends its own ranking's next ``k div n`` pipelines a round; every dataset's
    ranking is cut at the depth that any list can reach, once for all, and meets
    the neighbour lists in one equi-join. Returns held_out_id, rank, pipeline_id,
    dataset_id (the lender) and heldout_score.
    """
    held = neighbours.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    near = neighbours.join(held, "query_id").withColumn("c", F.greatest(F.floor(F.lit(k) / F.col("n")), F.lit(1)))
    # a dataset that lends c a round is asked for ceil(k / c) rounds at most, fewer than k + c pipelines
    best = evals.filter((F.col("metric") == metric) & valid_score("score")).groupBy("dataset_id", "pipeline_id").agg(F.max("score").alias("best"))
    w = Window.partitionBy("dataset_id").orderBy(F.col("best").desc(), F.col("pipeline_id").asc())
    ranked = best.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= 2 * k)
    lists = near.select("query_id", "dataset_id", F.col("rank").alias("sim_rank"), "c").join(ranked, "dataset_id")
    lists = lists.filter(F.col("pos") <= F.ceil(F.lit(k) / F.col("c")) * F.col("c")).withColumn("round", F.floor((F.col("pos") - 1) / F.col("c")))
    first = lists.groupBy("query_id", "pipeline_id").agg(F.min(F.struct("round", "sim_rank", "pos", "dataset_id")).alias("p"))
    order = Window.partitionBy("query_id").orderBy("p.round", "p.sim_rank", "p.pos")
    top = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return (top.select(F.col("query_id").alias("held_out_id"), F.col("rank").cast("long").alias("rank"), "pipeline_id", F.col("p.dataset_id").alias("dataset_id"))
            .join(_own_scores(evals, metric), ["held_out_id", "pipeline_id"], "left"))


def lodo_utility(evals: DataFrame, sims: DataFrame, k: int = 25, metric: str = "neg_log_loss", higher_is_better: bool = True) -> DataFrame:
    """Top-``k`` similarity-weighted recommendations for every held-out dataset.

    ``sims`` has (query_id, dataset_id, value): each held-out dataset's similarity
    to every other one. A held-out dataset is not among its own others, so its part
    is out of sums and counts alike. Evaluations are summed per (dataset,
    pipeline) before they meet the similarities; the join is that of the stated
    held-out datasets with all evaluations. Returns held_out_id, rank, pipeline_id, utility, n_evals and heldout_score.
    """
    r = with_regret(evals, metric).withColumn("u", ranking_score("regret", higher_is_better))
    own = r.groupBy("dataset_id", "pipeline_id").agg(F.sum("u").alias("s"), F.count(F.lit(1)).alias("c"))
    pairs = own.join(sims, "dataset_id")
    scores = pairs.groupBy("query_id", "pipeline_id").agg((F.sum(F.col("value") * F.col("s")) / F.sum("c")).alias("utility"), F.sum("c").alias("n_evals"))
    scores = scores.withColumn("utility", rnd("utility"))
    order = Window.partitionBy("query_id").orderBy(F.col("utility").desc(), F.col("pipeline_id").asc())
    top = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return (top.select(F.col("query_id").alias("held_out_id"), F.col("rank").cast("long").alias("rank"), "pipeline_id", "utility", F.col("n_evals").cast("long").alias("n_evals"))
            .join(_own_scores(evals, metric), ["held_out_id", "pipeline_id"], "left"))


#: Held-out datasets that a task compares at once; evaluations that stream past them, about; rows of these in one matrix; least tasks.
HELD_BLOCK, STREAM_ROWS, CHUNK, MIN_TASKS = 8192, 1 << 20, 512, 16
_NO_PIPELINE = -(1 << 63)


class _Held:
    """A task's held-out datasets: their vectors by length, and the best ``k`` (utility, pipeline) of each so far."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], k: int, digits: int) -> None:
        self.k, self.scale, self.best = k, 10.0 ** digits, []
        self.ids, code = np.unique(ids, return_inverse=True)
        dims = np.fromiter(map(len, vectors), np.int64, len(vectors))
        self.by_dims = {}
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == d)
            rows = rows[np.argsort(code[rows], kind="stable")]
            own, first, times = np.unique(code[rows], return_index=True, return_counts=True)
            self.by_dims[d] = own, first, times, unit_rows(np.stack([vectors[r] for r in rows]))
        self.least = np.full(len(self.ids), -np.inf)  # the k-th utility of each

    def rounded(self, x: np.ndarray) -> np.ndarray:
        x *= self.scale
        np.rint(x, out=x)
        x /= self.scale
        return x

    def sums(self, datasets: np.ndarray, vectors: list[np.ndarray], pipelines: np.ndarray, s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pipelines, sums of similarity * s, counts) of rows in the order of pipelines; one row of sums for each held-out dataset."""
        names, place = np.unique(pipelines, return_inverse=True)
        total, n = np.zeros((len(self.ids), len(names))), np.zeros((len(self.ids), len(names)), np.int64)
        at = np.minimum(np.searchsorted(self.ids, datasets), len(self.ids) - 1)
        dims = np.fromiter(map(len, vectors), np.int64, len(vectors))
        for d, (own, first, times, q) in self.by_dims.items():
            rows = np.flatnonzero(dims == d)
            if not len(rows):
                continue
            value = self.rounded(q @ unit_rows(np.stack([vectors[r] for r in rows])).T)
            if len(own) < len(q):  # an id that comes repeatedly counts each time
                value = np.add.reduceat(value, first, axis=0)
            mine = np.minimum(np.searchsorted(own, at[rows]), len(own) - 1)
            itself = np.flatnonzero(self.ids[own[mine]] == datasets[rows])
            value[mine[itself], itself] = 0.0
            value *= s[rows]
            seen, starts = np.unique(place[rows], return_index=True)
            total[np.ix_(own, seen)] += np.add.reduceat(value, starts, axis=1)
            n[np.ix_(own, seen)] += times[:, None] * np.add.reduceat(c[rows], starts)
            np.subtract.at(n, (own[mine[itself]], place[rows][itself]), times[mine[itself]] * c[rows][itself])
        return names, total, n

    def offer(self, names: np.ndarray, total: np.ndarray, n: np.ndarray) -> None:
        """Finished pipelines, ascending over all calls (so that ties keep the smaller)."""
        with np.errstate(divide="ignore", invalid="ignore"):
            utility = self.rounded(np.where(n > 0, total / n, -np.inf))
        row, col = np.nonzero(utility > self.least[:, None])
        self.best.append((row, names[col], utility[row, col], n[row, col]))
        if sum(len(b[0]) for b in self.best) > 4 * self.k * len(self.ids):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        row, name, utility, n = (np.concatenate(p) for p in zip(*self.best, strict=True))
        order = np.lexsort((name, -utility, row))
        row = row[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = order[nth < self.k]
        last = order[nth == self.k - 1]
        self.least[np.concatenate([r for r, *_ in self.best])[last]] = utility[last]
        out = np.concatenate([b[0] for b in self.best])[keep], name[keep], utility[keep], n[keep]
        self.best = [out]
        return out


def lodo_utility_of_vectors(evals: DataFrame, vectors: DataFrame, is_held_out: Callable[[Column], Column], k: int = 25, metric: str = "neg_log_loss",
                            higher_is_better: bool = True, digits: int = ROUND_DIGITS, held_block: int = HELD_BLOCK, stream_rows: int = STREAM_ROWS,
                            chunk: int = CHUNK) -> DataFrame:
    """``lodo_utility`` with the cosine of ``vectors`` (dataset_id, embedding), rounded to ``digits``.

    Neither the similarities nor their products with evaluations become rows.
    Held-out datasets are dealt to blocks and pipelines to shards. A task holds one
    block's vectors; the evaluations of one shard stream past them in the order of
    pipelines, each with its dataset's vector, so that a task keeps a pipeline's
    sums only until it ends, and sends on ``k`` rows per held-out dataset. The work
    is held-out datasets x evaluations, in matrix products; shuffled are the
    evaluations once per block and the held-out vectors once per shard.
    """
    r = with_regret(evals, metric).withColumn("u", ranking_score("regret", higher_is_better))
    own = r.groupBy("dataset_id", "pipeline_id").agg(F.sum("u").alias("s"), F.count(F.lit(1)).alias("c"))
    known = usable_vectors(vectors)
    asked = known.filter(is_held_out(F.col("id")))
    blocks = max(1, -(-asked.count() // held_block))
    shards = max(-(-evals.filter(F.col("metric") == metric).count() // stream_rows), -(-MIN_TASKS // blocks))
    none, zero = F.lit(_NO_PIPELINE), F.lit(0).cast("long")
    held = asked.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                        F.lit(0).alias("kind"), none.alias("p"), "id", "x", F.lit(0.0).alias("s"), zero.alias("c"))
    facts = (own.join(known, F.col("dataset_id").cast("long") == F.col("id")).withColumn("p", F.coalesce(F.col("pipeline_id").cast("long"), none))
             .select(F.explode(F.sequence(zero, F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("p"), F.lit(shards)).cast("int").alias("shard"),
                     F.lit(1).alias("kind"), "p", "id", "x", "s", "c"))
    both = held.unionByName(facts).withColumn("part", (F.col("block") * shards + F.col("shard")).cast("int")).drop("block", "shard")
    both = both.repartitionById(blocks * shards, F.col("part")).sortWithinPartitions("part", "kind", "p", "id").select("kind", "p", "id", "x", "s", "c")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, queries, held, rest = [], [], None, None
        for batch in batches:
            n_held = int((batch.column(0).to_numpy() == 0).sum())  # these come first
            lists = batch.column(3)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            x = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            p, name, s, c = (batch.column(i).to_numpy() for i in (1, 2, 4, 5))
            if n_held:
                ids.append(name[:n_held].copy())
                queries += [v.copy() for v in x[:n_held]]
            if n_held == batch.num_rows or not ids:
                continue
            held = held or _Held(np.concatenate(ids), queries, k, digits)
            for a in range(n_held, len(p), chunk):
                b = min(a + chunk, len(p))
                names, total, n = held.sums(name[a:b], x[a:b], p[a:b], s[a:b], c[a:b])
                if rest is not None and rest[0][0] == names[0]:
                    total[:, :1] += rest[1]
                    n[:, :1] += rest[2]
                elif rest is not None:
                    held.offer(*rest)
                held.offer(names[:-1], total[:, :-1], n[:, :-1])
                rest = names[-1:], total[:, -1:], n[:, -1:]  # more rows of it may follow
        if rest is not None:
            held.offer(*rest)
            row, p, utility, n = held.cut()
            for a in range(0, len(row), 65_536):
                part = slice(a, a + 65_536)
                yield pa.RecordBatch.from_arrays([pa.array(held.ids[row[part]]), pa.array(p[part]), pa.array(utility[part]), pa.array(n[part])],
                                                 names=["query_id", "p", "utility", "n_evals"])

    scores = both.mapInArrow(run, "query_id long, p long, utility double, n_evals long")
    scores = scores.withColumn("pipeline_id", F.when(F.col("p") != none, F.col("p")).cast(evals.schema["pipeline_id"].dataType)).withColumn("utility", rnd("utility", digits))
    order = Window.partitionBy("query_id").orderBy(F.col("utility").desc(), F.col("pipeline_id").asc())
    top = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return (top.select(F.col("query_id").alias("held_out_id"), F.col("rank").cast("long").alias("rank"), "pipeline_id", "utility", "n_evals")
            .join(_own_scores(evals, metric), ["held_out_id", "pipeline_id"], "left"))


def lodo_summary(recs: DataFrame, evals: DataFrame, metric: str = "neg_log_loss") -> DataFrame:
    """Per held-out dataset: best stored score among its recommendations and its regret."""
    from metalens.operators.store import dataset_bounds
    from metalens.functions.regret import normalized_regret
    b = dataset_bounds(evals.filter(F.col("metric") == metric)).withColumnRenamed("dataset_id", "held_out_id")
    best = recs.groupBy("held_out_id").agg(F.max("heldout_score").alias("best_score"),
                                          F.count("heldout_score").alias("n_scored"))
    return (best.join(b, "held_out_id")
            .select("held_out_id", "best_score", F.col("n_scored").cast("long").alias("n_scored"),
                    F.when(F.col("best_score").isNull(), F.lit(1.0))
                    .otherwise(normalized_regret("best_score", "min_score", "max_score")).alias("regret")))
