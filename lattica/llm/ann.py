"""Approximate nearest neighbours over learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts; a small
classifier learns which part a vector belongs to, indexes every row by its most
probable part, and routes each query to the several most probable ones, where
all rows are reranked by the exact measure.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, release, ship

#: Rows the index is fitted on at most; rows of it for each part at least; neighbours of a row in its graph.
SAMPLE, PART_SAMPLE, NEIGHBOURS = 16_384, 32, 12
#: Recall to reach on the sample when choosing how many parts a query visits.
RECALL = 0.93
HIDDEN, EPOCHS = 128, 40
#: Candidates a task holds at a time, queries that one copy of them serves, cells of a table of scores, and results held before they leave.
CANDIDATE_BLOCK, QUERY_BLOCK, CELLS, HELD = 4096, 1 << 16, 1 << 20, 1 << 20


def parts_for(rows: int, sample: int = SAMPLE) -> int:
    """Parts for so many rows: the power of two next to their square root, as far as the sample can fit them."""
    return max(1, min(1 << round(math.log2(max(1, rows)) / 2), min(rows, sample) // PART_SAMPLE))


@dataclass
class Router:
    """A one-layer network from vector to part, and the parts a query visits."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def nearest_in(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its ``k`` rows of largest inner product, itself not among them."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Cuts the neighbour graph into parts of near-equal size with few edges between them.

    Starts from balanced clusters and moves nodes to the part of most of their
    neighbours, the largest gain first, while the parts keep their size limits.
    """
    n = len(x)
    most = int(1.1 * n / parts) + 1
    centres = x[rng.choice(n, parts, replace=False)].copy()
    part = np.zeros(n, np.int64)
    for _ in range(8):
        affinity = x @ centres.T
        part[:] = -1
        room = np.full(parts, most)
        best = np.argsort(-affinity, axis=1)
        for i in np.argsort(-(affinity.max(axis=1) - np.median(affinity, axis=1))):
            k = next(k for k in best[i] if room[k])
            part[i] = k
            room[k] -= 1
        for k in range(parts):
            if (part == k).any():
                centres[k] = x[part == k].mean(axis=0)
    rows = np.repeat(np.arange(n), near.shape[1])
    ends = near.ravel()
    for _ in range(10):
        votes = np.zeros((n, parts))
        np.add.at(votes, (rows, part[ends]), 1)
        np.add.at(votes, (ends, part[rows]), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        count = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain):
            if gain[i] <= 0:
                break
            to = int(votes[i].argmax())
            if count[to] < most:
                count[part[i]] -= 1
                count[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, parts: int, top: int = 20, recall: float = RECALL, seed: int = 7) -> Router:
    """Fits partition and classifier on sample rows ``x``, then finds the fewest visits that reach ``recall`` among them."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    parts = max(1, min(parts, n // PART_SAMPLE))
    if parts == 1:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    scale = 1 / max(np.sqrt((x**2).sum(axis=1)).mean(), 1e-300)
    z = x * scale
    near = nearest_in(z, min(NEIGHBOURS, n - 1))
    part = balanced_parts(z, near, parts, rng)
    # A row's target: its own part and those of its neighbours.
    target = np.zeros((n, parts))
    target[np.arange(n), part] = 0.5
    np.add.at(target, (np.repeat(np.arange(n), near.shape[1]), part[near.ravel()]), 0.5 / near.shape[1])
    w1, w2 = rng.normal(size=(d, HIDDEN)) * np.sqrt(2 / d) * np.sqrt(d) / 4, rng.normal(size=(HIDDEN, parts)) * np.sqrt(1 / HIDDEN)
    weights = [w1, np.zeros(HIDDEN), w2, np.zeros(parts)]
    m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for a in range(0, n, 512):
            at = order[a : a + 512]
            h = np.maximum(z[at] @ weights[0] + weights[1], 0)
            s = h @ weights[2] + weights[3]
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            ds = (p - target[at]) / len(at)
            dh = (ds @ weights[2].T) * (h > 0)
            grads = [z[at].T @ dh + 1e-4 * weights[0], dh.sum(axis=0), h.T @ ds + 1e-4 * weights[2], ds.sum(axis=0)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                weights[k] -= 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    router = Router(weights[0] * scale, weights[1], weights[2], weights[3], parts)
    some = rng.choice(n, min(512, n), replace=False)
    s = router.scores(x)
    home, order = s.argmax(axis=1), np.argsort(-s, axis=1)
    truth = nearest_in(x, min(top, n - 1))[some]
    place = np.empty((len(some), parts), np.int64)
    np.put_along_axis(place, order[some], np.arange(parts)[None, :], axis=1)
    needed = np.take_along_axis(place, home[truth], axis=1)
    router.visits = next(k for k in range(1, parts + 1) if k == parts or (needed < k).mean() >= recall)
    return router


def vector_of(column: str) -> Column:
    return F.col(column).cast("array<double>")


def usable(column: str) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def best_of(query: np.ndarray, near: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` rows of each query by score, ties to the smaller id."""
    order = np.lexsort((near, -score, query))
    query, near, score = query[order], near[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.empty(0, np.int64)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[place < top], near[place < top], score[place < top]


def top_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's ``top`` rows by inner product in double precision, ties to the smaller id, its own id left out.

    Rows near the cut are scored again one by one, since a matrix product may
    round equal vectors differently.
    """
    parts = []
    step = max(1, CELLS // len(ids))
    for a in range(0, len(query_ids), step):
        own, q = query_ids[a : a + step], queries[a : a + step]
        s = q @ vectors.T
        s[own[:, None] == ids[None, :]] = -np.inf
        least = np.partition(s, len(ids) - top, axis=1)[:, len(ids) - top] if len(ids) > top else np.full(len(q), -np.inf)
        slack = 1e-9 * np.maximum(1.0, np.abs(least, where=np.isfinite(least), out=np.ones(len(least))))
        i, j = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
        exact = np.empty(len(i))
        for k in range(0, len(i), 1 << 14):
            exact[k : k + (1 << 14)] = (vectors[j[k : k + (1 << 14)]] * q[i[k : k + (1 << 14)]]).sum(axis=1)
        parts.append(best_of(own[i], ids[j], exact, top))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def search(rows: DataFrame, queries: Column, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, parts: int | None = None, recall: float = RECALL, with_visits: bool = False) -> DataFrame:
    """The ``top`` nearest rows found for each row of ``rows`` that ``queries`` holds for.

    The index is fitted on at most ``sample`` rows (those of least id hash);
    every row is indexed.  ``parts`` grow with the square root of the rows up
    to ``sample / PART_SAMPLE``; a query visits the fewest that gave ``recall``
    on the sample.  A part's rows are dealt in blocks of bounded size, each
    sent once for QUERY_BLOCK queries, so that neither a crowded part nor equal
    vectors meet in one task; queries stream past them.

    Vectors that are null, empty, zero, or hold null or non-finite components
    take no part, nor do those whose length is not the most common one (the
    greater of equally common), since they have no inner product with the
    others.  Null ids take no part; repeated ids are rows of their own as
    candidates, count once as a query (the first vector by value), and are
    never their own neighbour.  An empty table gives an empty result; other
    columns are not looked at.

    Returns (query_id, rank from 1, the neighbour's id, score), and with
    ``with_visits`` also ``parts``, ``visits`` (parts a query saw) and ``seen``
    (rows it was compared with).
    """
    spark = rows.sparkSession
    ship(spark)
    clean = rows.select(F.col(id_col).cast("long").alias("id"), vector_of(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(usable("v") & F.col("id").isNotNull())
    lengths = clean.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    schema = f"query_id long, rank int, {id_col} long, score double" + (", parts int, visits int, seen long" if with_visits else "")
    if not lengths:
        return spark.createDataFrame([], schema)
    d = lengths[0]["n"]
    clean = clean.where(F.size("v") == d)
    chosen = clean.select("v", F.xxhash64("id").alias("h")).orderBy("h", "v").limit(sample).select("v").toArrow()["v"].combine_chunks()
    router = fit_router(chosen.flatten().to_numpy().reshape(-1, d), parts or parts_for(lengths[0]["c"], sample), top, recall)
    visits = router.visits

    @F.arrow_udf("array<int>")
    def route(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in batches:
            x = some.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            s = router.scores(x)
            order = np.argsort(-s, axis=1, kind="stable")[:, :visits].astype(np.int32)
            yield pa.ListArray.from_arrays(np.arange(0, order.size + 1, visits, dtype=np.int32), pa.array(order.ravel()))

    indexed = checkpointed(clean.withColumn("parts", route.asNondeterministic()(F.col("v"))))
    placed = indexed.select("id", "v", F.col("parts")[0].alias("part"))
    asked = indexed.where("asks").groupBy("id").agg(F.min(F.struct("v", "parts")).alias("x")).select(F.col("id").alias("query_id"), "x.v", F.explode("x.parts").alias("part"))
    # One row for each part, numbered by the blocks of candidates and queries that come before.
    blocks = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy("part").agg(F.count(F.lit(1)).alias("m")), "part")
    blocks = blocks.select("part", "n", F.ceil(F.col("n") / CANDIDATE_BLOCK).cast("int").alias("cb"), F.ceil(F.col("m") / QUERY_BLOCK).cast("int").alias("qb"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    plan = F.broadcast(checkpointed(blocks.withColumn("before", F.coalesce(F.sum(F.col("cb") * F.col("qb")).over(before), F.lit(0)))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    turn = (F.col("before") + F.col("c") * F.col("qb") + F.col("q")).alias("turn")
    theirs = placed.join(plan, "part").select("*", F.pmod(F.xxhash64("id", "v"), F.col("cb")).cast("int").alias("c")).select("*", every("qb").alias("q")).select(turn, F.lit(0).alias("kind"), "id", "v")
    mine = asked.join(plan, "part").select("*", F.pmod(F.xxhash64("query_id"), F.col("qb")).cast("int").alias("q")).select("*", every("cb").alias("c")).select(turn, F.lit(1).alias("kind"), F.col("query_id").alias("id"), "v")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = theirs.unionByName(mine).withColumn("task", F.pmod("turn", F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("task")).sortWithinPartitions("turn", "kind").drop("task")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, ids, vectors = None, [], []

        def leave(found: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "id", "score"])

        for batch in batches:
            turns, kinds, own = (batch.column(k).to_numpy() for k in range(3))
            x = batch.column(3).flatten().to_numpy().reshape(-1, d)
            edges = np.flatnonzero(np.concatenate([[True], (turns[1:] != turns[:-1]) | (kinds[1:] != kinds[:-1]), [True]])) if len(turns) else []
            for a, b in zip(edges, edges[1:], strict=False):
                if turns[a] != now:
                    now, ids, vectors = turns[a], [], []
                if kinds[a] == 0:
                    ids.append(own[a:b])
                    vectors.append(x[a:b])
                elif ids:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    held.append(top_of(own[a:b], x[a:b], ids[0], vectors[0], top))
            if sum(len(h[0]) for h in held) > HELD:
                held = [best_of(*(np.concatenate(h) for h in zip(*held, strict=True)), top)]
                if len(held[0][0]) > HELD // 2:
                    yield leave(held.pop())
        if held:
            yield leave(best_of(*(np.concatenate(h) for h in zip(*held, strict=True)), top))
        release()

    near = dealt.mapInArrow(rerank, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    out = near.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", F.col("id").alias(id_col), "score")
    if not with_visits:
        return out
    seen = asked.join(plan, "part").groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("visits"), F.sum("n").alias("seen"))
    return out.join(seen, "query_id").select("query_id", "rank", id_col, "score", F.lit(router.w2.shape[1]).alias("parts"), "visits", "seen")
