"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a sample is cut into balanced partitions with few edges between them; a small classifier learns
which partitions hold the neighbours of a vector. It files every row under its most probable partition, and routes a
query to several: to as many as the sample needs for the recall aimed at. Their rows are reranked by exact distance.

Rows of a partition are dealt to blocks of bounded size, and queries that probe it to groups of bounded size, so that
a vector that repeats in a third of all rows fills many small tasks; each returns its best few for each query.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import cut_lineage

#: Bound of the fit: rows that the graph and the classifier are made from.
SAMPLE = 8192
#: Neighbours a vector has in the graph.
EDGES = 10
HIDDEN, EPOCHS, BATCH, RATE = 128, 25, 256, 2e-3
#: Share of true neighbours in the sample that the probed partitions must hold.
RECALL = 0.95
#: The graph and the classifier see components up to so many times the usual size of a vector's largest one.
REACH = 16.0
#: Queries that one task takes at most, about.
QUERY_GROUP = 4096


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _nearest(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Indices of the ``k`` nearest other rows of each row."""
    squares = (x * x).sum(axis=1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), block):
        d = squares[None, :] - 2 * x[a : a + block] @ x.T
        d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[a : a + block] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1), 1)
    return out


def _halve(x: np.ndarray, rows: np.ndarray, levels: int, base: int, part: np.ndarray) -> None:
    """Cut rows at the median of their main direction, again and again."""
    if not levels:
        part[rows] = base
        return
    own = x[rows] - x[rows].mean(axis=0)
    _, _, axes = np.linalg.svd(own[: 2 * own.shape[1] + 512], full_matrices=False)
    order = np.argsort(own @ axes[0], kind="stable")
    half = len(rows) // 2
    _halve(x, rows[order[:half]], levels - 1, base * 2, part)
    _halve(x, rows[order[half:]], levels - 1, base * 2 + 1, part)


def balanced_partition(x: np.ndarray, neighbours: np.ndarray, levels: int, rounds: int = 10, slack: float = 0.05) -> np.ndarray:
    """Partition (0 .. 2**levels - 1) of each row: halving, then moves that cut fewer edges and keep the balance."""
    n, parts = len(x), 1 << levels
    part = np.zeros(n, np.int64)
    _halve(x, np.arange(n), levels, 0, part)
    a = np.concatenate((np.repeat(np.arange(n), neighbours.shape[1]), neighbours.ravel()))
    b = np.concatenate((neighbours.ravel(), np.repeat(np.arange(n), neighbours.shape[1])))
    most, least = int(np.ceil((1 + slack) * n / parts)), int((1 - slack) * n / parts)
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        held = np.bincount(a * parts + part[b], minlength=n * parts).reshape(n, parts)
        gain = held - held[np.arange(n), part][:, None]
        target = gain.argmax(axis=1)
        moved = 0
        for i in np.argsort(-gain[np.arange(n), target], kind="stable"):
            if gain[i, target[i]] <= 0:
                break
            if size[target[i]] < most and size[part[i]] > least:
                size[target[i]] += 1
                size[part[i]] -= 1
                part[i] = target[i]
                moved += 1
        if moved < n // 200:
            break
    return part


@dataclass(frozen=True)
class Router:
    """A classifier with one hidden layer, and how many partitions a query probes. A few hundred kB at most.

    ``bound``: components beyond it count as it, so that a few huge vectors do not blind the classifier to the others.
    """

    bound: float
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((np.clip(x, -self.bound, self.bound) - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def route(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The most probable partitions of each vector, the first the one it is filed under."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :probes]


def _train(x: np.ndarray, target: np.ndarray, bound: float, seed: int = 3) -> Router:
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-12)
    z = (x - mean) / scale
    d, p = x.shape[1], target.shape[1]
    weights = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, p)), np.zeros(p)]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(z))
        for a in range(0, len(z), BATCH):
            own = order[a : a + BATCH]
            h = np.maximum(z[own] @ weights[0] + weights[1], 0)
            s = h @ weights[2] + weights[3]
            e = np.exp(s - s.max(axis=1, keepdims=True))
            back = (e / e.sum(axis=1, keepdims=True) - target[own]) / len(own)
            hidden = (back @ weights[2].T) * (h > 0)
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for w, g, i in zip(weights, (z[own].T @ hidden, hidden.sum(axis=0), h.T @ back, back.sum(axis=0)), range(4)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w -= rate * m[i] / (np.sqrt(v[i]) + 1e-8)
    return Router(bound, mean, scale, *weights, probes=1)


def fit(sample: np.ndarray, rows: int) -> Router:
    """Router from a sample (a row each, doubles) of a table of ``rows`` usable vectors."""
    bound = float(min(REACH * np.median(np.abs(sample).max(axis=1)), 1e150)) if sample.size else 1.0
    x = np.unique(np.clip(sample, -bound, bound), axis=0)
    n = len(x)
    levels = int(np.clip(round(np.log2(max(np.sqrt(rows) / 8, 1))), 0, np.log2(max(n / 48, 1))))
    k = min(EDGES, n - 1)
    if not levels or k < 1:
        d = sample.shape[1]
        return Router(bound, np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    near = _nearest(x, k)
    part = balanced_partition(x, near, levels)
    parts = 1 << levels
    target = np.bincount(np.repeat(np.arange(n), k + 1) * parts + part[np.column_stack((np.arange(n), near))].ravel(), minlength=n * parts).reshape(n, parts) / (k + 1)
    router = _train(x, target, bound)
    ranks = np.argsort(np.argsort(-router.scores(x), axis=1, kind="stable"), axis=1)
    filed = ranks.argmin(axis=1)
    needed = np.sort(np.take_along_axis(ranks, filed[near], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1
    return replace(router, probes=probes)


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row to the query, also where the squares leave the range of doubles."""
    with np.errstate(over="ignore"):
        diff = np.abs(rows - query)
        out = np.sqrt((diff * diff).sum(axis=1))
    odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-140))
    if len(odd):
        up = np.frexp(diff[odd].max(axis=1))[1]
        part = np.ldexp(diff[odd], -up[:, None])
        out[odd] = np.ldexp(np.sqrt((part * part).sum(axis=1)), up)
    return out


def best(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` rows nearest to each query, by exact distance and then id, leaving out rows of the query's id."""
    peak = max(np.abs(rows).max(initial=0.0), np.abs(queries).max(initial=0.0))
    down = -int(np.frexp(peak)[1])  # a power of two that brings all components under 1: products cannot overflow
    small, least = np.ldexp(rows, down), min(k, len(rows)) - 1
    squares = np.einsum("ij,ij->i", small, small)
    out = []
    for a in range(0, len(queries), 256):
        q = np.ldexp(queries[a : a + 256], down)
        own = np.einsum("ij,ij->i", q, q)
        rough = squares[None, :] + own[:, None] - 2 * q @ small.T
        same = query_ids[a : a + 256, None] == ids[None, :]
        rough[same] = np.inf
        kth = np.partition(rough, least, axis=1)[:, least]
        # rounding of the products: keep all that may be among the nearest
        limit = kth + 1e-9 * (own + squares.max())
        for i in range(len(q)):
            at = np.flatnonzero((rough[i] <= limit[i]) & ~same[i])
            exact = distances(rows[at], queries[a + i])
            first = np.lexsort((ids[at], exact))[:k]
            out.append((np.full(len(first), query_ids[a + i]), ids[at[first]], exact[first]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, width))


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows nearest to each query row found, by Euclidean distance.

    Every usable vector is indexed. A query whose partitions hold fewer than ``k`` candidates goes to all of them. Null, zero and non-finite vectors, vectors of another length than most, and null ids
    take no part. Rows of the query's own id are no candidates; rows that repeat an id are candidates of their own, and
    a query id that repeats is answered once, for the least of its vectors. Ties go to the smaller id. Other columns are not read; an empty table
    gives an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = sorted((-r["n"], r["w"]) for r in rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect())
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, width = -lengths[0][0], lengths[0][1]
    rows = rows.where(F.size("v") == width)
    sample = rows.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(SAMPLE).select("v").toPandas()
    router = fit(_matrix(sample["v"], width), n)
    shared = spark.sparkContext.broadcast(router)
    probes = router.probes

    def file(batches):  # noqa: ANN001, ANN202
        own = shared.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, width)
            asks = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            routes = own.route(x, probes)
            probed = pa.array([r.tolist() if a else None for r, a in zip(routes.astype(np.int32), asks)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(routes[:, 0].astype(np.int32)), probed], names=["id", "v", "part", "probed"])

    filed = cut_lineage(rows.mapInArrow(file, "id long, v array<double>, part int, probed array<int>"))
    shared.destroy()
    parts = len(router.b2)
    block = max(64, -(-n // parts))
    # a row a partition: how many blocks its rows fill
    sizes = filed.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))

    def rank(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        q, i, s = best(rows["id"].to_numpy(np.int64), _matrix(rows["v"], width), asked["query"].to_numpy(np.int64), _matrix(asked["qv"], width), k)
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    def answered(queries: DataFrame) -> DataFrame:
        # and how many groups the queries that probe it
        asked = queries.select(F.explode("probed").alias("part")).groupBy("part").agg(F.ceil(F.count("*") / QUERY_GROUP).cast("int").alias("groups"))
        plan = F.broadcast(sizes.join(asked, "part"))  # at most ``parts`` rows
        cast = filed.select("id", "v", "part").join(plan, "part").select(
            "id", "v", "part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group")
        )
        asking = queries.select("query", "qv", F.explode("probed").alias("part")).join(plan, "part").select(
            "query", "qv", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query"), F.col("groups")).cast("int").alias("group")
        )
        keys = ["part", "block", "group"]
        found = cast.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asks = F.min_by(F.struct("v", "probed"), "v").alias("q")
    queries = filed.where("probed is not null").groupBy(F.col("id").alias("query")).agg(asks).select("query", F.col("q.v").alias("qv"), F.col("q.probed").alias("probed"))
    found = cut_lineage(answered(queries))
    full = found.groupBy("query_id").agg(F.count("*").alias("c")).where(F.col("c") >= k).select(F.col("query_id").alias("query"))
    short = cut_lineage(queries.where(F.size("probed") < parts).join(full, "query", "left_anti").withColumn("probed", F.sequence(F.lit(0), F.lit(parts - 1))))
    if short.isEmpty():
        return found
    return found.join(short.select(F.col("query").alias("query_id")), "query_id", "left_anti").unionByName(answered(short))
