"""Approximate nearest neighbours by collision counting on query-centred windows.

Every projection keeps one sorted array of the vectors' values. A query opens a window around
its own value in every array; a vector collides where its value lies inside. Virtual rehashing
widens the windows step by step without building anything anew, and only what a step adds is
counted. A vector that collides in at least ``THRESHOLD`` of the arrays is verified by its
exact cosine. A query ends when its windows are so wide that a vector at the distance of the
k-th best so far would almost surely have been a candidate, or when all are verified.

Vectors are dealt into shards of bounded size by a hash of their id, queries into blocks; every
block meets every shard once, and the k best of each meeting are merged exactly. Null and zero
vectors and those with null or non-finite components take no part; vectors of different
lengths are never compared; ties go to the smaller id; fewer candidates than k give all.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_VALUES = 2_000_000  # vector components in a shard
BLOCK_QUERIES = 2_000
PROJECTIONS = 32
THRESHOLD = 0.75  # share of the arrays in which a candidate collides
REACH = 1.35  # window half-width over distance at which nearly every such vector is a candidate
START = 0.6  # half-width of the first windows, for unit vectors
WIDEN = 1.22


class CollisionIndex:
    """Sorted single-projection arrays over the vectors of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        unit = self.vectors / self.norms[:, None]
        self.unit = unit.astype(np.float32)  # screens; the result is computed in doubles
        self.axes = np.random.default_rng(20_240_601).standard_normal((vectors.shape[1], projections))
        values = (unit @ self.axes).T
        self.rows = np.argsort(values, axis=1).astype(np.int32)
        self.values = np.take_along_axis(values, self.rows, axis=1)
        self.need = ceil(THRESHOLD * projections)

    def nearest(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        norm = np.sqrt((query * query).sum())
        unit = query / norm
        narrow = unit.astype(np.float32)
        centre = unit @ self.axes
        counts = np.zeros(n, np.int16)
        verified = np.zeros(n, bool)
        scores = np.full(n, -np.inf)
        others = np.flatnonzero(self.ids != query_id)
        low = high = None
        half = START
        while True:
            new_low = np.array([np.searchsorted(v, c - half) for v, c in zip(self.values, centre)])
            new_high = np.array(
                [np.searchsorted(v, c + half, side="right") for v, c in zip(self.values, centre)]
            )
            for j in range(len(centre)):
                if low is None:
                    counts[self.rows[j, new_low[j] : new_high[j]]] += 1
                else:
                    counts[self.rows[j, new_low[j] : low[j]]] += 1
                    counts[self.rows[j, high[j] : new_high[j]]] += 1
            low, high = new_low, new_high
            fresh = np.flatnonzero((counts >= self.need) & ~verified)
            if len(fresh):
                verified[fresh] = True
                scores[fresh] = self.unit[fresh] @ narrow
                scores[self.ids == query_id] = -np.inf
            found = verified[others].sum()
            if found >= len(others):
                break
            if found >= k:
                kth = np.partition(scores, n - k)[n - k]
                if half >= REACH * np.sqrt(max(0.0, 2 - 2 * kth)):
                    break
            half *= WIDEN
        return self._best(query_id, query, norm, scores, min(k, len(others)))

    def _best(self, query_id, query, norm, scores, k):
        """The k best by the exact measure; equal vectors get equal scores wherever they stand."""
        if not k:
            return self.ids[:0], scores[:0]
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero((scores >= edge - 1e-5) & (self.ids != query_id))
        exact = (self.vectors[near] * query).sum(axis=1) / (self.norms[near] * norm)
        best = np.lexsort((self.ids[near], -exact))[:k]
        return self.ids[near[best]], exact[best]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    flat = lists.flatten().to_numpy()
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, embedding, dim) of the vectors that take part."""
    value = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), value.alias("embedding")).filter(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & finite
        & F.exists("embedding", lambda x: x != 0)
    ).withColumn("dim", F.size("embedding"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by cosine.

    Both tables come from :func:`usable`; a vector with the query's id is never its answer.
    """
    sizes = vectors.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    shards = max(1, ceil(sizes[0] * sizes[1] / SHARD_VALUES))
    blocks = max(1, ceil(queries.count() / BLOCK_QUERIES))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        )

    left = dealt(vectors, "shard", shards, "block", blocks)
    right = dealt(queries, "block", blocks, "shard", shards)

    def meet(some: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if some.num_rows and asked.num_rows:
            index = CollisionIndex(some["vec_id"].to_numpy(), _matrix(some["embedding"]))
            for q, v in zip(asked["vec_id"].to_numpy(), _matrix(asked["embedding"])):
                ids, scores = index.nearest(q, v.astype(np.float64), k)
                out[0] += [q] * len(ids)
                out[1] += ids.tolist()
                out[2] += scores.tolist()
        return pa.table(
            {
                "query_id": pa.array(out[0], pa.int64()),
                "vec_id": pa.array(out[1], pa.int64()),
                "score": pa.array(out[2], pa.float64()),
            }
        )

    keys = ["dim", "shard", "block"]
    met = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(meet, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
