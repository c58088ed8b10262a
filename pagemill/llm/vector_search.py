"""Nearest neighbours by vantage-point trees, one for each shard.

Vectors are scaled to length one, where the Euclidean distance orders like the cosine. A node of
the tree has a vantage point and the median distance to it; a query skips a side when
the triangle inequality shows that it holds nothing nearer than what is found. The
margin of that test is multiplied by `factor`: one is exact, less prunes more.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and
rows without an id, take no part; vectors meet only vectors of their own length; rows that repeat
an id are one, with the smallest of its vectors; fewer candidates give fewer neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.runtime import materialize

SHARD_ROWS = 16_384
QUERY_BLOCK = 1_024
LEAF = 128


class Tree:
    """A vantage-point tree over rows of length one. Nodes are (vantage row, radius,
    inside, outside), leaves arrays of rows."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, rows: np.ndarray):
        if rows.size <= LEAF:
            return rows
        vantage, rest = rows[0], rows[1:]
        distance = np.linalg.norm(self.vectors[rest] - self.vectors[vantage], axis=1)
        order = np.argsort(distance, kind="stable")
        half = order.size // 2
        return int(vantage), float(distance[order[half]]), self._build(rest[order[:half]]), self._build(rest[order[half:]])

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and rows: the k nearest rows of each query, and all others whose distance
        is equal to the k-th within rounding. All queries that a node cannot exclude go through
        it together."""
        # Rounding of a squared distance, and so of a distance near zero.
        margin = max(1e-12, 8 * self.vectors.shape[1] * np.finfo(float).eps)
        slack = 3 * margin**0.5
        best = np.full((len(queries), k), np.inf)
        every = np.arange(len(queries))

        def offer(active: np.ndarray, rows: np.ndarray, distance: np.ndarray) -> None:
            both = np.concatenate([best[active], distance], axis=1)
            best[active] = np.sort(both, axis=1)[:, :k]

        def distances(active: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0, 2 - 2 * (queries[active] @ self.vectors[rows].T)))

        def visit(node, active: np.ndarray, take, bound) -> None:
            if not active.size:
                return
            if isinstance(node, np.ndarray):
                if node.size:
                    take(active, node, distances(active, node))
                return
            vantage, radius, inside, outside = node
            to = distances(active, np.array([vantage]))
            take(active, np.array([vantage]), to)
            to = to[:, 0]
            near_in = to < radius
            reach = lambda rows: bound(rows) * factor + slack
            visit(inside, active[near_in], take, bound)
            visit(outside, active[~near_in], take, bound)
            late_in, late_out = active[~near_in], active[near_in]
            visit(inside, late_in[to[~near_in] - radius <= reach(late_in)], take, bound)
            visit(outside, late_out[radius - to[near_in] <= reach(late_out)], take, bound)

        visit(self.root, every, offer, lambda rows: best[rows, -1])
        limit = np.sqrt(best[:, -1] ** 2 + 2 * margin)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def collect(active: np.ndarray, rows: np.ndarray, distance: np.ndarray) -> None:
            query, place = np.nonzero(distance <= limit[active][:, None])
            found.append((active[query], rows[place]))

        visit(self.root, every, collect, lambda rows: limit[rows])
        return np.concatenate([q for q, _ in found]), np.concatenate([r for _, r in found])


def exact_cosine(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Row-wise, in double precision, components added in order."""
    dot, left, right = np.zeros(len(one)), np.zeros(len(one)), np.zeros(len(one))
    for i in range(one.shape[1]):
        dot += one[:, i] * other[:, i]
        left += one[:, i] * one[:, i]
        right += other[:, i] * other[:, i]
    return np.clip(dot / np.sqrt(left * right), -1, 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def nearest(
    vectors: DataFrame, is_query, k: int = 5, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Rows (query_id, rank, id, score): the k candidates of largest cosine for each id for which the
    column `is_query` (over `id`) holds, ties to the smaller id.

    Candidates are dealt to shards of about SHARD_ROWS rows and queries to blocks; a
    task holds one shard and one block, whatever the size of the tables. Equal vectors of a shard
    are one, with their k + 1 smallest ids; ties within rounding all stay until the exact
    cosine decides among them.
    """
    rows = materialize(usable(vectors, id_col, vector_col).withColumn("dim", F.size("v")), "vectors")
    queries = rows.where(is_query)
    n, n_queries = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_queries // QUERY_BLOCK))
    deal = lambda of, times, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(of)).cast("int")  # noqa: E731, ARG005
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = rows.withColumn("shard", deal(shards, 0, "shard")).withColumn("block", every(blocks))
    right = queries.withColumn("block", deal(blocks, 0, "block")).withColumn("shard", every(shards))
    keys = ["dim", "shard", "block"]

    def search(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64"})
        if not len(candidates) or not len(asked):
            return out
        candidates = candidates.sort_values("id")
        ids, vectors = candidates["id"].to_numpy(), np.stack(candidates["v"].to_numpy())
        asked_ids, asked_vectors = asked["id"].to_numpy(), np.stack(asked["v"].to_numpy())
        scale = lambda v: (s := v / np.abs(v).max(axis=1, keepdims=True)) / np.linalg.norm(s, axis=1, keepdims=True)
        single, group = np.unique(vectors, axis=0, return_inverse=True)
        order = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[order], np.arange(len(single)))
        counts = np.minimum(np.diff(np.append(starts, order.size)), k + 1)
        # The group of a query may hold nothing but itself, hence one group more.
        query, near = Tree(scale(single)).search(scale(asked_vectors), k + 1, factor)
        times = counts[near]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        query, near = np.repeat(query, times), order[np.repeat(starts[near], times) + nth]
        query, near = (x[ids[near] != asked_ids[query]] for x in (query, near))
        score = exact_cosine(asked_vectors[query], vectors[near])
        out = pd.DataFrame({"query_id": asked_ids[query], "id": ids[near], "score": score})
        out = out.sort_values(["query_id", "score", "id"], ascending=[True, False, True])
        return out.groupby("query_id", sort=False).head(k)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, id long, score double")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
