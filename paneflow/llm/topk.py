"""Exact top-k search by inner product with dual-tree cover trees (operator 1)."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

K = 10
SCALE = 1024
#: Points of one tree.
TREE = 4096
#: Points below which a node isn't divided, of candidates and of queries.
LEAF = 48
QUERY_LEAF = 8
#: Candidates and queries that meet in one task.
CANDIDATES, QUERIES = 32_768, 2_048
_EXACT = 2.0**53


class CoverTree:
    """A tree over points: each node has a centre, a covering radius, and its points as order[start:end]."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        self.points, self.norms = points, np.sqrt((points**2).sum(1))
        self.order = np.arange(len(points))
        self.nodes: list[list] = []  # centre, radius, start, end, children
        square = (points**2).sum(1)
        self._far = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * (points @ points.T), 0))
        self._grow(0, len(points))
        del self._far

    def _grow(self, start: int, end: int) -> int:
        """Adds a node, and below it nodes whose centres lie apart by more than half its radius and cover its points within that."""
        mine = self.order[start:end]
        centre = mine[0]
        radius = float(self._far[centre, mine].max())
        at = len(self.nodes)
        self.nodes.append([centre, radius, start, end, []])
        if end - start <= self.leaf or radius == 0:
            return at
        left, parts = mine, []
        while len(left):
            near = self._far[left[0], left] <= radius / 2
            parts.append(left[near])
            left = left[~near]
        # centres that cover little stay together in one child, which keeps the tree shallow where all distances are alike
        few = max(2, self.leaf // 6)
        small = [p for p in parts if len(p) < few]
        if len(small) > 1:
            parts = [p for p in parts if len(p) >= few] + [np.concatenate(small)]
        if len(parts) == 1:
            half = np.argsort(self._far[centre, mine], kind="stable")
            parts = [mine[half[: len(half) // 2]], mine[half[len(half) // 2 :]]]
        self.order[start:end] = np.concatenate(parts)
        for p in parts:
            self.nodes[at][4].append(self._grow(start, start + len(p)))
            start += len(p)
        return at


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, held between the limits of 64 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    out = whole(a) @ whole(b).T
    return np.vectorize(lambda x: max(-(2**63), min(2**63 - 1, x)), otypes=[object])(out).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -(2**63), np.int64)
        self.id = np.full((queries, k), 2**63 - 1, np.int64)

    def worst(self, queries: np.ndarray) -> int:
        return int(self.score[queries, -1].min())

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        score = np.concatenate([self.score[queries], scores], 1)
        id_ = np.concatenate([self.id[queries], ids], 1)
        rank = np.lexsort((id_, ~score), axis=1)[:, : self.k]
        self.score[queries] = np.take_along_axis(score, rank, 1)
        self.id[queries] = np.take_along_axis(id_, rank, 1)


def search(q: np.ndarray, q_ids: np.ndarray, tree_of_queries: CoverTree, r: np.ndarray, r_ids: np.ndarray, best: Best) -> int:
    """Adds the candidates r to the best of the queries q by walking both trees; returns how many pairs were scored.

    No inner product between two nodes exceeds that of the centres plus each radius times the other centre's norm plus
    the product of the radii. A pair of nodes whose bound is below the worst k-th score of its queries is left out;
    pairs with the highest bound come first.
    """
    tree = CoverTree(r)
    other = tree_of_queries
    scored, count = 0, 0

    def bound(a: int, b: int) -> float:
        x, rx = other.nodes[a][:2]
        y, ry = tree.nodes[b][:2]
        top = float(q[x] @ r[y]) + rx * tree.norms[y] + ry * other.norms[x] + rx * ry
        return top + 1e-6 * abs(top) + 1e-3

    queue = [(-bound(0, 0), 0, 0, 0)]
    while queue:
        top, _, a, b = heapq.heappop(queue)
        _, radius_a, start_a, end_a, below_a = other.nodes[a]
        _, radius_b, start_b, end_b, below_b = tree.nodes[b]
        mine = other.order[start_a:end_a]
        if -top < best.worst(mine):
            continue
        if below_a and (radius_a >= radius_b or not below_b):
            pairs = [(x, b) for x in below_a]
        elif below_b:
            pairs = [(a, x) for x in below_b]
        else:
            theirs = tree.order[start_b:end_b]
            scores = dot(q[mine], r[theirs])
            scored += scores.size
            ids = np.broadcast_to(r_ids[theirs], scores.shape).copy()
            own = ids == q_ids[mine][:, None]
            scores[own], ids[own] = -(2**63), 2**63 - 1
            best.add(mine, scores, ids)
            continue
        for x, y in pairs:
            count += 1
            heapq.heappush(queue, (-bound(x, y), count, x, y))
    return scored


def _vectors(t: pa.Table, name: str) -> np.ndarray:
    rows = t.column(name).to_pylist()
    return np.floor(SCALE * np.array(rows, np.float64)).reshape(len(rows), -1)


def _meet(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            q, q_ids = _vectors(left, "vector"), left.column("query_id").to_numpy()
            r, r_ids = _vectors(right, "vector"), right.column("vec_id").to_numpy()
            best = Best(len(q), k)
            for a in range(0, len(q), TREE):
                own = Best(len(q[a : a + TREE]), k)
                tree = CoverTree(q[a : a + TREE], QUERY_LEAF)
                for at in range(0, len(r), TREE):
                    search(q[a : a + TREE], q_ids[a : a + TREE], tree, r[at : at + TREE], r_ids[at : at + TREE], own)
                best.score[a : a + TREE], best.id[a : a + TREE] = own.score, own.id
            i, j = np.nonzero((best.id < 2**63 - 1) | (best.score > -(2**63)))
            out = {"query_id": q_ids[i], "vec_id": best.id[i, j], "score": best.score[i, j]}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its components are numbers."""
    ends = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < ends)), F.lit(False))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k highest scores of each query: query_id, rank, vec_id, score, ties to the smaller vec_id.

    vectors and queries need vec_id and embedding; other columns aren't read. A score is the inner product of the vectors
    after each component x became floor(1024 * x). Rows whose vec_id is null, or whose vector is null, empty or holds a null
    or a number that isn't finite, take no part. A query meets vectors of its own length, from all rows but those
    with its own vec_id; repeated rows are candidates each. Queries that repeat a vec_id count once, with the greatest
    vector. With fewer than k candidates all are returned. Scores beyond 64 bits stop at the limit.
    """

    def prepared(df: DataFrame) -> DataFrame:
        d = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
        return d.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")) & (F.size("vector") > 0)).withColumn("length", F.size("vector"))

    candidates = prepared(vectors)
    asked = prepared(queries).groupBy(F.col("vec_id").alias("query_id"), "length").agg(F.max("vector").alias("vector"))
    n, m = candidates.count(), asked.count()
    parts, blocks = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    numbers = [F.sequence(F.lit(0), F.lit(x - 1)) for x in (parts, blocks)]
    left = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(numbers[0]))
    right = candidates.withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)).cast("int")).withColumn("block", F.explode(numbers[1]))
    key = ["part", "block", "length"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_meet(k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
