"""Exact top-k inner products: a ball tree per shard, branch and bound with a shared kth score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .vectors import Search, best, dimension, distinct_rows, matrix, merged, sharded, with_floors

LEAF = 128
#: Pairs of query and leaf whose bounds are held at a time.
CELLS = 1 << 20


def whole(m: np.ndarray) -> np.ndarray:
    """Components as whole numbers, floor(256 x), in float64."""
    return np.floor(256 * m)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows: floats while every partial sum stays below 2^53, else integers."""
    if len(a) and len(b) and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a @ b.T).astype(np.int64)


def _as_floor(score: np.ndarray) -> np.ndarray:
    """Scores as floats that are no larger."""
    return score.astype(np.float64) - np.where(np.abs(score) >= 2**53, np.abs(score) * 2.0**-52, 0)


class BallTree:
    """Nodes in an array: children, centre, radius; leaves own a range of points."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.left, self.right, self.range, centre, radius = [], [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            node = len(self.left)
            if parent >= 0:
                (self.left, self.right)[side][parent] = node
            own = points[self.order[lo:hi]]
            c = own.mean(0)
            far = ((own - c) ** 2).sum(1)
            self.left.append(-1)
            self.right.append(-1)
            self.range.append((lo, hi))
            centre.append(c)
            radius.append(np.sqrt(far.max()))
            if hi - lo > LEAF:
                a = own[far.argmax()]
                b = own[((own - a) ** 2).sum(1).argmax()]
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(own @ (b - a), mid)]
                todo += [(lo + mid, hi, node, 1), (lo, lo + mid, node, 0)]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.kids = np.array([self.left, self.right]).T

    def bounds(self, q: np.ndarray, size: np.ndarray, nodes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """No inner product of query rows with a point of nodes is larger; the last terms cover rounding."""
        c = self.centre[nodes]
        inner = np.einsum("ij,ij->i", q[rows], c)
        return inner + size[rows] * self.radius[nodes] * (1 + 1e-9) + 1e-9 * size[rows] * np.sqrt((c * c).sum(1)) + 1e-6


class Found:
    """The k best of each query so far, and the kth score; a floor known beforehand counts until k are found."""

    def __init__(self, qid: np.ndarray, k: int, floor: np.ndarray):
        self.qid, self.k = qid, k
        self.kth = np.where(np.isfinite(floor), floor, -(2.0**62)).astype(np.int64)
        self.q, self.vec, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        ok = (vec != self.qid[q]) & (score >= self.kth[q])
        q, vec, score = (np.concatenate([a, b[ok]]) for a, b in ((self.q, q), (self.vec, vec), (self.score, score)))
        keep = best(q, score, vec, self.k)
        self.q, self.vec, self.score = q[keep], vec[keep], score[keep]
        n = np.bincount(self.q, minlength=len(self.qid))
        last = np.cumsum(n) - 1
        full = n >= self.k
        self.kth[full] = np.maximum(self.kth[full], self.score[last[full]])


def _scan_leaf(q: np.ndarray, found: Found, points: np.ndarray, tree: BallTree, leaf: int, own: np.ndarray, owners: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(query, vec_id, score) of the leaf's points that reach the kth scores of queries own."""
    begin, kept = owners
    lo, hi = tree.range[leaf]
    at = tree.order[lo:hi]
    s = dots(q[own], points[at])
    i, j = np.nonzero(s >= found.kth[own][:, None])
    v = at[j]
    n = begin[v + 1] - begin[v]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[v], n)
    return np.repeat(own[i], n), kept[place], np.repeat(s[i, j], n)


def _shard(b: pa.RecordBatch, k: int, dim: int) -> Search:
    """The search of one shard, a ball tree over its distinct vectors."""
    ids, m = matrix(b.column("vec_id"), b.column("embedding"), dim)
    first, owner, kept = distinct_rows(ids, whole(m), k + 1)
    points = whole(m)[first]
    owners = np.searchsorted(owner, np.arange(len(first) + 1)), kept
    tree = BallTree(points)
    leaves = sum(kid < 0 for kid in tree.left)

    def scan(q: np.ndarray, found: Found, rows: np.ndarray, nodes: np.ndarray) -> None:
        order = np.argsort(nodes, kind="stable")
        rows, nodes = rows[order], nodes[order]
        cut = np.flatnonzero(np.diff(nodes)) + 1
        got = [_scan_leaf(q, found, points, tree, leaf[0], own, owners) for leaf, own in zip(np.split(nodes, cut), np.split(rows, cut), strict=True) if len(own)]
        if got:
            found.add(*(np.concatenate(x) for x in zip(*got, strict=True)))

    def block(qid: np.ndarray, q: np.ndarray, floor: np.ndarray) -> Found:
        found, size = Found(qid, k, floor), np.sqrt((q * q).sum(1))
        rows, nodes = np.arange(len(q)), np.zeros(len(q), np.int64)
        while (inner := tree.kids[nodes, 0] >= 0).any():  # each query's most promising child first, down to a leaf
            own, kids = rows[inner], tree.kids[nodes[inner]]
            a, b = (tree.bounds(q, size, kids[:, i], own) for i in (0, 1))
            nodes[inner] = np.where(a >= b, kids[:, 0], kids[:, 1])
        scan(q, found, rows, nodes)
        dived = nodes.copy()
        nodes, ends = np.zeros(len(q), np.int64), []
        while len(rows):  # what is left: a node whose bound misses the kth score takes its subtree along
            bound = tree.bounds(q, size, nodes, rows)
            ok = bound >= found.kth[rows]
            rows, nodes, bound = rows[ok], nodes[ok], bound[ok]
            end = tree.kids[nodes, 0] < 0
            new = end & (nodes != dived[rows])
            ends.append((rows[new], nodes[new], bound[new]))
            rows, nodes = np.repeat(rows[~end], 2), tree.kids[nodes[~end]].ravel()
        rows, nodes, bound = (np.concatenate(x) for x in zip(*ends, strict=True))
        order = np.lexsort((-bound, rows))
        rows, nodes, bound = rows[order], nodes[order], bound[order]
        turn = np.arange(len(rows)) - np.searchsorted(rows, rows)  # the leaf with the highest bound first
        for t in range(int(turn.max(initial=-1)) + 1):
            now = (turn == t) & (bound >= found.kth[rows])
            scan(q, found, rows[now], nodes[now])
        return found

    def search(qid: np.ndarray, q: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, out, step = whole(q), [], max(1, CELLS // leaves)
        for lo in range(0, len(q), step):
            got = block(qid[lo : lo + step], q[lo : lo + step], floor[lo : lo + step])
            out.append((got.q + lo, got.vec, got.score))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return search


def exact_top_k(rows: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by every, the k other rows with the highest
    inner product of floor(256 x) components.

    Null vectors, those holding null or non-finite components, those of an uncommon length, and rows without vec_id
    take no part. Ties go to the smaller vec_id; rows repeated outright count once; of several vectors under one vec_id
    the least asks. Queries stream past each shard's ball tree, with the kth score that SEED_ROWS rows give them. An
    empty table gives an empty table.
    """
    dim = dimension(rows)
    usable = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(rows.filter(F.col("vec_id").isNotNull() & (F.size("embedding") == dim) & (F.size("embedding") > 0) & usable))
    queries = with_floors(rows, every, dim, k, lambda q, m: _as_floor(dots(whole(q), whole(m))))
    return merged(sharded(rows, queries, dim, lambda b: _shard(b, k, dim), "long"), k)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""
