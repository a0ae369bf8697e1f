"""Nearest neighbours: product quantisation with a score-aware loss, four-bit table scans, exact reranking of every row that
the codes leave open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .vectors import Search, best, dimension, distinct_rows, matrix, merged, sharded, table_matrix, with_floors

#: Code books are fitted on at most so many vectors; every vector is indexed.
TRAIN_ROWS = 8000
#: Weight of the residual along the vector against that across it: the former changes the largest inner products most.
PARALLEL = 4.0
#: Candidates of each shard that give a query its kth score; all rows that may reach it are scored then.
RERANK = 48
CODES = 16
#: Pairs of query and coded row that are scanned at a time.
CELLS = 1 << 21
#: Pairs of query and row whose vectors are gathered at a time.
PAIRS = 1 << 16


def _split(dim: int) -> list[slice]:
    """Two components to a subspace; an even number of subspaces, so that codes pair up in bytes."""
    edges = list(range(0, dim, 2))
    return [slice(a, min(a + 2, dim)) for a in edges]


def _assign(x: np.ndarray, books: list[np.ndarray], sweeps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(codes, residual along x) by coordinate descent on |r|^2 + (PARALLEL - 1) (r.x)^2 for unit x."""
    parts = _split(x.shape[1])
    codes = np.zeros((len(x), len(parts)), np.uint8)
    along = np.zeros((len(x), len(parts)))
    total = np.zeros(len(x))
    for sweep in range(sweeps):
        for s, p in enumerate(parts):
            r = x[:, None, p] - books[s][None]
            par = np.einsum("ncd,nd->nc", r, x[:, p])
            other = (total - along[:, s])[:, None] if sweep else np.zeros((len(x), 1))
            c = ((r**2).sum(2) + (PARALLEL - 1) * (other + par) ** 2).argmin(1)
            codes[:, s] = c
            new = par[np.arange(len(x)), c]
            total += new - along[:, s]
            along[:, s] = new
    return codes, along


def fit(x: np.ndarray, rounds: int = 5, seed: int = 3) -> list[np.ndarray]:
    """Code books for unit vectors: assignments and closed-form centroids of the score-aware loss in turn."""
    rng = np.random.default_rng(seed)
    parts = _split(x.shape[1])
    books = [x[rng.integers(len(x), size=CODES), p] + rng.normal(0, 1e-3, (CODES, p.stop - p.start)) if len(x) else np.zeros((CODES, p.stop - p.start)) for p in parts]
    for _ in range(rounds if len(x) else 0):
        codes, along = _assign(x, books)
        total = along.sum(1)
        for s, p in enumerate(parts):
            target = total - along[:, s] + (x[:, p] ** 2).sum(1)
            for c in range(CODES):
                own = codes[:, s] == c
                if own.any():
                    v = x[own, p]
                    left = own.sum() * np.eye(v.shape[1]) + (PARALLEL - 1) * v.T @ v
                    books[s][c] = np.linalg.solve(left, v.sum(0) + (PARALLEL - 1) * (target[own, None] * v).sum(0))
    return books


def _packed(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    return codes[:, ::2] << 4 | codes[:, 1::2]


def _tables(q: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """(query, byte place, byte value) -> its part of the inner product: the tables of two four-bit codes summed."""
    t = [q[:, p] @ b.T for p, b in zip(_split(q.shape[1]), books, strict=True)]
    if len(t) % 2:
        t.append(np.zeros_like(t[0]))
    return np.stack([(a[:, :, None] + b[:, None]).reshape(len(q), 256) for a, b in zip(t[::2], t[1::2], strict=True)], 1).astype(np.float32)


def _residual(x: np.ndarray, codes: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What the codes miss of unit x: (component along x, length of the rest)."""
    r = x.copy()
    for s, p in enumerate(_split(x.shape[1])):
        r[:, p] -= books[s][codes[:, s]]
    along = (r * x).sum(1)
    return along, np.sqrt(((r - along[:, None] * x) ** 2).sum(1))


def _least(kth: np.ndarray, along: np.ndarray, across: np.ndarray, places: int) -> np.ndarray:
    """(query, row): the smallest coded score that a row may have whose cosine s is at least kth. The residual's part of s
    is at most along s + across sqrt(1 - s^2), so the coded score is at least (1 - along) s - across sqrt(1 - s^2), which
    falls up to s = low and rises from there. The last term covers the rounding of float32 tables and sums."""
    keep = 1 - along
    size = np.sqrt(keep**2 + across**2)
    low = -keep / np.where(size > 0, size, 1)
    s = np.minimum(np.maximum(kth[:, None], low[None]), 1)
    return keep * s - across * np.sqrt(1 - s * s) - (places + 4) * 2.0**-22 * (2 + np.abs(along) + across)


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.sqrt((m * m).sum(1))
    return m / np.where(n > 0, n, 1)[:, None], n


def build_index(rows: DataFrame, sample_rows: int = TRAIN_ROWS) -> tuple[DataFrame, list[np.ndarray], int]:
    """(table of vec_id, codes, embedding and residual of every usable row, code books, dimension)."""
    dim = dimension(rows)
    ids = rows.filter("embedding IS NOT NULL").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows)
    sample = _unit(table_matrix(ids, dim)[1])
    books = fit(sample[0][sample[1] > 0])
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, m = matrix(b.column(0), b.column(1), dim)
            x, norm = _unit(m)
            ids, m, x = ids[norm > 0], m[norm > 0], x[norm > 0]
            codes = np.concatenate([_assign(x[i : i + 4096], sent.value)[0] for i in range(0, len(x), 4096)]) if len(x) else np.zeros((0, len(sent.value)), np.uint8)
            along, across = _residual(x, codes, sent.value)
            columns = [pa.array(ids), pa.array([c.tobytes() for c in _packed(codes)], pa.binary()), pa.array(list(m), pa.list_(pa.float64())), pa.array(along), pa.array(across)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "codes", "embedding", "along", "across"])

    table = written(rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(encode, "vec_id long, codes binary, embedding array<double>, along double, across double"))
    return table, books, dim


def _exact(q: np.ndarray, m: np.ndarray, norm: np.ndarray, qn: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of pairs; each is computed alike wherever it stands, so equal vectors score alike in all batches."""
    out = np.zeros(len(qn))
    for i in range(0, len(qn), PAIRS):
        own, at = q[qn[i : i + PAIRS]], v[i : i + PAIRS]
        out[i : i + PAIRS] = (own * m[at]).sum(1) / (np.sqrt((own * own).sum(1)) * norm[at])
    return out


def _shard(b: pa.RecordBatch, books: list[np.ndarray], k: int, dim: int, rerank: int) -> Search:
    """The search of one shard: for each query all that are among the k best here and not under its floor."""
    ids, m = matrix(b.column("vec_id"), b.column("embedding"), dim)
    codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
    along, across = (b.column(c).to_numpy() for c in ("along", "across"))
    first, owner, kept = distinct_rows(ids, m, k + 1)
    codes, m, along, across = np.ascontiguousarray(codes[first].T), m[first], along[first], across[first]
    x, norm = _unit(m)
    begin = np.searchsorted(owner, np.arange(len(first) + 1))

    def search(qid: np.ndarray, q: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kth = floor.copy()

        def found(qn: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
            exact = _exact(q, m, norm, qn, v)
            ok = exact >= kth[qn]
            qn, v, exact = qn[ok], v[ok], exact[ok]
            n = begin[v + 1] - begin[v]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[v], n)
            qn, exact, vec = np.repeat(qn, n), np.repeat(exact, n), kept[place]
            other = vec != qid[qn]
            return qn[other], vec[other], exact[other]

        out, step = [], max(1, CELLS // len(first))
        for lo in range(0, len(q), step):
            unit = _unit(q[lo : lo + step])[0]
            t = _tables(unit, books)
            score = np.zeros((len(t), len(first)), np.float32)
            for place, c in enumerate(codes):
                score += t[:, place, c]
            r = min(len(first), max(rerank, k + 1))
            top = np.argpartition(score, len(first) - r, axis=1)[:, len(first) - r :]
            got = found(np.repeat(np.arange(lo, lo + len(t)), r), top.ravel())
            kth[lo : lo + len(t)] = _kth(*got, k, kth)[lo : lo + len(t)]
            own = kth[lo : lo + len(t)]
            open_ = score >= _least(own, along, across, len(codes))
            np.put_along_axis(open_, top, False, 1)
            at = np.flatnonzero(open_.any(0))
            near = unit @ x[at].T >= own[:, None] - 1e-9  # up to rounding; found() decides
            qn, v = np.nonzero(near & open_[:, at])
            got = tuple(np.concatenate(c) for c in zip(got, found(qn + lo, at[v]), strict=True))
            keep = best(got[0], got[2], got[1], k)
            out.append(tuple(c[keep] for c in got))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return search


def _kth(qn: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int, floor: np.ndarray) -> np.ndarray:
    """Each query's kth score where k rows are found, and floor if that is higher or they are not."""
    keep = best(qn, score, vec, k)
    n = np.bincount(qn[keep], minlength=len(floor))
    full = n >= k
    out = floor.copy()
    out[full] = np.maximum(out[full], score[keep][np.cumsum(n)[full] - 1])
    return out


def search(rows: DataFrame, every: int = 50, k: int = 5, rerank: int = RERANK, sample_rows: int = TRAIN_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by every, the k nearest other rows by cosine.

    Null, zero, null- or non-finite-holding vectors, those of an uncommon length, and rows without vec_id take no part.
    Equal vectors tie and go by vec_id; rows repeated outright count once; of several vectors under one vec_id the least
    asks. Queries stream past the codes of every shard; every row is scored exactly unless its code and residual show that
    it can't reach the kth score, so none of the k nearest is missed. rerank only says how many rows of a shard give the
    first kth score. An empty table gives an empty table.
    """
    table, books, dim = build_index(rows, sample_rows)
    sent = rows.sparkSession.sparkContext.broadcast(books)
    seen = table.select("vec_id", "embedding")
    queries = with_floors(seen, every, dim, k, lambda q, m: _unit(q)[0] @ _unit(m)[0].T - 1e-9)  # a floor up to rounding
    return merged(sharded(table, queries, dim, lambda b: _shard(b, sent.value, k, dim, rerank), "double"), k)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)
