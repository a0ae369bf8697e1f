"""What the two vector searches share: reading vectors, shards and queries in one plan, equal vectors, merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows that one task indexes, at most about; small tables are dealt to all cores, in shards of LEAST_ROWS and more.
SHARD_ROWS, LEAST_ROWS = 1 << 15, 1 << 10
#: Queries that one task answers, at most about: more become groups, each with shards of its own.
GROUP_QUERIES = 1 << 20
#: Rows that give every query a first kth score, before any shard is searched.
SEED_ROWS = 2048

#: (query ids, query matrix, floors) -> (query positions, vec_ids, scores)
Search = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def dimension(rows: DataFrame) -> int:
    """The commonest length of embedding, the smaller on a tie; 0 for an empty table."""
    n = F.size("embedding")
    got = rows.filter("embedding IS NOT NULL AND size(embedding) > 0").groupBy(n.alias("n")).count().orderBy(F.desc("count"), "n").first()
    return got["n"] if got else 0


def matrix(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, float64 matrix) of the rows that take part: of this dimension, without null or non-finite components."""
    if not len(ids) or not dim:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    lengths = pc.list_value_length(vectors)
    ok = pc.and_(pc.equal(lengths, dim).fill_null(False), ids.is_valid())
    ids, vectors = ids.filter(ok), vectors.filter(ok)
    flat = vectors.flatten().cast(pa.float64()).fill_null(np.nan)
    m = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    fine = np.isfinite(m).all(1)
    return ids.cast(pa.int64()).to_numpy()[fine], m[fine]


def table_matrix(df: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """matrix() of a small result."""
    t = df.select(F.col("vec_id").cast("long"), "embedding").toArrow().combine_chunks()
    return matrix(*(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns[:2]), dim)


def floors(qid: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Each query's kth score among seed rows other than itself; -inf if there are fewer. score is queries by seeds."""
    own = np.where(qid[:, None] == ids[None], -np.inf, score)
    return np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k] if own.shape[1] >= k else np.full(len(qid), -np.inf)


def with_floors(rows: DataFrame, every: int, dim: int, k: int, scores: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(vec_id, embedding, floor): the rows whose vec_id is divisible by every, once per vec_id (of several vectors the least),
    with the kth score that SEED_ROWS rows by hash give them. rows holds usable vectors only."""
    ids, seeds = table_matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SEED_ROWS), dim)
    ids, first = np.unique(ids, return_index=True)
    sent = rows.sparkSession.sparkContext.broadcast((ids, seeds[first]))
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seeds = sent.value
        for b in batches:
            qid, q = matrix(b.column(0), b.column(1), dim)
            low = floors(qid, ids, scores(q, seeds), k)
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(list(q), pa.list_(pa.float64())), pa.array(low.astype(np.float64))], names=["vec_id", "embedding", "floor"])

    return written(queries.mapInArrow(run, "vec_id long, embedding array<double>, floor double"))


def sharded(rows: DataFrame, queries: DataFrame, dim: int, make: Callable[[pa.RecordBatch], Search], kind: str) -> DataFrame:
    """(query_id, vec_id, score): what make(shard)(queries) finds, for every shard of rows and all queries, in one plan.

    Rows are dealt by a hash of vec_id into shards, queries into groups, and a task gets one of each: first the rows, of
    which make builds its index, then the queries, a stream of batches. A task holds one shard and one batch of queries,
    whatever the size of the table; nothing goes through the driver. What travels is queries times shards and rows
    times groups.
    """
    n, parallel = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    shards = max(1, min(parallel, -(-n // LEAST_ROWS)), -(-n // SHARD_ROWS))
    groups = max(1, -(-queries.count() // GROUP_QUERIES))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = rows.select("*", F.lit(False).alias("asks"), each(groups).alias("other")).withColumn("key", dealt(shards) * groups + F.col("other"))
    right = queries.select("*", F.lit(True).alias("asks"), each(shards).alias("other")).withColumn("key", F.col("other") * groups + dealt(groups))
    names = ["key", "asks", *rows.columns, "floor"]
    both = left.unionByName(right, allowMissingColumns=True).select(*names)
    placed = both.repartitionById(shards * groups, F.col("key")).sortWithinPartitions("key", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, search = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys, asks = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])]))
            for lo, hi in zip(edges, [*edges[1:], len(keys)], strict=True):
                if keys[lo] != key:
                    key, held, search = keys[lo], [], None
                piece = b.slice(lo, hi - lo)
                if not asks[lo]:
                    held.append(piece)
                    continue
                if held:
                    search, held = make(pa.concat_batches(held)), []
                if search:
                    qid, q = matrix(piece.column("vec_id"), piece.column("embedding"), dim)
                    at, vec, score = search(qid, q, piece.column("floor").to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(qid[at]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    return placed.mapInArrow(run, f"query_id long, vec_id long, score {kind}")


def distinct_rows(ids: np.ndarray, m: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of each distinct vector, owner of each kept id, kept ids): of equal vectors the keep smallest ids suffice,
    as all score alike and ties go to the smaller id. A row that comes again counts once."""
    m = np.ascontiguousarray(m) + 0.0  # -0.0 and 0.0 are one value
    _, first, inv = np.unique(m.view(np.dtype((np.void, m.itemsize * m.shape[1]))).ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, inv))
    inv, ids = inv[order], ids[order]
    new = np.ones(len(inv), bool)
    new[1:] = (inv[1:] != inv[:-1]) | (ids[1:] != ids[:-1])
    inv, ids = inv[new], ids[new]
    start = np.searchsorted(inv, np.arange(len(first)))
    ok = np.arange(len(inv)) - start[inv] < keep
    return first, inv[ok], ids[ok]


def best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of each query, ties to smaller ids, once per id."""
    order = np.lexsort((ids, -score, q))
    same = np.zeros(len(order), bool)
    same[1:] = (q[order][1:] == q[order][:-1]) & (ids[order][1:] == ids[order][:-1]) & (score[order][1:] == score[order][:-1])
    order = order[~same]
    qs = q[order]
    return order[np.arange(len(qs)) - np.searchsorted(qs, qs) < k]


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of what all shards found, with ranks. Rows here: queries times k times shards at most. All rows of one
    vec_id are in one shard, so no pair comes twice."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
