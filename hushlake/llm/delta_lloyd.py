"""Centroid clustering by delta Lloyd: kept assignments and sums, only changed centroids compared, signed transfers summed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, written
from .vectors import matrix

#: Scaled components beyond this count as this, so that squared distances of 64 components fit in a long.
LIMIT = 1 << 27
#: Components up to this give exact dot products in doubles.
EXACT = 1 << 22
_STATE = "vec_id long, v array<int>, was int, cluster int, distance long"


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))


def scaled(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, v): the usable vectors, each component x as floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, m = matrix(pa.array(np.arange(b.num_rows)), b.column(1), dim)
            with np.errstate(over="ignore"):
                v = np.clip(np.floor(m * scale), -LIMIT, LIMIT).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place)), _lists(v)], names=["vec_id", "v"])

    return rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, v array<int>")


def seeds(points: DataFrame, k: int) -> np.ndarray:
    """The vectors of the k smallest sha256 of '1:<vec_id>', in that order: vectors without vec_id last, ties by components."""
    h = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in points.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()], np.int64)


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centroids, exact."""
    kind = np.float64 if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= EXACT else np.int64
    dot = (v.astype(kind) @ c.T.astype(kind)).astype(np.int64)
    return (v * v).sum(1)[:, None] - 2 * dot + (c * c).sum(1)[None]


def nearest(v: np.ndarray, was: np.ndarray, kept: np.ndarray, c: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, squared distance) of each vector, ties to the smaller number. A vector whose owner (was, at distance kept) did
    not change is compared with the changed centroids only: it was nearest among the others and they stand where they stood."""
    owner, best = was.copy(), kept.copy()
    moved = np.isin(was, changed) | (was < 0)
    if moved.any():
        d = distances(v[moved], c)
        owner[moved] = d.argmin(1)
        best[moved] = d.min(1)
    if len(changed) and not moved.all():
        still = np.flatnonzero(~moved)
        d = distances(v[still], c[changed])
        near, least = changed[d.argmin(1)], d.min(1)
        ok = (least < best[still]) | ((least == best[still]) & (near < owner[still]))
        owner[still[ok]], best[still[ok]] = near[ok], least[ok]
    return owner, best


def _assigned(state: DataFrame, c: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The next state: was is the owner before, null in the first round."""
    fresh = "cluster" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, c.shape[1]).astype(np.int64)
            was, kept = (np.full(n, -1, np.int32), np.zeros(n, np.int64)) if fresh else (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            owner, best = nearest(v, was, kept, c, changed)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(was, mask=was < 0), pa.array(owner.astype(np.int32)), pa.array(best)], names=["vec_id", "v", "was", "cluster", "distance"])

    return state.select("vec_id", "v", *([] if fresh else ["cluster", "distance"])).mapInArrow(run, _STATE)


def transfers(state: DataFrame, dim: int) -> DataFrame:
    """(cluster, n, s0, s1, ...): what vectors that changed owners take from the old and bring to the new, summed with signs;
    one row a cluster and task is shuffled at most."""
    ends = F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign")))
    rows = state.filter("was IS NULL OR was <> cluster").select(F.explode(ends).alias("e"), "v").filter("e.c IS NOT NULL").select(F.col("e.c").alias("cluster"), F.col("e.sign").alias("sign"), "v")
    return rows.groupBy("cluster").agg(F.sum("sign").alias("n"), *[F.sum(F.col("sign") * F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dim)])


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector of rows.

    Usable are vectors of dim components, none null or non-finite; the others, and null vectors, are left out. Components
    are floor(scale * x), beyond 2^27 either way that bound. Centroids start as the k vectors with the smallest sha256 of
    '1:<vec_id>' (fewer vectors: fewer centroids; vectors without vec_id come last, then the smaller vector first). Each
    round assigns all vectors, ties to the smaller number, and sets each non-empty centroid to the floor of its mean; a
    last assignment follows. Rows that share a vec_id or repeat outright are vectors each, with a row each. An empty
    table gives an empty table. Columns other than vec_id and embedding are not read. Inertia sums that no long holds
    are null.

    State is a written table (vector, owner, distance), rewritten narrowly once a round without a shuffle. Through
    the driver go k centroids, k sums and k inertias, k times dim numbers, whatever the size of the table. When no
    centroid changed, assignments can't either, and the rounds end.
    """
    spark = rows.sparkSession
    state = written(scaled(rows, dim, scale))
    c = seeds(state, k).reshape(-1, dim)
    counts, sums = [0] * len(c), [[0] * dim for _ in c]
    changed = np.arange(len(c))
    for i in range(rounds + 1):
        last, state = state, written(_assigned(state, c, changed))
        discard(last)
        if i == rounds or not len(c):
            break
        for r in transfers(state, dim).collect():  # a row a cluster
            counts[r["cluster"]] += r["n"]
            sums[r["cluster"]] = [a + b for a, b in zip(sums[r["cluster"]], r[2:], strict=True)]
        new = np.array([[s // n for s in own] if n else old for own, n, old in zip(sums, counts, c.tolist(), strict=True)], np.int64)
        changed = np.flatnonzero((new != c).any(1))
        c = new
        if not len(changed):
            break
    found = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    whole = None if None in found.values() or sum(found.values()) >= 1 << 63 else sum(found.values())
    about = [(i, found[i], whole, hashlib.sha256(",".join(map(str, c[i].tolist())).encode()).hexdigest()) for i in sorted(found)]
    named = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3, dim=64, scale=64)


def _round(i: int) -> str:
    return f"""
x{i} AS (SELECT p.id, c.cluster, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p, c{i} c),
a{i} AS (SELECT id, cluster, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS r FROM x{i}) WHERE r = 1),
u{i} AS (SELECT cluster, j, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT a.cluster, unnest(p.v) AS y, unnest(range(64)) AS j FROM a{i} a JOIN p USING (id)) GROUP BY 1, 2),
c{i + 1} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT cluster, list((s - ((s % n + n) % n)) // n ORDER BY j) AS v FROM u{i} GROUP BY cluster) m USING (cluster))"""


ORACLE_SQL = f"""
WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
p AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS id, vec_id, v FROM k),
c0 AS (SELECT id::INT AS cluster, v FROM p WHERE id < 16),{",".join(map(_round, range(4)))}
SELECT p.vec_id, a.cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM p JOIN a3 a USING (id) JOIN c3 c USING (cluster)
"""
