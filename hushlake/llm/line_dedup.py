"""Line dedup by a sharded minimal perfect hash with fingerprint and count arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, plus, small_batches, texts, tidied, without, written
from .mphf import Mphf, build

SPACE = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 17
#: The index goes to every executor up to so many bytes; beyond it hashes travel to the shards.
BROADCAST_BYTES = 48 << 20
_SHARD_DDL = "shard int, sizes binary, bits binary, prints binary, counts binary"


def _keys(text: bytes) -> list[bytes]:
    return [line.strip(SPACE) for line in text.lower().split(b"\n")]  # bytes.lower() changes A-Z only


def _digests(keys: list[bytes]) -> np.ndarray:
    """Rows of (place hash, fingerprint), 64 bits each."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)


def _line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h, f) of the distinct line keys of every row."""

    @tidied
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, sizes = [np.empty((0, 2), np.uint64)], []
            for t in texts(b):
                own = {k for k in _keys(t) if len(k) >= min_chars and (min_chars == 1 or len(k.decode("utf-8", "replace")) >= min_chars)}
                sizes.append(len(own))
                if own:
                    parts.append(_digests(list(own)))
            d = np.concatenate(parts)
            doc = b.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([doc, *(pa.array(np.ascontiguousarray(d[:, i]).view(np.int64)) for i in (0, 1))], names=["doc_id", "h", "f"])

    return docs.mapInArrow(emit, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, f long")


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h, f, n): in how many documents each line key occurs; Spark sums map-side first. Rows that share a doc_id are one
    document: what its further rows count too much is taken off again, so that ids needn't travel with all lines."""
    docs = docs.select("doc_id", "text") if "doc_id" in docs.columns else docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    rows = _line_hashes(docs, min_chars).select("h", "f", F.lit(1).alias("n"))
    # written, so that its size is known: texts are shuffled only if such ids are too many to send
    several = written(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    again = _line_hashes(docs.join(several, "doc_id", "left_semi"), min_chars).groupBy("doc_id", "h", "f").agg((1 - F.count("*")).cast("int").alias("n"))
    return rows.unionByName(again.filter("n < 0").select("h", "f", "n")).groupBy("h", "f").agg(F.sum("n").alias("n"))


def line_index(docs: DataFrame, min_docs: int, min_chars: int) -> tuple[DataFrame, int, int]:
    """(shards, number of shards, number of keys) over the line hashes found in at least min_docs documents; rarer lines
    cannot be dropped, so they get no slot and are told apart by their fingerprint."""
    hot = written(line_counts(docs, min_chars).filter(F.col("n") >= min_docs))
    keys = hot.count()
    shards = max(1, math.ceil(keys / SHARD_KEYS))

    def make(t: pa.Table) -> pa.Table:
        h = t.column("h").to_numpy().view(np.uint64)
        f, n = t.column("f").to_numpy().view(np.uint64), t.column("n").to_numpy()
        _, first = np.unique(h, return_index=True)
        h, f, n = h[first], f[first], n[first]
        sizes, bits = build(h)
        place = Mphf(sizes, bits).find(h)
        prints, counts = np.empty(len(h), np.uint64), np.empty(len(h), np.uint32)
        prints[place], counts[place] = f, np.minimum(n, 2**32 - 1)
        row = {"shard": [t.column("shard")[0].as_py()], "sizes": [sizes.tobytes()], "bits": [bits], "prints": [prints.tobytes()], "counts": [counts.tobytes()]}
        return pa.table(row, schema=pa.schema([("shard", pa.int32())] + [(c, pa.binary()) for c in ("sizes", "bits", "prints", "counts")]))

    rows = hot.withColumn("shard", F.pmod(F.shiftrightunsigned("h", 40), F.lit(shards)).cast("int"))
    return written(rows.groupBy("shard").applyInArrow(make, _SHARD_DDL)), shards, keys


class _Shard:
    def __init__(self, r):
        self.mph = Mphf(np.frombuffer(r["sizes"], np.int32), r["bits"])
        self.prints, self.counts = np.frombuffer(r["prints"], np.uint64), np.frombuffer(r["counts"], np.uint32)

    def hot(self, d: np.ndarray, min_docs: int) -> np.ndarray:
        at = self.mph.find(np.ascontiguousarray(d[:, 0]))
        seen = np.maximum(at, 0)
        return (at >= 0) & (self.prints[seen] == d[:, 1]) & (self.counts[seen] >= min_docs)


def _probe(index: dict[int, _Shard], shards: int, d: np.ndarray, min_docs: int) -> np.ndarray:
    out, shard = np.zeros(len(d), bool), ((d[:, 0] >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
    for s in np.unique(shard):
        if s in index:
            at = np.nonzero(shard == s)[0]
            out[at] = index[s].hot(d[at], min_docs)
    return out


def _rewrite(b: pa.RecordBatch, hot_of, min_chars: int) -> pa.RecordBatch:
    """Drop the hot lines of one batch; hot_of(digests, bounds) marks lines of all texts at once."""
    all_keys, bounds, lines = [], [0], []
    for t in texts(b):
        all_keys += _keys(t)
        bounds.append(len(all_keys))
        lines.append(t.split(b"\n"))
    hot = hot_of(_digests(all_keys), bounds) if all_keys else np.zeros(0, bool)
    long = np.fromiter((len(k) >= min_chars and (min_chars == 1 or len(k.decode("utf-8", "replace")) >= min_chars) for k in all_keys), bool, len(all_keys))
    hot &= long
    kept = []
    for i, own in enumerate(lines):
        h = hot[bounds[i] : bounds[i + 1]]
        kept.append(b"\n".join([x for x, y in zip(own, h, strict=True) if not y]) if h.any() else b"\n".join(own))
    n = np.diff(bounds)
    dropped = np.add.reduceat(np.append(hot, False).astype(np.int64), np.array(bounds[:-1], np.int64)) if lines else np.zeros(0, np.int64)
    return appended(b, {"text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(n.astype(np.int64)), "n_dropped": pa.array(dropped)}, ("text", "hot_lines"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with text less every line whose key is found in at least min_docs documents, and n_lines, n_dropped.

    A key is the line stripped of white space at both ends, A-Z lower-cased; keys under min_chars code points stay.
    Null and empty texts have one empty line and come back as ''. Rows that share a doc_id count as
    one document, those without one each for themselves. Other columns
    stay, except that those named n_lines or n_dropped give way. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    table, shards, keys = line_index(docs, min_docs, min_chars)
    docs = without(docs, ["n_lines", "n_dropped", "hot_lines"])
    others = docs.drop("text")
    out = plus(others, "text string, n_lines long, n_dropped long")
    if keys * 16 <= broadcast_bytes:
        rows = table.collect()  # at most broadcast_bytes
        index = spark.sparkContext.broadcast([r.asDict() for r in rows])

        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {r["shard"]: _Shard(r) for r in index.value}
            for b in batches:
                yield _rewrite(b, lambda d, _: _probe(own, shards, d, min_docs), min_chars)

        return docs.mapInArrow(run, out)
    return _routed(docs, table, shards, min_docs, min_chars, out)


def _routed(docs: DataFrame, table: DataFrame, shards: int, min_docs: int, min_chars: int, out) -> DataFrame:
    """The way for an index too large to send: packed hashes go to the shards, hot ones come back by document content."""
    key = F.xxhash64("text")

    @tidied
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).to_pylist()
            rows: list[tuple[int, int, bytes]] = []
            for key_, t in zip(k, texts(b), strict=True):
                d = np.unique(_digests(_keys(t)), axis=0)
                s = ((d[:, 0] >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
                rows += [(int(x), key_, d[s == x].tobytes()) for x in np.unique(s)]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["shard", "k", "d"])

    @tidied
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = -1, None
        for b in batches:
            keys, packed = [], []
            for r in b.to_pylist():
                if r["shard"] != held:  # sorted by shard: one is held at a time
                    held, shard = r["shard"], _Shard(r)
                d = np.frombuffer(r["d"], np.uint64).reshape(-1, 2)
                if (hit := shard.hot(d, min_docs)).any():
                    keys.append(r["k"])
                    packed.append(d[hit].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], names=["k", "d"])

    sent = docs.select(key.alias("k"), "text").mapInArrow(hashes, "shard int, k long, d binary").dropDuplicates(["shard", "k"])
    hot = sent.join(table.hint("merge"), "shard").sortWithinPartitions("shard").mapInArrow(probe, "k long, d binary")
    hot = hot.groupBy("k").agg(F.collect_list("d").alias("hot_lines"))
    joined = docs.withColumn("__k", key).join(hot.withColumnRenamed("k", "__k"), "__k", "left").drop("__k")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [set().union(*[{x[i : i + 16] for i in range(0, len(x), 16)} for x in (p or [])]) for p in b.column(b.schema.get_field_index("hot_lines")).to_pylist()]

            def mark(d: np.ndarray, bounds: list[int], own=own) -> np.ndarray:
                hit = np.zeros(len(d), bool)
                for i, s in enumerate(own):
                    if s:
                        hit[bounds[i] : bounds[i + 1]] = [x.tobytes() in s for x in d[bounds[i] : bounds[i + 1]]]
                return hit

            yield _rewrite(b, mark, min_chars)

    return joined.mapInArrow(run, out)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM raw),
k AS (SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY doc_id
"""
