"""Substring dedup: windows of words that start in a smaller document, found by joining equal window hashes. This replaces
relative Lempel-Ziv parsing: there are no reference blocks and there is no longest-match search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, appended, discard, grams, plus, small_batches, texts, tidied, without, written

#: Words in the fingerprints that lead equal windows to each other.
GRAM = 16


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n neighbours."""
    span = 1
    while span * 2 <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (n - span)], x[n - span :])


def windows(words: list[bytes], hashes: WordHash, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window hashes, fingerprint of each): the fingerprint is the least hash of the window's grams, so equal windows
    have equal ones, and neighbouring windows mostly share theirs."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = hashes.array(words)
    gram = min(GRAM, window)
    return grams(h, window), _least(grams(h, gram), window - gram + 1)


def _fingerprints(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, h, c1, c2, fs) per document of at least window words: hashes of its text and (128 bits) of its words, and its
    fingerprints."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            rows = []
            for doc, h, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), texts(b), strict=True):
                words = t.split()
                if len(words) >= window:
                    fs = np.unique(windows(words, hashes, window)[1]).view(np.int64)
                    c = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64)
                    rows.append((doc, h, int(c[0]), int(c[1]), fs))
            cols = list(zip(*rows, strict=True)) or [[], [], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "h", "c1", "c2", "fs"])

    return docs.withColumn("h", F.xxhash64("text")).mapInArrow(run, "doc_id long, h long, c1 long, c2 long, fs array<long>")


def _own(text: Column, h: Column) -> Column:
    """Whether a row's text is the one that h means; null h stands for the only text of its doc_id."""
    return h.isNull() | (h == F.xxhash64(text))


def _ordered_hits(index: DataFrame) -> DataFrame:
    """(doc_id, h, start): the rows of index (w, doc_id, start, h) whose w also stands in a smaller doc_id.

    Rows are range-sorted by (w, doc_id), so that one very common window spreads over many tasks; each task compares rows
    with the least doc_id that it has seen of their window. What a task can't know is whether its first window began
    in an earlier task: those rows wait for the tasks' last windows, one row each.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = least = None
        for b in batches:
            w, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(w):
                continue
            first = w[0] if first is None else first
            new = np.concatenate([[w[0] != last], w[1:] != w[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(w)), -1))
            low = np.where(at >= 0, doc[np.maximum(at, 0)], least if least is not None else 0)
            last, least = w[-1], low[-1]
            kind = np.where(doc > low, 0, np.where(w == first, 1, 3)).astype(np.int32)
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(kind)], names=["w", "doc_id", "start", "h", "kind"])
            yield out.filter(pa.array(kind < 3))
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((last, pa.int64()), (least, pa.int64()), (None, pa.int32()), (None, pa.int64()), (2, pa.int32()))], names=["w", "doc_id", "start", "h", "kind"])

    spread = index.select("w", "doc_id", "start", "h").repartitionByRange("w", "doc_id").sortWithinPartitions("w", "doc_id")
    marks = written(spread.mapInArrow(run, "w long, doc_id long, start int, h long, kind int"))
    ends = marks.filter("kind = 2").groupBy("w").agg(F.min("doc_id").alias("low"))
    late = marks.filter("kind = 1").join(ends, "w").filter("doc_id > low")
    return marks.filter("kind = 0").select("doc_id", "h", "start").unionByName(late.select("doc_id", "h", "start"))


def _repeated_starts(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, h, copy, starts): whether all of a row's windows start in a smaller document, else which do. h is the hash
    of the row's text where its doc_id has several texts, else null. A written table."""
    prints = written(_fingerprints(docs, window))
    first = prints.groupBy("c1", "c2").agg(F.min("doc_id").alias("first"))
    marked = prints.join(first, ["c1", "c2"]).select("doc_id", "h", "fs", (F.col("doc_id") > F.col("first")).alias("copy"))
    several = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi")).filter("lo < hi")
    several = written(several.select("doc_id", F.lit(True).alias("several")))
    marked = marked.join(several, "doc_id", "left").withColumn("h", F.when(F.col("several"), F.col("h")))
    marked = written(marked.groupBy("doc_id", "h", "copy").agg(F.first("fs").alias("fs")))  # a row that comes twice is one here
    discard(prints, several)
    each = marked.filter(~F.col("copy")).select("doc_id", "h", F.explode("fs").alias("f"))
    shared = each.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1").select("f")
    to_index = each.join(shared, "f").groupBy("doc_id", "h").agg(F.collect_list("f").alias("fs")).withColumnRenamed("doc_id", "__id")

    @tidied
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            out: list[tuple] = []
            for doc, h, t, fs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b), b.column(3), strict=True):
                w, f = windows(t.split(), hashes, window)
                at = np.nonzero(np.isin(f, fs.values.to_numpy().view(np.uint64)))[0]
                out.append((w[at].view(np.int64), np.full(len(at), doc, np.int64), at.astype(np.int32), np.full(len(at), h or 0, np.int64), np.full(len(at), h is None)))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)]
            for lo in range(0, max(1, len(cols[0])), 100_000):
                *part, h, none = (c[lo : lo + 100_000] for c in cols)
                yield pa.RecordBatch.from_arrays([*map(pa.array, part), pa.array(h, mask=none)], names=["w", "doc_id", "start", "h"])

    own = docs.join(to_index, (F.col("doc_id") == F.col("__id")) & _own(F.col("text"), F.col("h")))
    index = written(own.select("doc_id", "h", "text", "fs").mapInArrow(emit, "w long, doc_id long, start int, h long"))
    starts = _ordered_hits(index).groupBy("doc_id", "h").agg(F.collect_list("start").alias("starts"))
    copies = marked.filter("copy").select("doc_id", "h").distinct()
    spans = copies.select("doc_id", "h", F.lit(True).alias("copy"), F.array().cast("array<int>").alias("starts")).unionByName(starts.select("doc_id", "h", F.lit(False).alias("copy"), "starts"))
    spans = written(spans)
    discard(index, marked)
    return spans


def factors(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Runs of neighbouring starts as word ranges; every start was looked up by itself."""
    if not len(starts):
        return []
    starts = np.sort(starts)
    cut = np.nonzero(np.diff(starts) > 1)[0]
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + window).tolist(), strict=True))


def dedup_substrings(docs: DataFrame, window: int = 50, rejoin: bool = True) -> DataFrame:
    """docs with text less every word in a window that also starts in a document with smaller doc_id; n_words, n_removed.

    Words are runs of anything but ASCII white space; kept words are joined by one space (without rejoin, texts that
    lose nothing keep their layout). Windows are judged on the input. Null and empty texts, and texts under window
    words, lose nothing and null comes back as ''. Documents without doc_id lose nothing and serve nobody as a source;
    rows of equal doc_id aren't sources for each other, and each is judged by its own text. Other columns stay; those named n_words or n_removed give way.
    """
    small_batches(docs.sparkSession)
    docs = without(docs, ["n_words", "n_removed", "copy", "starts"])
    known = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    spans = _repeated_starts(known, window).withColumnsRenamed({"doc_id": "__id", "h": "__h"})
    joined = docs.join(spans, (F.col("doc_id").cast("long") == F.col("__id")) & _own(F.col("text"), F.col("__h")), "left").drop("__id", "__h")
    others = docs.drop("text")
    out = plus(others, "text string, n_words long, n_removed long")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            copy, starts = (b.column(b.schema.get_field_index(n)) for n in ("copy", "starts"))
            kept, n_words, n_removed = [], [], []
            for t, c, s in zip(texts(b), copy.to_pylist(), starts, strict=True):
                words = t.split()
                n = len(words)
                n_words.append(n)
                if c:
                    words = []
                elif s.is_valid:
                    left, at = [], 0
                    for lo, hi in factors(s.values.to_numpy(), window):
                        left += words[at:lo]
                        at = max(at, hi)
                    words = left + words[at:]
                n_removed.append(n - len(words))
                kept.append(t if not rejoin and len(words) == n else b" ".join(words))
            yield appended(b, {"text": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}, ("text", "copy", "starts"))

    return joined.mapInArrow(run, out)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, 50).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS lo FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
h AS (SELECT doc_id, i FROM w JOIN f USING (k) WHERE doc_id > lo),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT a.doc_id, count(*) AS n, count(r.p) AS gone, coalesce(string_agg(a.word, ' ' ORDER BY a.p) FILTER (WHERE r.p IS NULL), '') AS kept
  FROM a LEFT JOIN r ON a.doc_id = r.doc_id AND a.p = r.p GROUP BY a.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
