"""Interval joins: rows sorted by start stream past a set of open intervals; long keys are cut into blocks of positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Positions in a block: an interval is read in every block that it touches, so much shorter ones than this suit best.
BLOCK = 4096


#: Rows that a task holds at a time when it counts or joins spans.
DEAL = 1 << 19


def dealt(rows: DataFrame, *by: str, like: DataFrame | None = None) -> DataFrame:
    """rows dealt by columns over so many tasks that one gets about DEAL of them, whatever their number and the session's shuffle
    partitions. Rows are counted for that, which takes no more than the footers if they are a table's. What is grouped by
    these columns and more isn't shuffled again, nor is a table of keys, that hardly ever repeat, held before the shuffle. like
    is a table to count instead, where rows are no more but take work."""
    return rows.repartition(max(1, -(-(rows if like is None else like).count() // DEAL)), *by)


def grouped_batches(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, group) of whole groups only: rows come sorted by their first columns, keys of them; group numbers runs of rows
    equal in those. A group that a batch cuts off is held back until its rest has come."""
    rest: list[pa.RecordBatch] = []

    def starts(b: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(b.num_rows, bool)
        if b.num_rows:
            new[0] = True
        for c in b.columns[:keys]:
            codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return new

    for b in batches:
        if not b.num_rows:
            continue
        # a batch that lies within the group held back is added unread
        if rest and len(np.flatnonzero(starts(pa.concat_batches([rest[0].slice(0, 1), b])))) == 1:
            rest.append(b)
            continue
        now = pa.concat_batches([*rest, b]) if rest else b
        new = starts(now)
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield now.slice(0, last), np.cumsum(new[:last]) - 1
        rest = [now.slice(last)]
    if rest:
        now = pa.concat_batches(rest)
        yield now, np.zeros(now.num_rows, np.int64)


def sweep(group: np.ndarray, right: np.ndarray, start: np.ndarray, end: np.ndarray, least: np.ndarray) -> tuple[list[int], list[int]]:
    """(left rows, right rows) of all overlapping pairs of rows sorted by (group, start). A pair is met when its later row
    comes, and only if that begins at or behind least of its row; what has ended leaves the open set then and there."""
    lefts: list[int] = []
    rights: list[int] = []
    open_: list[list[tuple[int, int]]] = [[], []]
    held = -1
    for i, (g, r, s, e, lo) in enumerate(zip(group.tolist(), right.tolist(), start.tolist(), end.tolist(), least.tolist(), strict=True)):
        if g != held:
            held, open_ = g, [[], []]
        other = open_[1 - r]
        if other:
            other = open_[1 - r] = [x for x in other if x[0] > s]
            if s >= lo:
                for e2, j in other:
                    if start[j] < e:
                        lefts.append(j if r else i)
                        rights.append(i if r else j)
        open_[r].append((e, i))
    return lefts, rights


def overlapping(left: DataFrame, right: DataFrame, by: list[str], start: str = "start", end: str = "end", block: int = BLOCK) -> DataFrame:
    """(by..., l, r): structs of the other columns of every pair of rows, equal in by, whose half-open intervals overlap.

    Intervals are long numbers; an empty one overlaps those that it lies inside of. Rows with a null in by, start or end
    overlap nothing. Keys are cut into blocks of positions, so that one key with very many intervals spreads over tasks;
    a pair is told in the block where its later interval begins. The work is rows times blocks touched, plus pairs.
    """
    spark_by = [F.col(c) for c in by]

    def side(df: DataFrame, name: str, is_right: int) -> DataFrame:
        s, e = F.col(start).cast("long"), F.col(end).cast("long")
        at = lambda x: F.floor(x / block).cast("long")
        rows = df.filter(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, start, end])))
        item = F.struct(*[F.col(c) for c in df.columns if c not in by])
        return rows.select(*spark_by, F.explode(F.sequence(at(s), at(F.greatest(e - 1, s)))).alias("__b"), s.alias("__s"), e.alias("__e"), F.lit(is_right).alias("__r"), item.alias(name))

    both = side(left, "l", 0).unionByName(side(right, "r", 1), allowMissingColumns=True)
    both = both.select(*by, "__b", "__s", "__e", "__r", "l", "r").repartition(*by, "__b").sortWithinPartitions(*by, "__b", "__s", "__r")
    n = len(by) + 1
    out = T.StructType([both.schema[c] for c in by] + [both.schema["l"], both.schema["r"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, group in grouped_batches(batches, n):
            blocks, s, e, r = (b.column(n - 1 + i).to_numpy() for i in range(4))
            i, j = (pa.array(x, pa.int64()) for x in sweep(group, r, s, e, blocks * block))
            for at in range(0, len(i), 100_000):  # pairs can be many more than rows
                x, y = i.slice(at, 100_000), j.slice(at, 100_000)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(x) for k in range(n - 1)), b.column(n + 3).take(x), b.column(n + 4).take(y)], names=[*by, "l", "r"])

    return both.mapInArrow(run, out)


def islands(rows: DataFrame, by: list[str], start: str = "start", end: str = "end", out: str = "island") -> DataFrame:
    """rows with the number of their island within by: runs of intervals without a gap between them. Intervals that only touch
    are islands of their own; no interval overlaps one of another island."""
    w = Window.partitionBy(*by).orderBy(start, end)
    upto = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(out, F.coalesce(F.col(start) >= upto, F.lit(True)).cast("int")).withColumn(out, F.sum(out).over(w))


#: What is known of the distinct spans of one document: starts, ends, labels, how often each is expected and predicted.
Spans = tuple[list[int], list[int], list[str | None], list[int], list[int]]


def by_document(expected: DataFrame, predicted: DataFrame, key: list[str], values: list[str], tell: Callable[..., list[tuple]], out: str) -> DataFrame:
    """tell(start, end, *values, ne, np) -> rows of out, for every island of a document's spans, expected and predicted.

    Equal spans are one row with two counts; a single shuffle by document serves the counting, the sorting and the
    sweep. Rows of out come behind the key columns. Islands, not documents, are held in memory.
    """
    cols = [*key, "start", "end", *values]
    e = expected.select(*cols, F.lit(1).cast("long").alias("ne"), F.lit(0).cast("long").alias("np"))
    p = predicted.select(*cols, F.lit(0).cast("long").alias("ne"), F.lit(1).cast("long").alias("np"))
    counts = dealt(e.unionByName(p), *key).groupBy(*cols).agg(F.sum("ne").alias("ne"), F.sum("np").alias("np"))
    rows = counts.sortWithinPartitions(*key, "start", "end", *values)
    n = len(key)
    schema = T.StructType([rows.schema[c] for c in key] + T._parse_datatype_string(out).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(schema)]
        for b, group in grouped_batches(batches, n):
            at: list[int] = []
            found: list[tuple] = []
            columns = [c.to_pylist() for c in b.columns[n:]]
            starts, ends, edge, top = columns[0], columns[1], 0, 0
            for i, g in enumerate([*group.tolist(), -1]):
                if i and (g == -1 or g != group[i - 1] or starts[i] >= top):
                    new = tell(*[c[edge:i] for c in columns])
                    found += new
                    at += [edge] * len(new)
                    edge, top = i, 0
                if g != -1:
                    top = ends[i] if i == edge else max(top, ends[i])
            own = list(zip(*found, strict=True)) or [[] for _ in kinds[n:]]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at, pa.int64())) for k in range(n)), *(pa.array(c, t) for c, t in zip(own, kinds[n:], strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)


def one_to_one(start: list[int], end: list[int], label: list, ne: list[int], np_: list[int], same_label: bool = True) -> list[tuple[int, int, int]]:
    """(expected, predicted, how many) among distinct spans of an island: overlapping pairs taken greedily, exact ones first,
    then equal labels, then the larger overlap, then the earlier spans."""
    pairs = []
    predicted = [j for j, n in enumerate(np_) if n]
    open_: list[int] = []
    ahead = iter([*predicted, None])
    coming = next(ahead)
    for i in range(len(start)):  # sorted by start: predictions open as they come and go when they have ended
        if not ne[i]:
            continue
        while coming is not None and start[coming] < end[i]:
            open_.append(coming)
            coming = next(ahead)
        open_ = [j for j in open_ if end[j] > start[i]]
        for j in open_:
            # one that opened for a longer span before can begin behind this one
            if start[j] < end[i] and (not same_label or label[i] == label[j]):
                over = min(end[i], end[j]) - max(start[i], start[j])
                exact = start[i] == start[j] and end[i] == end[j]
                pairs.append((not exact, label[i] != label[j], -over, i, j))
    left, right, out = ne[:], np_[:], []
    for *_, i, j in sorted(pairs):
        if n := min(left[i], right[j]):
            left[i] -= n
            right[j] -= n
            out.append((i, j, n))
    return out
