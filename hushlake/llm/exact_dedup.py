"""Exact dedup: length-and-hash partitions insert whole byte strings into Patricia tries whose terminals know their owner."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, small_batches, texts, written

SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of strings that a trie holds in one task; a node counts NODE_BYTES besides.
TRIE_BYTES, NODE_BYTES = 64 << 20, 400
#: Bytes of strings in one Arrow batch of terminals.
OUT_BYTES = 4 << 20
#: A task is dealt about this share of what its trie may hold.
FILL = 4
#: An owner as (-code points, no doc_id, doc_id, row): the smallest stays.
Owner = tuple[int, bool, int, int]


class Node:
    """A run of bytes, the nodes behind it by their first byte, and what a string that ends here has: its owner, its rows
    and the tries' entries that stand for them."""

    __slots__ = ("copies", "label", "next", "owner", "reps")

    def __init__(self, label: bytes):
        self.label, self.next, self.owner, self.copies, self.reps = label, None, None, 0, None


def _shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes a and b[at:] have in common from the start, by halving."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """A Patricia trie of whole strings. held: bytes of labels and nodes."""

    def __init__(self):
        self.root, self.held, self.spilled = Node(b""), 0, ()

    def node(self, s: bytes) -> Node:
        """The node where s ends, made if need be: runs without a branch are one node."""
        node, at = self.root, 0
        while at < len(s):
            after = node.next
            if after is None:
                after = node.next = {}
            child = after.get(s[at])
            if child is None:
                child = after[s[at]] = Node(s[at:] if at else s)
                self.held += len(s) - at + NODE_BYTES
                return child
            if s.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            k = _shared(child.label, s, at)
            middle = Node(child.label[:k])
            middle.next = {child.label[k]: child}
            child.label = child.label[k:]
            after[s[at]] = middle
            self.held += NODE_BYTES
            node, at = middle, at + k
        return node

    def add(self, s: bytes, owner: Owner, copies: int, reps: list[int]) -> None:
        """Entries reps stand for so many copies of s, of which owner would stay."""
        node = self.node(s)
        if node.owner is None:
            node.owner, node.copies, node.reps = owner, copies, reps
        else:
            node.owner, node.copies = min(node.owner, owner), node.copies + copies
            node.reps += reps

    def see(self, s: bytes, owner: Owner, row: int) -> int:
        """One more row with s; the first row that had it stands for it."""
        node = self.node(s)
        if node.owner is None:
            node.owner, node.reps = owner, [row]
        node.owner, node.copies = min(node.owner, owner), node.copies + 1
        return node.reps[0]

    @staticmethod
    def below(node: Node, path: bytes) -> Iterator[tuple[bytes, Node]]:
        """(string, node) of every string that ends at or behind node; path leads to it, its own label included."""
        todo = [(path, node)]
        while todo:
            path, node = todo.pop()
            if node.owner is not None:
                yield path, node
            todo += [(path + x.label, x) for x in (node.next or {}).values()]

    def largest(self) -> tuple[Node, int, bytes] | None:
        """(parent, byte, path) of the subtree that is spilled: from the root towards the heavier child, the first that
        leaves something behind. None if all is one string."""
        size: dict[int, int] = {}

        def weigh(top: Node) -> None:
            order, todo = [], [top]
            while todo:
                order.append(n := todo.pop())
                todo += (n.next or {}).values()
            for n in reversed(order):
                size[id(n)] = len(n.label) + NODE_BYTES + sum(size[id(x)] for x in (n.next or {}).values())

        weigh(self.root)
        node, path = self.root, b""
        while node.next:
            byte, child = max(node.next.items(), key=lambda x: size[id(x[1])])
            if len(node.next) > 1 or node.owner is not None:
                return node, byte, path + child.label
            node, path = child, path + child.label
        return None

    def spill(self) -> Iterator[tuple[bytes, Node]]:
        """Takes the heaviest subtree out and yields its strings; those that come later with its path are spilled at once."""
        found = self.largest()
        if found is None:
            return
        parent, byte, path = found
        child = parent.next.pop(byte)
        self.spilled += (path,)
        yield from self.below(child, path)
        self.held = sum(len(n.label) + NODE_BYTES for n in self._nodes())

    def _nodes(self) -> Iterator[Node]:
        todo = [self.root]
        while todo:
            n = todo.pop()
            yield n
            todo += (n.next or {}).values()


_TERMINAL = "size long, h long, body binary, copies long, reps array<long>, n long, doc_id long, m long"
_TERMINAL_TYPES = [("size", pa.int64()), ("h", pa.int64()), ("body", pa.binary()), ("copies", pa.int64()), ("reps", pa.list_(pa.int64())), ("n", pa.int64()), ("doc_id", pa.int64()), ("m", pa.int64())]


def _terminals(found: Iterator[tuple[bytes, Node]], extra: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Batches of strings with what their nodes know; extra columns are null."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _TERMINAL_TYPES, strict=True)]
        return pa.RecordBatch.from_arrays(cols + [pa.nulls(len(rows), t) for _, t in extra], names=[n for n, _ in _TERMINAL_TYPES + extra])

    rows, held = [], 0
    for s, n in found:
        less, _, doc, m = n.owner
        rows.append((len(s), xxhash.xxh3_64_intdigest(s) - (1 << 63), s, n.copies, n.reps, -less, None if n.owner[1] else doc, m))
        held += len(s) + 100
        if held > OUT_BYTES:
            yield batch(rows)
            rows, held = [], 0
    if rows:
        yield batch(rows)


_ROW = [("sha", pa.binary()), ("rep", pa.int64())]


def first_sight(docs: DataFrame, trie_bytes: int) -> DataFrame:
    """Two kinds of rows from one pass: every document (doc_id, m, n, sha, rep; body null), rep being the first row of the same
    trie with the same string, and every string of the trie (body, size, h, copies, reps, its owner), once the
    task ends or the trie is full. Copies meet here before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for b in batches:
            ids, ms, points = b.column(0).to_pylist(), b.column(1).to_pylist(), pc.fill_null(pc.utf8_length(b.column(2)), 0).cast(pa.int64())
            sha, rep = [], []
            for doc, m, n, t in zip(ids, ms, points.to_pylist(), texts(b), strict=True):
                s = t.translate(None, SPACE)
                sha.append(hashlib.sha256(s).digest())
                rep.append(trie.see(s, (-n, doc is None, doc or 0, m), m))
            cols = {"n": points, "doc_id": b.column(0), "m": b.column(1), "sha": pa.array(sha, pa.binary()), "rep": pa.array(rep, pa.int64())}
            yield pa.RecordBatch.from_arrays([cols.get(name, pa.nulls(b.num_rows, t)) for name, t in _TERMINAL_TYPES + _ROW], names=[name for name, _ in _TERMINAL_TYPES + _ROW])
            if trie.held > trie_bytes:
                yield from _terminals(trie.below(trie.root, b""), _ROW)
                trie = Trie()
        yield from _terminals(trie.below(trie.root, b""), _ROW)

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("m"), "text")
    return rows.mapInArrow(run, f"{_TERMINAL}, sha binary, rep long")


_LINK = [("rep", pa.int64()), ("keep_id", pa.int64()), ("keep_m", pa.int64()), ("group_size", pa.int64())]


def settle(strings: DataFrame, trie_bytes: int) -> DataFrame:
    """Two kinds of rows: (rep, keep_id, keep_m, group_size) for every entry of a string that this round's tries settle, and
    spilled strings (body), which take part in the next round. A task's trie is spilled by subtree when it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for b in batches:
            aside: list[tuple[bytes, Node]] = []
            for s, copies, reps, n, doc, m in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("body", "copies", "reps", "n", "doc_id", "m")), strict=True):
                owner = (-n, doc is None, doc or 0, m)
                if trie.spilled and s.startswith(trie.spilled):
                    node = Node(b"")
                    node.owner, node.copies, node.reps = owner, copies, reps
                    aside.append((s, node))
                else:
                    trie.add(s, owner, copies, reps)
                while trie.held > trie_bytes:
                    before = len(trie.spilled)
                    yield from _terminals(trie.spill(), _LINK)
                    if len(trie.spilled) == before:  # all is one string
                        break
            yield from _terminals(iter(aside), _LINK)
        rows: list[tuple] = []
        for _, n in trie.below(trie.root, b""):
            rows += [(r, None if n.owner[1] else n.owner[2], n.owner[3], n.copies) for r in n.reps]
            if len(rows) > 10_000:
                yield _links(rows)
                rows = []
        if rows:
            yield _links(rows)

    def _links(rows: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _LINK, strict=True)]
        return pa.RecordBatch.from_arrays([pa.nulls(len(rows), t) for _, t in _TERMINAL_TYPES] + cols, names=[n for n, _ in _TERMINAL_TYPES + _LINK])

    return strings.mapInArrow(run, f"{_TERMINAL}, rep long, keep_id long, keep_m long, group_size long")


def exact_duplicates(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs.

    Rows are equal when their texts are, less all ASCII white space; null counts as empty. Of equal rows the one
    with the most code points in its text as it was, then the smallest doc_id (none last), then the first read stays: kept is
    true for one row of each group, keep_id is its doc_id (null if it has none), text_sha256 that of the text compared.
    Rows repeated outright are members each. An empty table gives an empty table. Columns other than doc_id and text are
    not read. Strings are compared whole, by the tries; hashes only say which trie.

    Every task first inserts its own rows, so a string goes to its partition once per task, however many copies there are;
    rows come back to their string by the entry that stood for them, which no more than a task's rows share.
    """
    small_batches(docs.sparkSession)
    seen = written(first_sight(docs, trie_bytes))
    strings = seen.filter("body IS NOT NULL").drop("sha", "rep")
    tables, deals = [], 1
    while True:
        total = strings.agg(F.sum(F.col("size") + NODE_BYTES)).first()[0] or 0
        dealt = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * FILL // trie_bytes)) * deals
        done = written(settle(strings.repartition(dealt, "size", "h", F.lit(deals)), trie_bytes))
        tables.append(done)
        strings = done.filter("body IS NOT NULL").select(*[n for n, _ in _TERMINAL_TYPES])
        if strings.isEmpty():
            break
        deals += 1
    links = reduce(DataFrame.unionByName, [t.filter("body IS NULL").select("rep", "keep_id", "keep_m", "group_size") for t in tables])
    rows = seen.filter("body IS NULL").select("doc_id", "m", "sha", "rep").join(links, "rep")
    out = written(rows.select("doc_id", "keep_id", "group_size", (F.col("m") == F.col("keep_m")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")))
    discard(seen, *tables)
    return out


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size, row_number() OVER w = 1 AS kept, sha256(s) AS text_sha256
FROM d WINDOW w AS (PARTITION BY s ORDER BY length(t) DESC, doc_id)
"""
