"""N-gram Jaccard join: token groups lead candidates together, count vectors in R-trees bound their overlap, sets decide."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, discard, grams, mix, small_batches, texts, tidied, written
from .components import components

#: Sizes in one band differ by less than this factor.
BAND = 1.5
#: Groups beyond those that a linked pair can differ in: at least so many, and one for so many differences.
SPARE, PER_SPARE = 2, 8
#: Low bits of a key that tell its band and grouping.
BAND_BITS = 10
#: Groupings of a band, each by a hash of its own, that sets with too many empty groups go through; then prefixes tell them.
GROUPINGS = 6
#: Members whose sets are compared with their lead's in one group.
MEMBERS = 4096
#: Sets up to FINE tokens have more groups than tokens, larger ones a group for about four.
FINE = 4096
#: Points in a leaf of the R-tree, children of its inner nodes, and numbers compared at a time.
LEAF, FAN, CELLS = 16, 4, 1 << 18
#: Members of a bucket that one tree holds; larger buckets are joined chunk by chunk.
CHUNK = 1024
#: Sets that a task remembers to tell copies; what falls out is found again by its keys.
REMEMBERED = 200_000


class Rule:
    """Sets a, b link when den * |a & b| >= num * |a | b|, at least."""

    def __init__(self, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
        self.edges = np.array(edges)

    def shingles(self, text: bytes, hashes: WordHash) -> np.ndarray:
        """Sorted distinct hashes of all runs of k words (of the whole sequence, if it is shorter)."""
        words = text.lower().split()  # of bytes: A-Z and ASCII white space only
        h = hashes.array(words)
        return np.unique(grams(h, min(self.k, len(h)))) if len(h) else np.zeros(0, np.uint64)

    def spare(self, band: int) -> tuple[int, int]:
        """(elements in which a pair can differ whose smaller set lies in the band, groups beyond those)."""
        top = int(self.edges[band + 1]) - 1
        differ = (top + top * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        return differ, max(SPARE, differ // PER_SPARE)

    def bands(self, n: int) -> list[int]:
        """The own band, and lower ones with sets small enough for a partner of this size."""
        b = int(np.searchsorted(self.edges, n, "right")) - 1
        out = [b]
        while b and (int(self.edges[b]) - 1) * self.den // self.num >= n:
            b -= 1
            out.append(b)
        return out

    def keys(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, needs): keys of the set in each of its bands, and how many keys of a band and grouping it has in common with
        any set that it is linked with and that has enough groups there, as need << BAND_BITS | code.

        In a band of D possible differences there are D + 1 + spare groups, so that linked sets agree in over spare of them.
        Every key is the content of a group that isn't empty. A set with more empty groups than spare meets all linked sets
        with fewer; for the others like it, its tokens are grouped anew by another hash, and so on. Should a set stay
        sparse in all groupings, the first of its tokens are keys: two linked sets have one of those in common.
        """
        out, needs = [], []
        for band in self.bands(len(h)):
            differ, spare = self.spare(band)
            for turn in range(GROUPINGS + 1):
                code = np.array([band * (GROUPINGS + 1) + turn], np.uint64)
                own = h if not turn else np.sort(mix(h + np.uint64(turn)))
                if turn == GROUPINGS:
                    first = own[: len(h) - -(-len(h) * self.num // self.den) + 1]
                    key, need = mix(first + mix(code)), 1
                else:
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(own + np.uint64(0x2545F491)))])
                    cut = np.concatenate([[0], np.searchsorted(own, _cuts(differ + 1 + spare)), [len(h)]])
                    size = np.diff(cut)
                    place = np.arange(len(size), dtype=np.uint64) + (code + np.uint64(1) << np.uint64(40))
                    full = size > 0
                    key = mix((sums[cut[1:]] - sums[cut[:-1]] + mix(place) + size.astype(np.uint64))[full])
                    need = max(1, spare + 1 - int((~full).sum()))
                out.append(key >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | code)
                needs.append(need << BAND_BITS | int(code[0]))
                if turn == GROUPINGS or (~full).sum() <= spare:
                    break
        return np.concatenate(out), np.array(needs, np.int64)

    @staticmethod
    def bits(n) -> np.ndarray:
        """Leading bits that tell the token groups of sets of n tokens apart."""
        n = np.maximum(n, 1)
        return np.maximum(6, np.floor(np.log2(n)).astype(np.int64) + np.where(n <= FINE, 1, -1))

    def counts(self, h: np.ndarray) -> bytes:
        """Counts of the set's token groups in unary, one bit plane a level: planes whose common bits number the summed
        coordinate minima. What stands above the last plane is told by n less the bits set."""
        bits = int(self.bits(len(h)))
        return _planes(np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)[None], 3 if len(h) <= FINE else 8).tobytes()

    def enough(self, overlap, total):
        """Whether an overlap of sets with total elements together links them (or may)."""
        return overlap * (self.num + self.den) >= self.num * total


@lru_cache(4096)
def _cuts(groups: int) -> np.ndarray:
    return np.array([(i << 64) // groups for i in range(1, groups)], np.uint64)


def _planes(counts: np.ndarray, planes: int) -> np.ndarray:
    """(row, plane, byte): bit g of plane i says that group g holds more than i tokens."""
    return np.packbits(counts[:, None] > np.arange(planes)[None, :, None], axis=2, bitorder="little")


class Points:
    """Count vectors of sets as points of one space: the fewest groups and planes among them."""

    def __init__(self, blobs: list[bytes], n: np.ndarray):
        wide = 1 << (Rule.bits(n) - 3)
        planes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // wide
        self.n, self.wide, self.planes = n.astype(np.int64), int(wide.min()), int(planes.min())
        out = np.empty((len(blobs), self.planes, self.wide), np.uint8)
        for w, p in set(zip(wide.tolist(), planes.tolist(), strict=True)):
            at = np.flatnonzero((wide == w) & (planes == p))
            for some in np.array_split(at, -(-len(at) * w * p // CELLS)):
                own = np.frombuffer(b"".join([blobs[i] for i in some]), np.uint8).reshape(len(some), p, w)
                if w > self.wide:
                    count = np.unpackbits(own, axis=2, bitorder="little").sum(1, dtype=np.uint8)
                    own = _planes(count.reshape(len(some), self.wide * 8, -1).sum(2), self.planes)
                out[some] = own[:, : self.planes]
        self.bits = out.reshape(len(blobs), -1).view(np.uint64)
        self.over = self.n - np.bitwise_count(self.bits).sum(1, dtype=np.int64)


def _overlap(a: np.ndarray, over_a: np.ndarray, b: np.ndarray, over_b: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps of a's sets with b's, row by row."""
    return np.bitwise_count(a & b).sum(1, dtype=np.int64) + np.minimum(over_a, over_b)


def _profiles(docs: DataFrame, rule: Rule) -> DataFrame:
    """(m, doc_id, h, n, c, rep, vec, keys, needs) per row: its number, its text's and its set's hash, set size, the row of the
    same task that has the same set first; for those first ones the counts of token groups, the keys, and the
    needs of its bands."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, first = WordHash(), {}
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for b in batches:
            rows = []
            for m, doc, h, t in zip(*(b.column(i).to_pylist() for i in range(3)), texts(b), strict=True):
                s = rule.shingles(t, hashes)
                if doc is None or not len(s):
                    rows.append((m, doc, h, len(s), None, None, None, None, None))
                    continue
                c = int(mix(s).sum().view(np.int64))
                if len(first) > REMEMBERED:
                    first.clear()
                rep = first.setdefault((c, len(s)), m)
                keys, needs = rule.keys(s) if rep == m else (None, None)
                rows.append((m, doc, h, len(s), c, rep, *((rule.counts(s), keys.view(np.int64), needs) if rep == m else (None, None, None))))
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["m", "doc_id", "h", "n", "c", "rep", "vec", "keys", "needs"])

    rows = docs.select(F.monotonically_increasing_id().alias("m"), "doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "m long, doc_id long, h long, n int, c long, rep long, vec binary, keys array<long>, needs array<long>")


def _met(keyed: DataFrame) -> DataFrame:
    """(key, m) of every member of a bucket of two and more: rows come sorted and stream by."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, if nothing says yet whether its bucket has another
        last = None
        for b in batches:
            key, m = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(key):
                continue
            if held is not None:
                key, m = np.concatenate([[held[0]], key]), np.concatenate([[held[1]], m])
            same = np.concatenate([[key[0] == last], key[1:] == key[:-1]])
            keep = same.copy()
            keep[:-1] |= same[1:]
            held = None if keep[-1] else (key[-1], m[-1])
            last = key[-1] if keep[-1] else None
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(m[keep])], names=["key", "m"])

    return keyed.repartition("key").sortWithinPartitions("key", "m").mapInArrow(run, "key long, m long")


def _stars(met: DataFrame, needs: DataFrame) -> DataFrame:
    """(key, m, lead) for every member of a bucket but its first, lead, as far as rows meet others in as many buckets of a
    band as they must to be linked with any."""
    band = (F.col("key").bitwiseAND((1 << BAND_BITS) - 1)).alias("band")
    enough = met.groupBy("m", band).agg(F.count("*").alias("n")).join(needs, ["m", "band"]).filter("n >= need").select("m", "band")
    own = written(met.select("key", "m", band).join(enough, ["m", "band"], "left_semi").select("key", "m"))
    first = own.groupBy("key").agg(F.min("m").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("key", "lead")
    return own.join(first, "key").filter("m > lead").select("key", "m", "lead")


def _sets(pairs: DataFrame, docs: DataFrame, points: DataFrame, rule: Rule) -> DataFrame:
    """(m, s): the sets of the rows in pairs; only their texts are read into sets."""

    @tidied
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            s = [rule.shingles(t, hashes) for t in texts(b)]
            c = [int(mix(x).sum().view(np.int64)) if len(x) else 0 for x in s]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c, pa.int64()), pa.array([x.tobytes() for x in s], pa.binary())], names=["doc_id", "c", "s"])

    wanted = pairs.select(F.col("a").alias("m")).unionByName(pairs.select(F.col("b").alias("m"))).distinct().join(points.select("m", "doc_id", "c"), "m")
    own = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, c long, s binary")
    return written(own.join(wanted, ["doc_id", "c"]).select("m", "s"))


def _verified(pairs: DataFrame, own: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sets link. A lead's set travels once for MEMBERS others, and each of theirs once a pair."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    placed = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    leads = placed.select("a", "part").distinct().join(own.withColumnRenamed("m", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "s")
    members = placed.join(own.withColumnRenamed("m", "b"), "b").select("a", "part", "b", "s")

    @tidied
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, t = None, np.zeros(0, np.uint64)
        for b in batches:
            good = []
            for x, y, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                if y is None:  # comes first
                    lead, t = x, s.copy()
                total = len(s) + len(t)
                ok = y is not None and x == lead and rule.enough(min(len(s), len(t)), total)
                good.append(bool(ok and rule.enough(int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()), total)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    rows = leads.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return rows.mapInArrow(check, "a long, b long").distinct()


def _bounded(pairs: DataFrame, points: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that the summed coordinate minima of their count vectors allow to link: vectors are far smaller
    than sets, so most chance meetings end here."""

    @tidied
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            va, vb, na, nb = (b.column(i).to_pylist() for i in (2, 3, 4, 5))
            wide = Rule.bits(np.minimum(na, nb))
            good = np.zeros(len(va), bool)
            for w in np.unique(wide):
                at = np.flatnonzero(wide == w)
                for some in np.array_split(at, -(-(len(at) << int(w)) // (CELLS * 8))):
                    v = Points([va[i] for i in some] + [vb[i] for i in some], np.array([na[i] for i in some] + [nb[i] for i in some]))
                    k = len(some)
                    good[some] = rule.enough(_overlap(v.bits[:k], v.over[:k], v.bits[k:], v.over[k:]), v.n[:k] + v.n[k:])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good))

    left, right = (points.select(F.col("m").alias(x), F.col("vec").alias(f"v{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "va", "vb", "na", "nb").mapInArrow(check, "a long, b long")


class RTree:
    """Points in a tree: they are halved by the group that holds tokens of nearest half of them down to leaves, FAN
    neighbours at a time form the next level, and each node keeps the maxima of its points' counts (in unary, the union of
    their bits) and of what stands above the last plane, and the least of their sizes."""

    def __init__(self, own: Points, at: np.ndarray):
        leaves, todo = [], [at]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                leaves.append(at)
                continue
            first = np.unpackbits(np.ascontiguousarray(own.bits[at, : max(1, own.wide // 8)]).view(np.uint8), axis=1)
            at = at[np.argsort(first[:, np.abs(2 * first.sum(0, dtype=np.int64) - len(at)).argmin()], kind="stable")]
            todo += [at[len(at) // 2 :], at[: len(at) // 2]]
        self.own, self.order = own, np.concatenate(leaves)
        self.edges = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
        level = own.bits[self.order], own.over[self.order], own.n[self.order]
        starts, self.levels = self.edges[:-1], []
        while True:
            level = np.bitwise_or.reduceat(level[0], starts), np.maximum.reduceat(level[1], starts), np.minimum.reduceat(level[2], starts)
            self.levels.append(level)
            if len(level[1]) == 1:
                break
            starts = np.arange(0, len(level[1]), FAN)

    def search(self, queries: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs whose overlap bound, the summed coordinate minima, allows a link."""
        own = self.own

        def open_(q: np.ndarray, at: np.ndarray, bits: np.ndarray, over: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok, step = [np.zeros(0, bool)], max(1, CELLS // own.bits.shape[1])
            for i in range(0, len(q), step):
                x, y = q[i : i + step], at[i : i + step]
                ok.append(rule.enough(_overlap(own.bits[x], own.over[x], bits[y], over[y]), own.n[x] + least[y]))
            ok = np.concatenate(ok)
            return q[ok], at[ok]

        q, at = queries, np.zeros(len(queries), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            q, at = open_(q, at, *self.levels[depth])
            if depth:
                lo, hi = at * FAN, np.minimum((at + 1) * FAN, len(self.levels[depth - 1][1]))
            else:
                lo, hi = self.edges[at], self.edges[at + 1]
            number = hi - lo
            q, at = np.repeat(q, number), np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(lo, number)
        return open_(q, self.order[at], own.bits, own.over, own.n)


def _block_pairs(members: DataFrame, points: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): pairs of members (key, m, label) of a bucket that may link and have different labels. Buckets over CHUNK
    members fall into chunks by a hash, and each pair of chunks is a group of its own; vectors join last."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("cs"))
    placed = members.join(sizes, "key").withColumn("c", F.pmod(F.xxhash64("m"), F.col("cs")).cast("int"))
    paired = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cs") - 1)))
    paired = paired.select("key", "m", "label", "c", F.least("c", "o").alias("c1"), F.greatest("c", "o").alias("c2")).join(points.select("m", "n", "vec"), "m")

    def match(m: np.ndarray, label: np.ndarray, c: np.ndarray, c1: int, c2: int, n: np.ndarray, blobs: list[bytes]) -> np.ndarray:
        left, right = np.flatnonzero(c == c1), np.flatnonzero(c == c2)
        if not len(left) or not len(right):
            return np.zeros((0, 2), np.int64)
        q, p = RTree(Points(blobs, n), right).search(left, rule)
        ok = label[q] != label[p]
        return np.stack([np.minimum(m[q[ok]], m[p[ok]]), np.maximum(m[q[ok]], m[p[ok]])], 1)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of a group that goes on in the next batch
        for b in itertools.chain(batches, [None]):
            now = b if rest is None else rest if b is None else pa.concat_batches([rest, b])
            if now is None or not now.num_rows:
                continue
            key, c1, c2, m, label, c, n = (now.column(i).to_numpy() for i in range(7))
            cut = np.flatnonzero((key[1:] != key[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])) + 1
            cut = [0, *cut.tolist(), *([now.num_rows] if b is None else [])]
            blobs = now.column(7).slice(0, cut[-1]).to_pylist()
            found = [match(m[lo:hi], label[lo:hi], c[lo:hi], c1[lo], c2[lo], n[lo:hi], blobs[lo:hi]) for lo, hi in zip(cut, cut[1:], strict=False)]
            ab = np.unique(np.concatenate([*found, np.zeros((0, 2), np.int64)]), axis=0)
            rest = now.slice(cut[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ab[:, i])) for i in (0, 1)], names=["a", "b"])

    groups = paired.select("key", "c1", "c2", "m", "label", "c", "n", "vec").repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2")
    return groups.mapInArrow(run, "a long, b long").distinct()


def linked_rows(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, h, n_shingles, component_id, group of every row of docs: near_duplicates(), with the hash of the row's text
    and the number of its group of linked rows (null if its set is empty or it has no doc_id)."""
    rule = Rule(k, num, den)
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    prof = written(_profiles(docs, rule))
    met = written(_met(prof.filter("m = rep").select(F.explode("keys").alias("key"), "m")))
    slim = written(prof.select("doc_id", "h", "n", "rep"))
    points = written(prof.filter("m = rep").select("m", "doc_id", "n", "c", "vec", "needs"))
    discard(prof)
    need = F.explode("needs").alias("x")
    needs = points.select("m", need).select("m", F.col("x").bitwiseAND((1 << BAND_BITS) - 1).alias("band"), F.shiftright("x", BAND_BITS).alias("need"))
    stars = written(_stars(met, needs))
    discard(met)
    # rows of several tasks with one set: the first stands for all
    least = points.groupBy("c", "n").agg(F.min("m").alias("r"))
    copies = written(points.select("m", "c", "n").join(least, ["c", "n"]).filter("m > r").select("m", "r"))

    def first_copy(df: DataFrame, name: str) -> DataFrame:
        own = copies.select(F.col("m").alias(name), F.col("r").alias("__r"))
        return df.join(own, name, "left").withColumn(name, F.coalesce("__r", name)).drop("__r")

    led = stars.select(F.col("lead").alias("a"), F.col("m").alias("b")).distinct()
    led = first_copy(first_copy(led, "a"), "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(_bounded(led, points, rule))
    own = _sets(pairs, docs, points, rule)
    first = written(_verified(pairs, own, rule).unionByName(copies.select(F.col("r").alias("a"), F.col("m").alias("b"))))
    discard(pairs, own)
    roots = components(first)

    def labelled(df: DataFrame, name: str, out: str) -> DataFrame:
        r = roots.select(F.col("node").alias(name), F.col("root").alias("__r"))
        return df.join(r, name, "left").withColumn(out, F.coalesce("__r", name)).drop("__r")

    # What the stars leave open: pairs of members other than the lead, of different components. In a family of near copies
    # the member with most links is likely to link the others too, so it leads each open bucket once.
    seen = written(labelled(stars.select("key", "m").join(copies, "m", "left_anti"), "m", "label"))
    discard(stars)
    links = first.select(F.col("a").alias("m")).unionByName(first.select(F.col("b").alias("m"))).groupBy("m").agg(F.count("*").alias("links"))
    hubs = seen.join(links, "m", "left").groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), "m", "label")).alias("hub"))
    hubs = written(hubs.filter("lo < hi").select("key", "hub"))
    led = seen.join(hubs, "key").filter("label <> hub.label").select(F.least("m", "hub.m").alias("a"), F.greatest("m", "hub.m").alias("b")).distinct()
    pairs = written(_bounded(led, points, rule))
    own = _sets(pairs, docs, points, rule)
    more = written(_verified(pairs, own, rule))
    discard(pairs, own, first)
    first_over = labelled(labelled(more, "a", "la"), "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    joined = components(first_over).select(F.col("node").alias("label"), F.col("root").alias("__j"))
    left = seen.join(hubs.select("key"), "key", "left_semi").join(joined, "label", "left").withColumn("label", F.coalesce("__j", "label")).drop("__j")
    left = written(left.select("key", "m", "label"))
    open_ = left.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    maybe = written(_block_pairs(left.join(open_, "key", "left_semi"), points, rule))
    own = _sets(maybe, docs, points, rule)
    second = written(_verified(maybe, own, rule).unionByName(more))
    discard(seen, hubs, left, maybe, own, more, points, copies)
    over = labelled(labelled(second, "a", "la"), "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    up = components(over).select(F.col("node").alias("r1"), F.col("root").alias("r2"))
    rows = labelled(slim, "rep", "r1").join(up, "r1", "left").select("doc_id", "h", "n", F.coalesce("r2", "r1").alias("group"))
    least = rows.filter("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "group", "left").select("doc_id", "h", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "group")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Documents link when their sets of distinct k-word shingles (words split at ASCII white space, A-Z lower-cased) have
    a Jaccard similarity of num / den or more; component_id is the smallest doc_id that links lead to. Sets of null,
    empty and wordless texts are empty and link with nothing; fewer than k words are one shingle. Equal sets always
    link. Each row of equal doc_id goes by its own set. A row without doc_id links with nothing and has no
    component_id. An empty table gives an empty table. Only doc_id and text are read. Every pair over the threshold is
    found (up to 64-bit hashes): the groups of a pair's tokens agree in more places than the pair can differ in.
    """
    return linked_rows(docs, k, num, den).select("doc_id", "n_shingles", "component_id")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, num=85, den=100)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM d WHERE len(ws) >= 4)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * i >= 85 * (u.n + v.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""
