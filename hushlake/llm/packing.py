"""Best-fit packing of tokenised documents into sequences of a fixed length, in bulk-synchronous supersteps."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, small_batches, texts, tidied, written

#: White space other than space and line feed: texts that hold it take the general way.
_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A single space between two characters that aren't white space always begins a pre-token.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LONG = 64


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class ChunkEncoder:
    """Token ids of whole texts as little-endian bytes. A text falls into chunks at single inner spaces and line feeds,
    where the byte-level pre-tokenizer always cuts, so chunks that come again are looked up, not encoded again."""

    LIMIT = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok, self.letters = Tokenizer.from_file(path), _byte_letters()
        self.model, self.space = self.tok.model, self.letters[32]
        self.seen: dict[str, bytes] = {}  # chunks behind a space, without it; those without a space before begin with one
        self.old: dict[str, bytes] = {}
        self.packed = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        self.line = self._ids(["\n"])[0]

    @classmethod
    def at(cls, path: str) -> ChunkEncoder:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return kept((cls, path), lambda: cls(path))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text:  # a special token may stand here and span chunks
            return self._ids([text])[0]
        odd = "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n"
        if odd or _RARE_SPACE.search(text):
            chunks = _CUT.split(text)
            chunks[0] = " " + chunks[0]
            return b"".join(self._looked_up(chunks))
        if "\n" in text:
            return self.line.join([b"".join(self._looked_up((" " + x).split(" ")[1:], True)) for x in text.split("\n")])
        return b"".join(self._looked_up(text.split(" "), True))

    def _looked_up(self, chunks: list[str], mark: bool = False) -> list[bytes]:
        if mark:
            chunks[0] = " " + chunks[0]
        got = list(map(self.seen.get, chunks))
        if None in got:
            hard: dict[str, list[int]] = {}
            for i in [i for i, x in enumerate(got) if x is None]:
                chunk = chunks[i]
                if (ids := self._known(chunk)) is None and (ids := self._easy(chunk)) is None:
                    hard.setdefault(chunk, []).append(i)
                else:
                    got[i] = ids
            for (chunk, at), ids in zip(hard.items(), self._ids([c[1:] if c[0:1] == " " else " " + c for c in hard]), strict=True):
                self._keep(chunk, ids)
                for i in at:
                    got[i] = ids
        return got

    def _known(self, chunk: str) -> bytes | None:
        if (ids := self.seen.get(chunk)) is None and (ids := self.old.get(chunk)) is not None:
            self._keep(chunk, ids)
        return ids

    def _keep(self, chunk: str, ids: bytes) -> None:
        """Chunks are kept in two halves: the older one goes when the younger is full, but for what was met again since."""
        if len(chunk) <= _LONG:
            self.seen[chunk] = ids
            if 2 * len(self.seen) >= self.LIMIT:
                self.old, self.seen = self.seen, {}

    def _easy(self, chunk: str) -> bytes | None:
        """Letters, perhaps with closing marks: one or two pre-tokens, which go to the merges directly. The word is kept by
        itself, as it comes with and without marks."""
        if chunk.isalpha() and chunk.isascii():  # most
            ids = self._merged(self.space + chunk)
            self._keep(chunk, ids)
            return ids
        inner = chunk[0:1] != " "
        bare = chunk if inner else chunk[1:]
        word = bare.rstrip(".,;:!?$&%#*")
        if not word.isalpha():
            return None
        marks = bare[len(word) :]
        own = chunk[: len(chunk) - len(marks)] if marks else chunk
        if not marks or (ids := self._known(own)) is None:
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = self._merged(self.space + letters if inner else letters)
            self._keep(own, ids)
        if marks:
            ids += self._merged(marks)
            self._keep(chunk, ids)
        return ids

    def _merged(self, pre_token: str) -> bytes:
        return b"".join([self.packed[t.id] for t in self.model.tokenize(pre_token)])

    def _ids(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch(chunks, add_special_tokens=False)] if chunks else []


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's ids and end_id; a document over max_tokens
    is cut into pieces of max_tokens, the first of which takes the remainder."""
    end = np.array([end_id], "<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ChunkEncoder.at(tokenizer_path)
        for b in batches:
            cols: list[list] = [[] for _ in fields]
            for doc, text in zip(b.column(0).to_pylist(), texts(b), strict=True):
                ids = enc.encode(text.decode()) + end
                n = len(ids) // 4
                cuts = [0, *range(n % max_tokens or max_tokens, n + 1, max_tokens)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[4 * lo : 4 * hi]
                    for c, v in zip(cols, (doc, k, lo, hi - lo, zlib.crc32(own), own), strict=False):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int]]:
    """Where the documents of each length go: (length, first rank, number, first sequence, offset) runs.

    Documents of one length, and sequences filled alike, are interchangeable: a superstep matches the longest length
    left against the smallest gap that takes it (its successor), ranks decide which documents get the contested gaps,
    gaps are updated, and the next superstep follows. State and steps are bounded by room, not by the documents.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    runs, opened = [], 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            gap = next((g for g in range(length, room + 1) if gaps.get(g)), None)
            if gap is None:
                gap, per = room, room // length
                number = max(1, left // per)
                first = opened
                opened += number
            else:
                first, number = gaps[gap].pop()
                per = gap // length
                if left < number * per and left >= per:
                    number, rest = left // per, number - left // per
                    gaps[gap].append((first + number, rest))
            if left < per or number * per > left:  # fewer documents than one whole fill: one sequence takes them
                if number > 1:
                    gaps[gap].append((first + 1, number - 1))
                number, per = 1, min(per, left)
            for j in range(per):
                runs.append((length, rank, number, first, room - gap + j * length))
                rank += number
            left -= number * per
            if gap - per * length:
                gaps[gap - per * length].append((first, number))
    return runs


def ranked(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces with part and idx, offsets by part and length): pieces range-sorted by length, then id, and numbered in
    their length; idx counts within one partition, the offsets within all earlier ones."""
    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    spread = pieces.repartitionByRange(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    @tidied
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            idx = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.nonzero(length == x)[0]
                idx[at] = seen.get(int(x), 0) + np.arange(len(at))
                seen[int(x)] = seen.get(int(x), 0) + len(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(idx)], names=[*b.schema.names, "idx"])

    ddl = pieces.schema.simpleString()[len("struct<") : -1]
    table = written(spread.withColumn("part", F.spark_partition_id()).mapInArrow(number, f"{ddl},part:int,idx:bigint"))
    counts = table.groupBy("length", "part").agg(F.count("*").alias("n"))
    return table, counts


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of all docs with sequence_id and offset, gapless from 0 in each sequence, no sequence over max_tokens.

    Null and empty texts are the end token alone. Repeated rows, also of one doc_id, are packed as often as they come.
    Other columns are not read. An empty table gives an empty table. with_ids adds the piece's ids as little-endian
    32-bit numbers.
    """
    pieces = written(tokenized_pieces(docs, tokenizer_path, max_tokens, end_id, with_ids))
    table, counts = ranked(pieces)
    by_part = sorted(counts.collect(), key=lambda r: (-r["length"], r["part"]))  # parts plus max_tokens rows: ranges meet in few lengths
    before: dict[tuple[int, int], int] = {}
    total: dict[int, int] = defaultdict(int)
    for r in by_part:
        before[r["part"], r["length"]] = total[r["length"]]
        total[r["length"]] += r["n"]
    runs = np.array(best_fit(total, max_tokens) or np.empty((0, 5)), np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    plan = docs.sparkSession.sparkContext.broadcast((before, runs))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    @tidied
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, runs = plan.value
        stride = int(runs[:, 1].max(initial=0)) + 1
        keys = runs[:, 0] * stride + runs[:, 1]
        for b in batches:
            col = lambda n: b.column(b.schema.get_field_index(n))  # noqa: B023, E731
            length, part = col("length").to_numpy(), col("part").to_numpy()
            base = np.fromiter((before[p, x] for p, x in zip(part.tolist(), length.tolist(), strict=True)), np.int64, len(length))
            rank = base + col("idx").to_numpy()
            r = runs[np.searchsorted(keys, length * stride + np.minimum(rank, stride - 1), "right") - 1]
            yield pa.RecordBatch.from_arrays([*[col(n) for n in names], pa.array(r[:, 3] + rank - r[:, 1]), pa.array(r[:, 4])], names=[*names, "sequence_id", "offset"])

    return table.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)
