"""SentencePiece encoding by suffix-array matching, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, plus, small_batches, texts, without

SPACE = "▁"
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_START, _BYTES = -1, -2


class Vocabulary:
    """Pieces of a SentencePiece BPE model, as keys for a suffix array. Four characters fill a 64-bit word."""

    _made: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.sp, n = sp, sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in normal}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.n = n
        #: A model that only marks spaces; any other goes through its own normaliser.
        self.plain = sp.normalize(" a  b \nÅ") == f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}\nÅ"
        #: No piece reaches over a space mark that follows another character: words are encoded apart.
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        letters = sorted(set("".join(self.id)))
        if len(letters) > 65_000:
            raise ValueError("the pieces have too many different characters")
        self.code = np.full(0x110000, len(letters) + 1, np.uint16)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.split_lines = "\n" not in letters
        self.ids = np.array(normal)
        self.length = np.array([len(self.piece[i]) for i in normal])
        self.width = -(-int(self.length.max()) // 4)
        low = np.zeros((len(normal), self.width * 4), np.uint16)
        for r, i in enumerate(normal):
            low[r, : len(self.piece[i])] = self.code[[ord(c) for c in self.piece[i]]]
        high = np.where(np.arange(self.width * 4) < self.length[:, None], low, 0xFFFF).astype(np.uint16)
        self.low, self.high = (_pack(x.reshape(len(normal), self.width, 4)) for x in (low, high))
        self.pairs: dict[int, bool] = {}
        self.decoded = [b""] * n
        for i, p in self.piece.items():
            self.decoded[i] = p.encode()
        for b, i in enumerate(self.byte):
            self.decoded[i] = bytes([b])
        self.decoded[sp.unk_id()] = " ⁇ ".encode()

    @classmethod
    def at(cls, path: str) -> Vocabulary:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def alone(self, left: str, right: str) -> bool:
        """Whether merging left + right by score, leftmost first, ends in exactly these two (or in right, if left is empty)."""
        sym, score = list(left + right), self.score
        while len(sym) > 1:
            best, at = None, -1
            for i in range(len(sym) - 1):
                s = score.get(sym[i] + sym[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            sym[at : at + 2] = [sym[at] + sym[at + 1]]
            if left and len("".join(sym[:at])) < len(left) < len("".join(sym[: at + 1])):
                return False
        return sym == ([left, right] if left else [right])

    def fits(self, prev: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Whether piece now can follow prev: two pieces stand side by side in an encoding if and only if their own text
        is encoded as these two."""
        keys, inv = np.unique((prev + 2) * self.n + now, return_inverse=True)
        out = np.empty(len(keys), bool)
        pairs = self.pairs
        if len(pairs) > 3_000_000:
            pairs.clear()
        for j, k in enumerate(keys.tolist()):
            ok = pairs.get(k)
            if ok is None:
                a, b = k // self.n - 2, k % self.n
                ok = pairs[k] = self.alone("" if a < 0 else self.piece[a], self.piece[b])
            out[j] = ok
        return out[inv]


def _pack(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint64)
    return c[..., 0] << np.uint64(48) | c[..., 1] << np.uint64(32) | c[..., 2] << np.uint64(16) | c[..., 3]


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, whether key a is before key b."""
    out, same = np.zeros(len(a), bool), np.ones(len(a), bool)
    for j in range(a.shape[1]):
        out |= same & (a[:, j] < b[:, j])
        same &= a[:, j] == b[:, j]
    return out


def occurrences(v: Vocabulary, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, id) of every occurrence of every piece: suffixes are sorted by as many characters as the
    longest piece has, then all pieces are searched for their range of suffixes at once."""
    padded = np.concatenate([code, np.zeros(v.width * 4 + 4, np.uint16)])
    four = _pack(np.lib.stride_tricks.sliding_window_view(padded, 4))
    keys = np.stack([four[4 * j : 4 * j + len(code)] for j in range(v.width)], 1)
    array = np.lexsort(keys.T[::-1])
    bounds = []
    for want, after in ((v.low, False), (v.high, True)):
        lo, hi = np.zeros(len(want), np.int64), np.full(len(want), len(code))
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            k = keys[array[np.minimum(mid, len(code) - 1)]]
            right = ~_less(want, k) if after else _less(k, want)
            lo, hi = np.where(open_ & right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
        bounds.append(lo)
    n = bounds[1] - bounds[0]
    at = array[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[0], n)]
    return at, np.repeat(v.length, n), np.repeat(v.ids, n)


def encode_words(v: Vocabulary, words: list[str]) -> list[bytes]:
    """Ids of each word (with its space marks) as little-endian 32-bit numbers."""
    if not words:
        return []
    size = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    base = np.cumsum(size + 1) - size - 1
    code = v.code[chars]
    ends = base + size
    code[ends] = 0
    at, length, piece = occurrences(v, code)
    offset = np.arange(len(chars)) - np.repeat(base, size + 1)
    covered = np.zeros(len(chars), bool)
    covered[at[length == 1]] = True
    lone = np.nonzero(~covered & (code > 0))[0]  # characters that are no piece go to bytes
    at, length = np.concatenate([at, lone]), np.concatenate([length, np.ones(len(lone), np.int64)])
    piece = np.concatenate([piece, np.full(len(lone), _BYTES)])
    step = offset[at] + length
    order = np.argsort(step, kind="stable")  # edges by the place where they end
    at, length, piece, step = at[order], length[order], piece[order], step[order]
    last, back = np.full(len(chars), -3), np.zeros(len(chars), np.int64)
    last[base] = _START
    cuts = np.searchsorted(step, np.arange(1, int(step.max(initial=0)) + 2))
    for lo, hi in zip(cuts, cuts[1:], strict=False):  # relax: exactly one edge into each place agrees with what precedes
        a, p = at[lo:hi], piece[lo:hi]
        prev = last[a]
        ok = (p == _BYTES) & (prev > -3)
        real = (p >= 0) & (prev > -3)
        ok[real] = v.fits(prev[real], p[real])
        e = a[ok] + length[lo:hi][ok]
        last[e], back[e] = p[ok], a[ok]
    steps, own, now, row = [], [], ends.copy(), np.arange(len(words))
    while len(row):  # walk all words back at once
        going = now > base[row]
        now, row = now[going], row[going]
        if len(row):
            steps.append(now)
            own.append(row)
            now = back[now]
    if not steps:
        return [b""] * len(words)
    depth = np.repeat(np.arange(len(steps)), [len(s) for s in steps])
    place, own = np.concatenate(steps), np.concatenate(own)
    order = np.lexsort((-depth, own))
    place, own = place[order], own[order]
    ids = last[place]
    if (ids == -3).any():
        raise AssertionError("a place was not reached")
    out: list[bytes] = []
    bounds = np.searchsorted(own, np.arange(len(words) + 1))
    odd = set(own[ids == _BYTES].tolist())
    raw = ids.astype("<u4").tobytes()
    for w in range(len(words)):
        lo, hi = bounds[w], bounds[w + 1]
        if w not in odd:
            out.append(raw[4 * lo : 4 * hi])
        else:
            flat: list[int] = []
            for p, i in zip(place[lo:hi].tolist(), ids[lo:hi].tolist(), strict=True):
                flat += [v.byte[b] for b in chr(chars[p - 1]).encode("utf-8", "replace")] if i == _BYTES else [i]
            out.append(np.array(flat, "<u4").tobytes())
    return out


class Encoder:
    """Encodes texts; a word of the batch text is indexed once, and remembered up to a bound."""

    LIMIT, LONG = 300_000, 64

    def __init__(self, path: str):
        self.v = Vocabulary.at(path)
        self.seen: dict[str, bytes] = {}
        self.line = np.array([self.v.byte[10]], "<u4").tobytes()

    def words(self, text: str) -> list[list[str]]:
        """The text's lines as words; a line feed that is no part of any piece stands between them."""
        if not text:
            return []
        v = self.v
        marked = SPACE + text.replace(" ", SPACE) if v.plain else v.sp.normalize(text)
        lines = marked.split("\n") if v.split_lines else [marked]
        if not v.by_word:
            return [[x] if x else [] for x in lines]
        if v.plain and "  " not in text and SPACE not in text and text[0] != " ":
            return [([SPACE + w for w in x[1:].split(SPACE)] if x[0] == SPACE else [x.split(SPACE, 1)[0], *[SPACE + w for w in x.split(SPACE)[1:]]]) if x else [] for x in lines]
        return [_WORDS.findall(x) for x in lines]

    def encode(self, batch: list[str]) -> list[bytes]:
        split = [self.words(t) for t in batch]
        if len(self.seen) > self.LIMIT:
            self.seen.clear()
        new = list({w for lines in split for x in lines for w in x if w not in self.seen})
        got = dict(zip(new, encode_words(self.v, new), strict=True))
        self.seen.update((k, x) for k, x in got.items() if len(k) <= self.LONG)
        get = self.seen.get
        return [self.line.join([b"".join([x if (x := get(w)) is not None else got[w] for w in line]) for line in lines]) for lines in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids: space marks become spaces, the leading one goes, bytes that aren't UTF-8 become U+FFFD."""
        table = self.v.decoded
        text = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """docs and piece_ids, the model's BPE ids of the whole text as little-endian 32-bit numbers. Null and empty texts
    have no ids. Other columns stay; one named piece_ids gives way."""
    small_batches(docs.sparkSession)
    docs = without(docs, ["piece_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(model_path)
        for b in batches:
            own = [t.decode() for t in texts(b)]
            ids = [x for i in range(0, len(own), 400) for x in enc.encode(own[i : i + 400])]
            yield appended(b, {"piece_ids": pa.array(ids, pa.binary())})

    return docs.mapInArrow(run, plus(docs, "piece_ids binary"))


def decode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """docs and decoded, the text of piece_ids; null ids give ''. Other columns stay; one named decoded gives way. A text
    comes back as it was, except that a literal U+2581 comes back as a space."""
    small_batches(docs.sparkSession)
    docs = without(docs, ["decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(model_path)
        for b in batches:
            ids = b.column(b.schema.get_field_index("piece_ids")).to_pylist()
            yield appended(b, {"decoded": pa.array([enc.decode(x or b"") for x in ids], pa.string())})

    return docs.mapInArrow(run, plus(docs, "decoded string"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256 and whether decoding gave the text back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decode_pieces(encode_pieces(docs, path), path)
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return both.select("doc_id", (F.length("piece_ids") / 4).cast("long").alias("n_ids"), F.crc32("piece_ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


