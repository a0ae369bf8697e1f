"""Language ID: a linear-chain conditional random field over the words of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, plus, small_batches, texts, tidied, without
from .subwords import bags

SIZES, BUCKETS = (1, 2, 3), 1 << 17
#: The field is fitted on at most so many documents of each language and so many characters of each language.
TRAIN_ROWS, TRAIN_CHARS = 600, 700_000
#: Training sequences and words in each; texts are cut into chains of so many words for scoring too.
SEQUENCES, CHAIN = 8000, 24
UNKNOWN = "und"
#: Texts are tagged in groups of so many rows and bytes, and new words get their emissions so many at a time.
GROUP_ROWS, GROUP_BYTES, NEW_WORDS = 200, 1 << 19, 4096


def letters(token: str) -> str:
    """A token's letters in lower case; empty if it has none."""
    return token.lower() if token.isalpha() else "".join(c for c in token.lower() if c.isalpha())


class Field:
    """Feature weights (affixes, n-grams and the word itself as lexicon entry, hashed), transitions and starts."""

    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels = labels
        self.weights = np.zeros((BUCKETS, n), np.float32)
        self.move, self.start = np.zeros((n, n), np.float32), np.zeros(n, np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        ids, own = bags(words, SIZES, BUCKETS)
        return np.stack([np.bincount(own, self.weights[ids, k], len(words)) for k in range(len(self.labels))], 1).astype(np.float32)

    def messages(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Forward and backward messages, factors and marginals of chains e (chain, place, label), padded behind."""
        b = np.exp(e - e.max(2, keepdims=True))
        a = np.exp(self.move - self.move.max())
        fore, back = np.empty_like(b), np.ones_like(b)
        fore[:, 0] = b[:, 0] * np.exp(self.start - self.start.max())
        for t in range(b.shape[1]):
            if t:
                fore[:, t] = (fore[:, t - 1] @ a) * b[:, t]
            fore[:, t] /= fore[:, t].sum(1, keepdims=True)
        for t in range(b.shape[1] - 2, -1, -1):
            m = (b[:, t + 1] * back[:, t + 1]) @ a.T
            back[:, t] = np.where((t + 1 < lengths)[:, None], m / m.sum(1, keepdims=True), 1)
        post = fore * back
        return fore, back, b, a, post / post.sum(2, keepdims=True)


def fit(samples: dict[str, list[str]], sequences: int = SEQUENCES, epochs: int = 4, batch: int = 200, rate: float = 0.3, seed: int = 5) -> Field:
    """Learn a field from texts of each language. Training chains are spliced from one to three texts, so that the
    transitions see switches of language as well as runs of it."""
    rng = np.random.default_rng(seed)
    labels = sorted(samples)
    field, vocab = Field(labels), {}
    runs: list[list[np.ndarray]] = []
    for lab in labels:
        words = (np.array([vocab.setdefault(w, len(vocab)) for w in map(letters, t.split()) if w], np.int64) for t in samples[lab])
        runs.append([w for w in words if len(w)])
    usable = [i for i, r in enumerate(runs) if r]
    if not usable:
        return field
    x, y = np.zeros((sequences, CHAIN), np.int64), np.zeros((sequences, CHAIN), np.int64)
    for s in range(sequences):
        cuts = sorted(rng.integers(1, CHAIN, rng.integers(0, 3)).tolist())
        for lo, hi in zip([0, *cuts], [*cuts, CHAIN], strict=True):
            k = usable[rng.integers(len(usable))]
            own = runs[k][rng.integers(len(runs[k]))]
            at = rng.integers(len(own))
            x[s, lo:hi], y[s, lo:hi] = own[(at + np.arange(hi - lo)) % len(own)], k
    ids, own = bags(list(vocab), SIZES, BUCKETS)
    size = np.bincount(own, minlength=len(vocab))
    first, n = np.cumsum(size) - size, len(labels)
    g_w, g_m, g_s = np.full(BUCKETS, 1e-2, np.float32), np.full((n, n), 1.0, np.float32), np.full(n, 1.0, np.float32)
    full = np.full(batch, CHAIN)
    for _ in range(epochs):
        order = rng.permutation(sequences)
        for at in range(0, sequences - batch + 1, batch):
            rows = order[at : at + batch]
            words, inv = np.unique(x[rows], return_inverse=True)
            ends = np.cumsum(size[words])
            flat = ids[np.arange(ends[-1]) - np.repeat(ends - size[words], size[words]) + np.repeat(first[words], size[words])]
            of = np.repeat(np.arange(len(words)), size[words])
            e = np.stack([np.bincount(of, field.weights[flat, k], len(words)) for k in range(n)], 1).astype(np.float32)[inv.reshape(batch, CHAIN)]
            fore, back, b, a, post = field.messages(e, full)
            gold = np.eye(n, dtype=np.float32)[y[rows]]
            d = (post - gold).reshape(-1, n)
            d_word = np.stack([np.bincount(inv.ravel(), d[:, k], len(words)) for k in range(n)], 1)
            pair = np.einsum("ctj,ctk,jk->ctjk", fore[:, :-1], b[:, 1:] * back[:, 1:], a)
            pair /= pair.sum((2, 3), keepdims=True)
            d_m = pair.sum((0, 1)) - np.einsum("ctj,ctk->jk", gold[:, :-1], gold[:, 1:])
            d_s = (post[:, 0] - gold[:, 0]).sum(0)
            u, back_u = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(back_u, d_word[of, k], len(u)) for k in range(n)], 1).astype(np.float32) + 1e-3 * field.weights[u]
            g_w[u] += (g**2).mean(1)
            field.weights[u] -= rate * g / np.sqrt(g_w[u])[:, None]
            g_m += d_m**2
            g_s += d_s**2
            field.move -= rate * d_m / np.sqrt(g_m)
            field.start -= rate * d_s / np.sqrt(g_s)
    return field


class Tagger:
    """Predicts texts with a field; the emissions of a word are remembered up to a bound."""

    LIMIT = 100_000

    def __init__(self, field: Field):
        self.field = field
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.top, self.rows = 0, np.zeros((1 << 16, len(self.field.labels)), np.float32)

    def _numbers(self, tokens: list[str]) -> np.ndarray:
        """Row of each token's emissions; -1 for tokens without a letter."""
        new = [t for t in set(tokens) if t not in self.at]
        if new:
            words = [letters(t) for t in new]
            real = [w for w in words if w]
            base = self.top
            if base + len(real) > len(self.rows):
                self.rows = np.concatenate([self.rows[:base], np.zeros((base + len(real), self.rows.shape[1]), np.float32)])
            for i in range(0, len(real), NEW_WORDS):
                some = real[i : i + NEW_WORDS]
                self.rows[base + i : base + i + len(some)] = self.field.emissions(some)
            numbers = iter(range(base, base + len(real)))
            self.at.update((t, next(numbers) if w else -1) for t, w in zip(new, words, strict=True))
            self.top = base + len(real)
        return np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))

    def shares(self, docs: list[str]) -> np.ndarray:
        """Mean posterior of each label over a text's words, and in the last column of each word's best; NaN without words."""
        if len(self.at) > self.LIMIT:
            self._forget()
        tokens, bounds = [], [0]
        for t in docs:
            tokens += t.split()
            bounds.append(len(tokens))
        row = self._numbers(tokens)
        doc = np.repeat(np.arange(len(docs)), np.diff(bounds))[row >= 0]
        row = row[row >= 0]
        n = np.bincount(doc, minlength=len(docs))
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        chain = np.cumsum(place % CHAIN == 0) - 1
        k = len(self.field.labels)
        out = np.full((len(docs), k + 1), np.nan)
        if not len(row):
            return out
        e = np.zeros((chain[-1] + 1, CHAIN, k), np.float32)
        e[chain, place % CHAIN] = self.rows[row]
        post = self.field.messages(e, np.bincount(chain))[-1][chain, place % CHAIN]
        total = np.stack([np.bincount(doc, p, len(docs)) for p in (*post.T, post.max(1))], 1)
        return np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], np.nan)


def grouped(docs: list[bytes]) -> Iterator[list[str]]:
    """Texts, decoded, in groups of at most GROUP_ROWS rows and GROUP_BYTES bytes; a longer text is a group of its own."""
    group, size = [], 0
    for t in docs:
        if group and (len(group) == GROUP_ROWS or size + len(t) > GROUP_BYTES):
            yield group
            group, size = [], 0
        group.append(t.decode())
        size += len(t)
    if group:
        yield group


def training_samples(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> dict[str, list[str]]:
    """lang -> at most rows texts, first in the order of a hash of their id, up to chars characters."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    langs = [r["lang"] for r in known.select("lang").distinct().orderBy("lang").collect()]
    picked = None
    for lang in langs:
        part = known.filter(F.col("lang") == lang).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    out: dict[str, list[str]] = {lang: [] for lang in langs}
    if picked is None:
        return out
    # rows ids of each language at most: the bound makes them fit for sending
    got = known.select("doc_id", "lang", "text").join(F.broadcast(picked.distinct()), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    size = dict.fromkeys(langs, 0)
    for r in got.toLocalIterator():
        if size[r["lang"]] < chars and len(out[r["lang"]]) < rows:
            size[r["lang"]] += len(r["text"])
            out[r["lang"]].append(r["text"])
    return out


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """docs with lang_pred, score and sure. The label with most posterior mass over all words of the whole text wins, ties
    going to the first in order; the score is its share, and sure the mean of each word's best, whatever its label: high
    in a text of several languages, each of them plain. Null texts and texts without a letter give 'und', 0 and 0; so
    does a field without labels. Repeated rows each get their language; an empty table gives an empty table. Chains begin anew
    every CHAIN words. Other columns stay; those named lang_pred, score or sure give way."""
    small_batches(docs.sparkSession)
    docs = without(docs, ["lang_pred", "score", "sure"])
    sent = docs.sparkSession.sparkContext.broadcast(field)  # BUCKETS floats a language

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(sent.value)
        labels = [*tagger.field.labels, UNKNOWN]
        for b in batches:
            got = [tagger.shares(own) for own in grouped(texts(b))] if labels[0] != UNKNOWN else []
            share = np.concatenate(got) if got else np.full((len(b), 2), np.nan)
            none = np.isnan(share[:, 0])
            share, sure = share[:, :-1], np.where(none, 0, np.nan_to_num(share[:, -1])).clip(0, 1).astype(np.float64)
            best = np.where(none, len(labels) - 1, np.nan_to_num(share).argmax(1))
            score = np.where(none, 0, np.nan_to_num(share).max(1)).clip(0, 1).astype(np.float64)
            yield appended(b, {"lang_pred": pa.array([labels[i] for i in best], pa.string()), "score": pa.array(score), "sure": pa.array(sure)})

    return docs.mapInArrow(run, plus(docs, "lang_pred string, score double, sure double"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    field = fit(training_samples(docs.filter(~held)))
    found = identify(docs.select("doc_id", "text"), field)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
