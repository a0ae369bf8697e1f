"""Toxicity: averaged subword embeddings and a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, plus, small_batches, texts, without
from .subwords import bags, plain

SIZES, BUCKETS, DIM = (3, 4, 5), 1 << 18, 4
#: The model is fitted on at most so many documents labelled 1, twice as many labelled 0, and so many characters in all.
TRAIN_ROWS, TRAIN_CHARS = 2000, 8_000_000
#: Share of the training texts that an n-gram has to be seen in.
MIN_SEEN = 0.006
#: The average is scaled before the softmax: a few words in hundreds decide.
GAIN = 300.0
CLEAN = 4.0
#: The average runs over so many words of zero vector besides the text's own, so that very short texts don't swing.
PAD = 50


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of all the ranges starts[i] .. starts[i]+counts[i]."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def fit(docs: list[str], labels: list[int], epochs: int = 12, batch: int = 64, rate: float = 0.15, g0: float = 1e-4, shrink: float = 1e-5, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight of each bucket in the logit, bias): embeddings and softmax folded together after joint training."""
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    ptr, word, weight = [0], [], []
    for t in docs:
        own = [vocab.setdefault(w, len(vocab)) for w in map(plain, t.split()) if w]
        w, n = np.unique(np.array(own, np.int64), return_counts=True)
        word.append(w)
        n = np.sqrt(n)  # a word repeated all through a text says little more than the word
        weight.append(n / (n.sum() + PAD))
        ptr.append(ptr[-1] + len(w))
    word, weight, ptr = np.concatenate(word or [np.zeros(0, np.int64)]), np.concatenate(weight or [np.zeros(0)]).astype(np.float32), np.array(ptr)
    ids, own = bags(list(vocab), SIZES, BUCKETS)
    size = np.bincount(own, minlength=len(vocab))
    # n-grams of too few training texts would learn those texts by heart: they keep a zero vector
    seen = np.bincount(ids, np.bincount(word, minlength=len(vocab))[own], BUCKETS)
    known = seen[ids] >= max(3, MIN_SEEN * len(docs))
    ids, kept = ids[known], np.bincount(own[known], minlength=len(vocab))
    first = np.cumsum(kept) - kept
    y = np.array(labels)
    emb = np.zeros((BUCKETS, DIM), np.float32)
    emb[ids] = (rng.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32)[ids]
    out = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
    bias = np.array([CLEAN / 2, -CLEAN / 2], np.float32)  # words are innocent until the labels speak against them
    g_emb, g_out, g_bias = np.full(BUCKETS, g0, np.float32), np.full_like(out, 1e-4), np.full_like(bias, 1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            n = ptr[rows + 1] - ptr[rows]
            occ = _ragged(ptr[rows], n)
            w = word[occ]
            flat = ids[_ragged(first[w], kept[w])]
            part = np.repeat(weight[occ] / np.maximum(size[w], 1), kept[w])
            doc = np.repeat(np.repeat(np.arange(len(rows)), n), kept[w])
            mean = np.stack([np.bincount(doc, part * emb[flat, d], len(rows)) for d in range(DIM)], 1).astype(np.float32) * GAIN
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            d_out, d_bias, d_mean = mean.T @ p, p.sum(0), (p @ out.T) * GAIN
            u, inv = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(inv, part * d_mean[doc, d], len(u)) for d in range(DIM)], 1).astype(np.float32)
            g_emb[u] += (grad**2).mean(1)
            step = (rate / np.sqrt(g_emb[u]))[:, None]
            e = emb[u] - step * grad
            norm = np.sqrt((e**2).sum(1, keepdims=True)) + 1e-9
            emb[u] = e * np.maximum(0, 1 - step * shrink / norm)  # n-grams that don't help fall back to zero
            g_out += d_out**2
            g_bias += d_bias**2
            out -= rate * d_out / np.sqrt(g_out)
            bias -= rate * d_bias / np.sqrt(g_bias)
    return (GAIN * (emb @ (out[:, 1] - out[:, 0]))).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """Scores texts; a word's mean over its buckets is remembered up to a bound."""

    LIMIT = 400_000

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}  # token -> number
        self.words: dict[str, int] = {}  # word -> number
        self.group = np.zeros(1 << 16, np.int64)  # token number -> word number, -1 if it is no word
        self.value = np.zeros(1 << 16)  # of each word

    def score(self, texts_: list[str]) -> np.ndarray:
        if len(self.at) > self.LIMIT:
            self._forget()
        tokens, bounds = [], [0]
        for t in texts_:
            tokens += t.split()
            bounds.append(len(tokens))
        new = [w for w in set(tokens) if w not in self.at]
        if new:
            self._add(new)
        word = self.group[np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))]
        doc = np.repeat(np.arange(len(texts_)), np.diff(bounds))
        pair, n = np.unique((doc << 32 | word)[word >= 0], return_counts=True)
        doc, n = pair >> 32, np.sqrt(n)
        z = np.bincount(doc, n * self.value[pair & 0xFFFFFFFF], len(texts_)) / (np.bincount(doc, n, len(texts_)) + PAD) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def _add(self, new: list[str]) -> None:
        words = [plain(w) for w in new]
        fresh = [w for w in dict.fromkeys(words) if w and w not in self.words]
        if fresh:
            ids, own = bags(fresh, SIZES, BUCKETS)
            self.value = _put(self.value, len(self.words), np.bincount(own, self.weights[ids], len(fresh)) / np.bincount(own, minlength=len(fresh)))
            self.words.update(zip(fresh, range(len(self.words), len(self.words) + len(fresh)), strict=True))
        self.group = _put(self.group, len(self.at), np.array([self.words[w] if w else -1 for w in words], np.int64))
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))


def _put(a: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
    if at + len(more) > len(a):
        a = np.concatenate([a[:at], np.zeros(at + len(more), a.dtype)])
    a[at : at + len(more)] = more
    return a


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> tuple[list[str], list[int]]:
    """At most rows texts labelled 1 and twice as many labelled 0, first in the order of a hash of their id, until chars
    are reached."""
    own = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for y in (0, 1):
        part = own.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows * (2 - y))
        picked = part if picked is None else picked.unionByName(part)
    # 3 * rows ids at most: the bound makes them fit for sending
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")
    got_texts, got_labels, seen = [], [], 0
    for r in found.toLocalIterator():
        if seen > chars:
            break
        seen += len(r["text"] or "")
        got_texts.append(r["text"] or "")
        got_labels.append(int(r["toxic"]))
    return got_texts, got_labels


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs and score, the probability of label 1, from the whole text alone. Null and empty texts, and texts without
    letter or digit, score as the bias alone. Repeated rows each get their score; an empty table gives an empty table. Other columns stay; one named score gives way."""
    small_batches(docs.sparkSession)
    docs = without(docs, ["score"])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for b in batches:
            own = texts(b)
            got = [scorer.score([t.decode() for t in own[i : i + 200]]) for i in range(0, len(own), 200)]
            yield appended(b, {"score": pa.array(np.concatenate(got) if got else np.zeros(0))})

    return docs.mapInArrow(run, plus(docs, "score double"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit(*training_rows(docs, labels.filter(~held)))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
