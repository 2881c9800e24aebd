"""Toxicity scores: subword-bag embeddings averaged into a linear layer, trained jointly in numpy."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII characters other than letters and digits part words.
WORD_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
BUCKETS, SIZES = 1 << 17, (3, 4, 5)


def words_of(text: str) -> list[str]:
    return text.lower().encode().translate(WORD_BYTES).decode(errors="replace").split()


def subwords(word: str) -> list[int]:
    """Buckets of the character n-grams (over UTF-8) of a word between its marks, and of the word itself."""
    marked = f"<{word}>".encode()
    own = [zlib.crc32(marked) % BUCKETS]
    for n in SIZES:
        own += [zlib.crc32(marked[i : i + n]) % BUCKETS for i in range(len(marked) - n + 1)]
    return own


class Model:
    """A word's vector is the average of the embeddings of its subwords, so misspellings share most of it; a
    linear layer on it gives the word's log-odds (a softmax over the two classes), and a text's log-odds
    are the log-sum-exp over its different words and a bias: one clear word marks a long text as well as a short one."""

    def __init__(self, size: int = 8, bias: float = -8.0, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.01, (BUCKETS, size))
        self.weights = rng.choice([-0.5, 0.5], size)
        self.bias = bias

    def fit(self, texts: list[str], labels: list[int], batch: int = 32, rate: float = 0.5, rarest: int = 2, seed: int = 6) -> "Model":
        """Embeddings and linear layer together, by Adagrad. Buckets of fewer than `rarest` texts don't learn."""
        vocabulary: dict[str, int] = {}
        docs = [np.unique(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64)) for t in texts]
        parts = [np.array(subwords(w), np.int64) for w in vocabulary]
        y = np.array(labels, np.float64)
        full = np.flatnonzero([len(d) for d in docs])
        held = np.zeros(BUCKETS, np.int64)
        for d in full:
            held[np.unique(np.concatenate([parts[w] for w in docs[d]]))] += 1
        counts = np.array([len(p) for p in parts])
        parts = [p[held[p] >= rarest] for p in parts]
        rng, size = np.random.default_rng(seed), len(self.weights)
        past, past_linear = np.full(self.embedding.shape, 1e-8), np.full(size, 1e-8)
        for _ in range(int(np.clip(20_000 // max(1, len(full)), 5, 20))):
            rng.shuffle(full)
            for at in range(0, len(full), batch):
                rows = full[at : at + batch]
                words, token = np.unique(np.concatenate([docs[r] for r in rows]), return_inverse=True)
                lengths = np.array([len(docs[r]) for r in rows])
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                row = np.repeat(np.arange(len(rows)), lengths)
                own = np.concatenate([parts[w] for w in words])
                word = np.repeat(np.arange(len(words)), [len(parts[w]) for w in words])
                touched, place = np.unique(own, return_inverse=True)
                embedded = self.embedding[touched][place]
                vectors = np.stack([np.bincount(word, embedded[:, k], len(words)) for k in range(size)], axis=1) / counts[words][:, None]
                odds = (vectors @ self.weights)[token]
                most = np.maximum.reduceat(odds, starts)
                share = np.exp(odds - most[row])
                total = np.add.reduceat(share, starts)
                p = 1 / (1 + np.exp(-(most + np.log(total) + self.bias)))
                wrong = (p - y[rows]) / len(rows)
                d_word = np.bincount(token, (wrong / total)[row] * share, len(words))
                d_linear = vectors.T @ d_word
                d_embedding = np.bincount(place, (d_word / counts[words])[word], len(touched))[:, None] * self.weights[None, :]
                past[touched] += d_embedding**2
                past_linear += d_linear**2
                self.embedding[touched] -= rate * d_embedding / np.sqrt(past[touched])
                self.weights -= 0.1 * rate * d_linear / np.sqrt(past_linear)
                self.bias -= 0.05 * wrong.sum()
        return self

    def bucket_odds(self) -> np.ndarray:
        """Log-odds of each bucket: the layer is linear, so it can be applied before the average."""
        return (self.embedding @ self.weights).astype(np.float32)


class Scorer:
    """Scores texts; remembers the odds of at most `memory` words."""

    def __init__(self, odds: np.ndarray, bias: float, memory: int = 400_000) -> None:
        self.odds, self.bias, self.memory, self.known = odds, bias, memory, {}

    def __call__(self, text: str) -> float:
        words = set(words_of(text))
        if not words:
            return 0.0
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.memory:
            self.known.clear()
            new = words
        if new:
            order = list(new)
            parts = [subwords(w) for w in order]
            sizes = np.array([len(p) for p in parts])
            flat = self.odds[np.fromiter((x for p in parts for x in p), np.int64, sizes.sum())]
            self.known.update(zip(order, np.exp(np.add.reduceat(flat, np.concatenate(([0], np.cumsum(sizes)[:-1]))) / sizes).tolist(), strict=True))
        total = math.fsum(map(self.known.__getitem__, words)) * math.exp(self.bias)
        return total / (1 + total)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from: CRC-32 of the id as text leaves 2 by 4."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000, most_bytes: int = 24 << 20, longest: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most most_labelled labelled rows that aren't held out (those whose ids have the least
    MD5; texts over `longest` bytes are left out of the fit, and one that would take the sum over most_bytes is passed over). Only
    text and label are used. Rows of one id all have its largest label."""
    marked = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = marked.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(most_labelled)
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") <= longest).join(chosen, "_id").select("_id", "text", "label")
    rows = found.orderBy(F.md5(F.col("_id").cast("string")), "_id", "text").limit(most_labelled)
    texts, targets, size = [], [], 0
    for row in rows.toLocalIterator():
        own = len(row.text.encode())
        if size + own <= most_bytes:
            size += own
            texts.append(row.text)
            targets.append(row.label)
    return Model().fit(texts, targets)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, held_out, score, predicted) for each row of docs.

    Null and empty texts, and texts without a word, have score 0. Very long texts are read whole. Repeated rows and
    equal texts have equal scores. A null id stays null and isn't held out. An empty table gives an empty
    result. Other columns of docs are not read.
    """
    odds, bias = model.bucket_odds(), float(model.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(odds, bias)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([scorer(t or "") for t in batch.column(2).to_pylist()], pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
