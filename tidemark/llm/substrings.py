"""Repeated passages: recurring phrases are confirmed, compiled to Aho-Corasick automata that locate them, and their windows compared exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, staged

WINDOW, PHRASE, LOCAL = 35, 8, 35
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def phrase_hashes(own: np.ndarray, phrase: int = PHRASE) -> np.ndarray:
    """A 64-bit hash of each run of `phrase` words."""
    out = own[: len(own) - phrase + 1].copy()
    for i in range(1, phrase):
        out = (out * SPREAD) ^ own[i : len(own) - phrase + 1 + i]
        out ^= out >> np.uint64(29)
    return out * SPREAD


def anchors(own: np.ndarray, local: int = LOCAL, phrase: int = PHRASE) -> np.ndarray:
    """The anchors of all runs of `local` words: the place of the phrase with the least hash (the first of
    equals), so that equal runs have equal anchors. Ascending."""
    hashes = phrase_hashes(own, phrase)
    span, n = local - phrase + 1, len(hashes)
    best = np.arange(n)
    size = 1
    while size < span:  # least of size places, doubled up to the span
        step = min(size, span - size)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(hashes[right] < hashes[left], right, left)
        size += step
    return np.unique(best)


def symbols(own: np.ndarray) -> str:
    """One character for each word: 16 bits of its hash, above all surrogates."""
    return ((own >> np.uint64(48)).astype("<u4") + 0x10000).tobytes().decode("utf-32-le")


def automaton(phrases: set[str]) -> ahocorasick.Automaton:
    """An automaton of phrases as symbols of their words."""
    out = ahocorasick.Automaton()
    for p in phrases:
        out.add_word(p, len(p))
    if phrases:
        out.make_automaton()
    return out


def located(text: str, found: ahocorasick.Automaton) -> np.ndarray:
    """The words at which a phrase of the automaton starts, every occurrence."""
    return np.array([end + 1 - n for end, n in found.iter(text)] if len(found) else [], np.int64)


def covering(n_words: int, places: np.ndarray, window: int, local: int, phrase: int) -> np.ndarray:
    """The starts of all windows in which each run of `local` words holds one of the phrases at places whole."""
    edges = np.zeros(n_words + 2, np.int64)
    np.add.at(edges, np.maximum(places - (local - phrase), 0), 1)
    np.add.at(edges, places + 1, -1)
    bare = np.concatenate(([0], np.cumsum(np.cumsum(edges)[: n_words - local + 1] == 0)))
    runs = window - local + 1
    return np.flatnonzero(bare[runs:] == bare[: len(bare) - runs]) if n_words >= window else np.zeros(0, np.int64)


BASES = [0x9FB21C651E98DF25, 0xA24BAED4963EE407]


def window_digests(own: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for each window: a 64-bit polynomial hash of its words' 64-bit hashes, and 32 bits of another of these mixed once more.
    (Of 10^12 different windows, two would agree with a chance of 1 in 100,000.)"""
    out = []
    for base in BASES:
        powers = np.multiply.accumulate(np.full(window, base, np.uint64))
        value = np.zeros(len(starts), np.uint64)
        for i in range(window):
            value += own[starts + i] * powers[i]
        out.append((value ^ (value >> np.uint64(32))).view(np.int64))
        own = (own ^ (own >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        own ^= own >> np.uint64(29)
    return out[0], (out[1] >> 32).astype(np.int32)


def removed_words(n_words: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words the windows at starts cover."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges[:-1]) > 0


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, local: int = LOCAL, phrase: int = PHRASE, batch_bytes: int = 1 << 20) -> DataFrame:
    """One row (doc_id, n_words, n_removed, kept_sha256) for each row of docs.

    A window is `window` consecutive words; the words of every window whose sequence of words also
    starts anywhere else (the same text included) count as removed, judged on the input.

    1. Each text gives the anchor phrases of its runs of LOCAL words (about one word in fifteen), by winnowing: equal
       runs choose equal phrases. A phrase goes as the symbols of its words, 16 bits of each word's hash. Rows with equal texts are put
       together by the digest of the text, and all their windows recur; one of them stands for the group from here on.
    2. Phrases met at two places or more are confirmed as recurring; the others are dropped.
    3. The confirmed phrases are dealt to the documents that can hold them, and for each batch of documents compiled to one
       automaton: a shard of the dictionary with all phrases that these documents can hold, so no document
       passes more than one shard and the shards' size is bounded by the batch's. All documents with a confirmed phrase stream
       through theirs, word by word, which finds every occurrence; nothing else tells where a phrase is. All runs in a recurring
       window hold a confirmed phrase; the windows that have one in each run are emitted under a 96-bit digest of their words.
    4. Digests met twice are recurring windows; their places go back to the documents.

    Common phrases and large groups are counted by partial aggregation, and their joins have both sides
    shuffled, so Spark splits a skewed one. Null texts have no words; very long texts are read whole, and
    are a batch of their own beyond `batch_bytes`. Repeated rows are repeated texts.
    A null id stays null. An empty table gives an empty result. Other columns of docs are not read.
    """

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, phrases, kept = [], [], []
            for text in batch.column(2).to_pylist():
                words = (text or b"").split()
                counts.append(len(words))
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
                phrases.append([])
                if len(words) >= window:
                    own = word_hashes(words)
                    symbol = (own >> np.uint64(48)).astype("<u2").tobytes()
                    phrases[-1] = [symbol[2 * p : 2 * (p + phrase)] for p in anchors(own, local, phrase).tolist()]
            arrays = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(phrases, pa.list_(pa.binary())), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "same", "n_words", "phrases", "kept"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("same"), F.col("text").cast("binary").alias("text"))
    surveyed = staged(source.mapInArrow(survey, "doc_id long, same binary, n_words long, phrases array<binary>, kept string"), "repeats-survey")

    groups = staged(surveyed.where(F.col("n_words") >= window).groupBy("same").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least")), "repeats-groups")
    first = surveyed.join(groups, "same").where(F.col("doc_id").eqNullSafe(F.col("least")))
    # A phrase is listed once for each of its places, so two places in one text count as well.
    marks = staged(first.select("same", F.explode("phrases").alias("phrase")), "repeats-marks")
    recurring = staged(marks.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("phrase"), "repeats-recurring")
    held = marks.join(recurring, "phrase").groupBy("same").agg(F.collect_set("phrase").alias("phrases"))
    asked = staged(held.withColumn("number", F.monotonically_increasing_id()), "repeats-asked")
    release(marks, recurring)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // batch_bytes
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                held = {p for own in part.column(2).to_pylist() for p in own}
                shard = automaton({(np.frombuffer(p, "<u2").astype("<u4") + 0x10000).tobytes().decode("utf-32-le") for p in held})
                numbers, starts, low, high = [], [], [], []
                for number, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = word_hashes(text.split())
                    hits = covering(len(own), located(symbols(own), shard), window, local, phrase)
                    d1, d2 = window_digests(own, hits, window)
                    numbers.append(np.full(len(hits), number, np.int64))
                    starts.append(hits.astype(np.int32))
                    low.append(d1)
                    high.append(d2)
                if numbers:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (low, high, numbers, starts)], names=["low", "high", "number", "start"])

    texts = source.join(asked, "same").join(groups.select(F.col("same").alias("_s"), "least"), F.col("same") == F.col("_s")).where(F.col("doc_id").eqNullSafe(F.col("least")))
    windows = staged(texts.select("number", "text", "phrases").mapInArrow(locate, "low long, high int, number long, start int"), "repeats-windows")
    twice = staged(windows.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("low", "high"), "repeats-twice")
    hits = windows.join(twice, ["low", "high"]).groupBy("number").agg(F.collect_set("start").alias("starts"))
    groups = groups.select("same", "copies", "least")
    hits = hits.join(asked.select("number", "same"), "number").join(groups, "same").where("copies = 1").select("same", "starts")
    hits = staged(hits, "repeats-hits")
    release(windows, twice)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, kept = [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                out = removed_words(len(words), np.array(starts, np.int64), window)
                gone.append(int(out.sum()))
                kept.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~out).tolist()])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(kept)], names=["same", "gone", "left"])

    partly = staged(source.join(hits, "same").select("same", "text", "starts").mapInArrow(strip, "same binary, gone long, left string"), "repeats-partly")
    whole = groups.where("copies > 1").select("same", F.lit(None).cast("long").alias("gone"), F.lit(hashlib.sha256(b"").hexdigest()).alias("left"))
    fate = staged(partly.unionByName(whole), "repeats-fate")
    out = surveyed.select("doc_id", "same", "n_words", "kept").join(fate.select(F.col("same").alias("_s"), "gone", "left"), F.col("same") == F.col("_s"), "left")
    removed = F.when(F.col("_s").isNull(), 0).otherwise(F.coalesce("gone", "n_words"))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), F.coalesce("left", "kept").alias("kept_sha256"))
