"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, keyed, staged, without_rows

SHINGLE = 5
MIX = np.uint64(0x9E3779B97F4A7C15)
#: ASCII letters and digits stay, other ASCII characters part words, all other bytes belong to words.
WORD_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text. Case and ASCII punctuation don't count."""
    return np.array([xxhash.xxh64_intdigest(w) for w in text.lower().encode().translate(WORD_BYTES).split()], np.uint64)


def shingle_hashes(own: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the shingles of a sequence of word hashes, in order; none when it has fewer words."""
    if len(own) < shingle:
        return np.zeros(0, np.uint64)
    out = own[: len(own) - shingle + 1].copy()
    for i in range(1, shingle):
        out = (out * MIX) ^ own[i : len(own) - shingle + 1 + i]
        out ^= out >> np.uint64(31)
    return out * MIX


class Index:
    """MinHash signatures of test items, partitioned by size.

    An item of q distinct shingles is in the partition of the block length b, a power of two, with b < q <= 2 b (b = 1 for one shingle).
    A document is read in windows of three blocks, one block apart, so an item's passage of up to 2 b shingles lies whole in a
    window. Sizes of item and window then differ by a factor of 3 at most, whatever the document's
    length, and a containment of 0.8 means a Jaccard similarity of a quarter or more: the chance that none of 64 MinHash
    values agrees is below 0.75 ** 64, or 1e-8. An item of fewer words than a shingle is one shingle, its whole sequence of
    words, and is looked up by its hash among the shingles of that many words.
    """

    def __init__(self, items: list[tuple[int, str]], hashes: int = 64, shingle: int = SHINGLE) -> None:
        self.shingle = shingle
        rng = np.random.default_rng(11)
        self.xor = rng.integers(0, 1 << 32, hashes, np.uint64).astype(np.uint32)[:, None]
        self.mul = (rng.integers(0, 1 << 31, hashes, np.uint64) * 2 + 1).astype(np.uint32)[:, None]
        self.row = (np.arange(hashes, dtype=np.uint64) << np.uint64(32))[:, None]
        self.ids, self.sets = [], []
        parts: dict[int, list[int]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}  # by number of words: hash to item ids
        for item_id, text in items:
            words = word_hashes(text)
            own = np.unique(shingle_hashes(words, shingle))
            if 0 < len(words) < shingle:
                self.short.setdefault(len(words), {}).setdefault(int(shingle_hashes(words, len(words))[0]), []).append(item_id)
            elif len(own):
                parts.setdefault(1 << max(0, (len(own) - 1).bit_length() - 1), []).append(len(self.ids))
                self.ids.append(item_id)
                self.sets.append(own)
        self.parts = {}
        for block, members in sorted(parts.items()):
            keys = np.stack([(self.values(self.sets[m]).min(axis=1, keepdims=True) | self.row)[:, 0] for m in members], axis=1)
            owner = np.broadcast_to(np.array(members), keys.shape).ravel()
            order = np.argsort(keys, axis=None, kind="stable")
            self.parts[block] = (keys.ravel()[order], owner[order])

    def values(self, hashes: np.ndarray) -> np.ndarray:
        """MinHash values: one row for each hash function."""
        return (((hashes >> np.uint64(32)).astype(np.uint32)[None, :] ^ self.xor) * self.mul).astype(np.uint64)

    def candidates(self, stream: np.ndarray) -> np.ndarray:
        """Pairs (place, item): an item shares a MinHash value with the window of three blocks at a place of the stream."""
        found = []
        reach, step = 4 * max(self.parts), 1 << 15
        for at in range(0, len(stream), step):
            mins, size = self.values(stream[at : at + step + reach]).astype(np.uint32), 1
            for block, (keys, owner) in self.parts.items():
                while size < block:  # least of twice as many
                    if mins.shape[1] % 2:
                        mins = np.concatenate((mins, mins[:, -1:]), axis=1)
                    mins, size = np.minimum(mins[:, ::2], mins[:, 1::2]), 2 * size
                wide = mins.copy()
                wide[:, :-1] = np.minimum(wide[:, :-1], mins[:, 1:])
                wide[:, :-2] = np.minimum(wide[:, :-2], mins[:, 2:])
                asked = wide | self.row
                left = np.searchsorted(keys, asked)
                hit = np.nonzero(keys[np.minimum(left, len(keys) - 1)] == asked)
                if len(hit[0]):
                    first, last = left[hit], np.searchsorted(keys, asked[hit], "right")
                    places = np.repeat(at + hit[1] * block, last - first)
                    within = np.arange(len(places)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
                    items = owner[np.repeat(first, last - first) + within]
                    found.append(np.unique(np.stack((places, items, np.full(len(places), 3 * block)), axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def search(self, texts: list[str], containment: float) -> list[tuple[int, int, float]]:
        """(number of the text, item id, containment) for all items that a text holds."""
        words = [word_hashes(t) for t in texts]
        out = []
        for width, items in self.short.items():
            asked = np.array(sorted(items), np.uint64)
            for doc, own in enumerate(words):
                found = np.intersect1d(asked, shingle_hashes(own, width))
                out += [(doc, item, 1.0) for h in found.tolist() for item in items[h]]
        each = [shingle_hashes(w, self.shingle) for w in words]
        ends = np.cumsum([len(e) for e in each])
        if not self.parts or not len(ends) or not ends[-1]:
            return out
        pairs = set()
        for place, item, span in self.candidates(np.concatenate(each)).tolist():  # a window can reach over several texts
            pairs.update((doc, item) for doc in range(*np.searchsorted(ends, [place, place + span], "right") + [0, 1]) if doc < len(texts))
        doc_now, own = -1, None
        for doc, item in sorted(pairs):
            if doc != doc_now:
                doc_now, own = doc, np.unique(each[doc])
            share = float(np.isin(self.sets[item], own).mean())
            if share >= containment:
                out.append((doc, self.ids[item], share))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """Pairs (doc_id, item_id, containment) of documents that hold a test item: the share of the item's
    distinct five-word shingles that the document has is `containment` or more.

    The items are taken in blocks of about block_bytes of text, dealt by a hash (an item longer than that is in a block with few others). The
    index of a block is built once, broadcast (its size is bounded by the block's), and all documents stream past it once. With
    several blocks the pairs of each are staged, so neither the driver nor a task ever holds more than one block of a benchmark of any
    size, and documents are never shuffled. Very long documents are read whole, in windows. An item of fewer
    words than a shingle is found where its whole sequence of words is; one without a word, and null texts, match nothing. A null
    id stays null. Repeated rows give repeated pairs of
    documents; repeated items count once for each id. Empty tables give an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    items = staged(items.distinct(), "decontaminate-items")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def searched(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index.__new__(Index)  # only plain data is broadcast, so executors need no copy of this module
            vars(index).update(shared.value)
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    part = batch.slice(at, 128)
                    ids = part.column(0).to_pylist()
                    if found := index.search(part.column(1).to_pylist(), containment):
                        doc, item, share = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in doc], pa.int64()), pa.array(item, pa.int64()), pa.array(share, pa.float64())], names=["doc_id", "item_id", "containment"])

        return rows.mapInArrow(run, "doc_id long, item_id long, containment double")

    out = None
    for k in range(blocks):
        block = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").toLocalIterator()]
        shared = spark.sparkContext.broadcast(vars(Index(block)))
        found = searched(shared)
        if blocks > 1:
            found = staged(found, "decontaminate-pairs")
            shared.destroy()
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = 0.8, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a test item. Each row is decided by itself, whatever its id; repeated rows, and rows without an id, are
    rows like all others. Null and empty texts stay, very long ones are read whole. Empty tables drop nothing; other columns stay as they are."""
    docs = keyed(docs, "decontaminate-rows")
    found = contaminated(docs, benchmark, containment, ROW, text_col)
    return without_rows(docs, found.select("doc_id").distinct(), "decontaminate-gone")
