"""Packing token pieces into near-equal windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import staged


class Encoder:
    """Token ids of the vocabulary in the tokenizers file.

    The same vocabulary as ranks encodes several times faster; texts that hold a special token's string,
    which only the tokenizers file treats apart, go to the tokenizers library.
    """

    def __init__(self, vocabulary: str, ranks: str) -> None:
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.full = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Indices of sizes in `ways` parts of near-equal sums, by Karmarkar-Karp multiway differencing.

    Each item starts as a partial partition with one part filled. The two partial partitions of the
    largest spread are merged with opposing imbalances, the largest parts of one onto the smallest of
    the other, until one is left. A partial partition keeps only its parts that aren't empty, ascending.
    """
    if not sizes:
        return [[] for _ in range(ways)]
    # (−spread, tie, filled sums ascending, their items); parts not listed are empty.
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)] if ways > 1 else [(0, 0, [sum(sizes)], [list(range(len(sizes)))])]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, items_a = heapq.heappop(heap)
        _, _, b, items_b = heapq.heappop(heap)
        # a ascending after its empty parts, b descending before its empty parts.
        over = len(a) + len(b) - ways
        sums, items = list(a), list(items_a)
        b, items_b = b[::-1], items_b[::-1]
        if over <= 0:
            sums, items = sums + b, items + items_b
        else:
            # b's largest go to empty parts of a, the last `over` of b onto a's smallest.
            free = len(b) - over
            sums = [x + y for x, y in zip(a[:over], b[free:], strict=True)] + a[over:] + b[:free]
            items = [x + y for x, y in zip(items_a[:over], items_b[free:], strict=True)] + items_a[over:] + items_b[:free]
        order = sorted(range(len(sums)), key=sums.__getitem__)
        sums, items = [sums[k] for k in order], [items[k] for k in order]
        least = sums[0] if len(sums) == ways else 0
        heapq.heappush(heap, (least - sums[-1], tie, sums, items))
        tie += 1
    items = heap[0][3]
    return items + [[] for _ in range(ways - len(items))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest near-equal parts found with no sum over capacity: the count starts at the least that
    could hold all and rises whenever the capacity is exceeded. No size may be over capacity."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, ways)
        most = max(sum(sizes[i] for i in part) for part in parts)
        if most <= capacity:
            return [part for part in parts if part]
        ways += max(1, int(ways * (most / capacity - 1) / 4))


def pack(docs: DataFrame, capacity: int = 1024, piece: int = 256, batch: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then end_id. As many full windows of `capacity` ids as it holds are
    sequences of their own; the ids after them are cut into pieces of at most `piece` ids. Batches of about `batch` such
    pieces, dealt by a hash, are each packed by Karmarkar-Karp differencing, so packing is spread over as many
    tasks as the corpus needs, and the padding is a few ids for each window whatever its size. Texts are
    read once and never shuffled; ids aren't kept, only their checksums.

    Null texts are empty: the document is end_id alone. Repeated rows are documents of their own. A null id
    stays null. Very long texts are read whole. An empty table gives no piece. Other columns of docs are not read.
    vocabulary, ranks: files of the tokenizer, by default the public byte-level BPE with 50,257 ids.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary, ranks)
        row = sequence = TaskContext.get().partitionId() << 32
        for rows in batches:
            out = []
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                n, full, row = len(ids), len(ids) // capacity * capacity, row + 1
                cuts = [*range(0, full, capacity), *range(full, n, piece), n]
                view = memoryview(ids.view(np.uint8))
                for a, b in zip(cuts, cuts[1:], strict=False):
                    sequence += b - a == capacity
                    out.append((doc_id, a, b - a, zlib.crc32(view[4 * a : 4 * b]), n, row, sequence))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", "sequence"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = staged(rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long, sequence long"), "pack-pieces")
    loose = F.col("length") < capacity
    batches = max(1, -(-pieces.where(loose).count() // batch))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "row", "start"], ascending=[False, True, True], ignore_index=True)
        number, offset = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        sizes = part["length"].tolist()
        for k, items in enumerate(windows(sizes, capacity)):
            number[items] = k
            offset[items] = np.cumsum([0, *(sizes[i] for i in items[:-1])])
        return part.assign(sequence_id=part["batch"] * (1 << 20) + number, offset=offset)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    # Full windows are numbered within their task, above all numbers of packed windows.
    full = pieces.where(~loose).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(1 << 60) + F.col("sequence")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = pieces.where(loose).withColumn("batch", F.pmod(F.xxhash64("row", "start"), F.lit(batches)))
    packed = dealt.groupBy("batch").applyInPandas(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.unionByName(packed)
