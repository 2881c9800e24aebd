"""Near-duplicates by 64-bit SimHash, searched with pivot distance tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, staged

BITS = 64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: bytes, width: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of one UTF-8 text; 0 when there is no word."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-width])).tolist()
        hashes = [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """One row (id, fp: long) for each row of docs. A null text counts as empty, and has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t or b"", width, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int) -> list[int]:
    """The 64 bits cut into runs whose lengths differ by one at most."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


#: Reference fingerprints (pivots) for each block, and blocks whose distances fit a long (4 bits each).
PIVOTS, IN_TABLE = 5, 3


def references(block: int, mask: int) -> list[int]:
    """The reference fingerprints of a block: 64 bits of the MD5 of their number, of which the block's are compared."""
    return [int.from_bytes(hashlib.md5(f"pivot {block}.{i}".encode()).digest()[:8], "big") & mask for i in range(PIVOTS)]


def distance_tables(fp: Column, blocks: int) -> list[Column]:
    """The pivot distance tables of a fingerprint: for each block its Hamming distances, within the block, to the
    block's references. Distances (15 at most) are packed by 4 bits, IN_TABLE blocks to a long."""
    tables = []
    for first in range(0, blocks, IN_TABLE):
        masks = block_masks(blocks)[first : first + IN_TABLE]
        cells = [F.bit_count(fp.bitwiseXOR(F.lit(signed(r))).bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(masks) for r in references(first + k, m)]
        tables.append(sum((F.shiftleft(c.cast("long"), 4 * i) for i, c in enumerate(cells)), F.lit(0).cast("long")))
    return tables


def cell_keys(blocks: int, distance: int) -> list[Column]:
    """One key for each choice of blocks - distance blocks: a hash of the table's cells of these blocks."""
    cell = lambda b: F.shiftright(f"table{b // IN_TABLE}", 4 * PIVOTS * (b % IN_TABLE)).bitwiseAND((1 << 4 * PIVOTS) - 1)
    return [F.xxhash64(F.lit(i), *(cell(b) for b in chosen)) for i, chosen in enumerate(combinations(range(blocks), blocks - distance))]


def coordinate_difference(blocks: int) -> Column:
    """The largest difference of coordinates in each block, summed over blocks: by the triangle inequality within each
    block at most the Hamming distance of the fingerprints of a and b."""

    def cell(side: str, b: int, i: int) -> Column:
        return F.shiftright(f"{side}.table{b // IN_TABLE}", 4 * (PIVOTS * (b % IN_TABLE) + i)).bitwiseAND(15)

    return sum((F.greatest(*(F.abs(cell("a", b, i) - cell("b", b, i)) for i in range(PIVOTS))) for b in range(1, blocks)), F.greatest(*(F.abs(cell("a", 0, i) - cell("b", 0, i)) for i in range(PIVOTS))))


def blocks_for(count: int, distance: int) -> int:
    """As many blocks as keep the expected meetings of unrelated fingerprints below about their number."""
    blocks = max(distance + 2, 5)
    while blocks < 16 and count > 2 ** (BITS * (blocks - distance) / blocks + 1):
        blocks += 1
    return blocks


def tabled(nodes: DataFrame, blocks: int, distance: int) -> DataFrame:
    """nodes (fp) with their distance tables, once for each cell key."""
    rows = nodes.select("fp", *(t.alias(f"table{i}") for i, t in enumerate(distance_tables(F.col("fp"), blocks))))
    return rows.select("*", F.explode(F.array(*cell_keys(blocks, distance))).alias("key"))


def survivors(keyed: DataFrame, blocks: int, distance: int) -> DataFrame:
    """Pairs a, b of rows of tabled() that share a cell and whose coordinate differences don't rule them out."""
    a, b = keyed.alias("a"), keyed.alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (coordinate_difference(blocks) <= distance))


def midpoints(distance: int) -> list[int]:
    """All 64-bit masks of at most distance / 2 bits."""
    return [signed(sum(1 << i for i in bits)) for n in range(distance // 2 + 1) for bits in combinations(range(BITS), n)]


def links(nodes: DataFrame, distance: int = 4, blocks: int | None = None, crowd: int = 4096, name: str = "simhash") -> DataFrame:
    """Pairs (src, dst) of different fingerprints of nodes (fp: long) at most `distance` (an even number) bits apart, such
    that all fingerprints so close are linked, directly or over others.

    The pivot distance tables are the index. The bits are cut into blocks, and a fingerprint has for each block a table of its
    Hamming distances there to reference fingerprints. `distance` bits touch as many blocks at most, so close fingerprints have
    equal cells in all other blocks, and meet under the hash of these; no close pair is lost. Of the pairs that meet, those whose
    coordinates differ by more than `distance` (the largest difference of each block, summed) can't be close and are
    discarded; the survivors are verified by their exact Hamming distance.

    A cell of more than `crowd` fingerprints would make too many pairs. The fingerprints of such cells are
    linked over midpoints instead: each is listed under every 64-bit value at most distance / 2 bits away, all
    that share a value are close, and each is linked to the least of them. Every close pair shares one, so this is exact too, and
    its work grows with the number of fingerprints, not of pairs.
    blocks: None takes blocks_for(); every choice gives the same links.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    blocks = blocks or blocks_for(nodes.count(), distance)
    keyed = tabled(nodes, blocks, distance)
    crowded = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("key"), f"{name}-crowded")
    dense = None
    if not crowded.isEmpty():
        dense = staged(keyed.join(crowded, "key", "left_semi").select("fp").distinct(), f"{name}-dense")
        keyed = keyed.join(crowded, "key", "left_anti")
    verified = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    found = survivors(keyed, blocks, distance).where(verified).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    if dense is not None:
        near = dense.select("fp", F.explode(F.transform(F.array(*map(F.lit, midpoints(distance))), lambda m: F.col("fp").bitwiseXOR(m))).alias("at"))
        leads = near.groupBy("at").agg(F.min("fp").alias("lead"), F.max("fp").alias("last")).where("lead < last").drop("last")
        found = found.union(near.join(leads, "at").where("lead < fp").select(F.col("lead").alias("src"), F.col("fp").alias("dst")))
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One row (doc_id, fp, component_id) for each row of docs: component_id is the smallest id reachable
    over links of at most `distance` bits, the document itself included.

    Equal fingerprints are one node, so copies never make pairs. Null texts count as empty. Rows of one
    id stay rows of their own. A null id stays null and is never chosen as a component's id unless a
    component holds no other. Very long texts are read whole. An empty table gives an empty result. Other columns of docs are not read.
    """
    fps = staged(fingerprints(docs, id_col, text_col, width), "simhash-fps")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), distance), "simhash")
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = staged(linked, "simhash-linked")
    ids = staged(linked.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-ids")
    labels = staged(linked.join(ids, "root").select("fp", "component_id"), "simhash-labels")
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")
