"""Near copies by the exact Jaccard similarity of word shingles, searched with SimHash and pivot distance tables and completed with banded MinHash keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import ROW, among, components, keyed, release, staged, without_rows

WIDTH = 5
BANDS, IN_BAND = 24, 5
MIX = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 13
#: Bits by which fingerprints that the pivot distance tables find differ at most.
DISTANCE = 4
#: Places of parity(), and rounds of links to a node drawn from each band.
PLACES, ROUNDS = 512, 3
_rng = np.random.default_rng(19)
XOR = _rng.integers(0, 1 << 32, BANDS * IN_BAND, np.uint64).astype(np.uint32)[:, None]
MUL = (_rng.integers(0, 1 << 31, BANDS * IN_BAND, np.uint64) * 2 + 1).astype(np.uint32)[:, None]


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct word shingles of a text in lower case; a text of fewer words is one shingle, a text of none has none."""
    words = text.lower().encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    own = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    count = len(words) - width + 1
    out = own[:count].copy()
    for i in range(1, width):
        out = (out * MIX) ^ own[i : count + i]
        out ^= out >> np.uint64(31)
    return np.unique(out * MIX)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of 64-bit hashes, as a signed number: a bit is 1 if set in over half of them. Long texts are read in chunks."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(np.int64)[0])


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key for each band of MinHash values. Long texts are read in chunks."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(XOR), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), CHUNK):
        least = np.minimum(least, ((low[None, at : at + CHUNK] ^ XOR) * MUL).min(axis=1))
    bands = least.reshape(BANDS, IN_BAND)
    return [xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(bands)]


def parity(hashes: np.ndarray) -> list[int]:
    """The places, of 512, on which an odd number of the hashes falls, as bits of eight numbers. Where two sets' bits differ, so do the sets, so the number of
    such bits is never more than that of the hashes which only one of both has."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % PLACES, minlength=PLACES).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).tolist()


def near_copies(docs: DataFrame, row_col: str, text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row (row, node, root) for each row of docs: rows of equal shingles have one node, and nodes linked by a
    Jaccard similarity of at least `similarity` over any number of steps have one root.

    Nodes have a SimHash of their shingles. Fingerprints at most `DISTANCE` bits apart are found by pivot distance tables (simhash.links: cells, coordinate differences,
    exact Hamming distance); each is compared with the least so near, and nodes of one fingerprint with its least. At a similarity of 0.8 about ten of 64 bits
    differ, so this finds the near copies with few edits. The others meet where all five values of one of 24 bands of MinHash values agree: two of similarity 0.8 miss each
    other with a chance of (1 - 0.8 ** 5) ** 24, below 1e-4, and more similar ones less often. Of
    those that meet either way the similarity is computed from their whole sets of shingles (64-bit hashes). In bands, nodes that the fingerprints left apart are
    compared, for `ROUNDS` rounds, with one drawn anew from each band that still has several components.
    What these links left apart in a band is compared where it shares a rare hash (prefix filter) and differs in few enough bits of parity (both
    exact), so neither a dense group of copies nor one of texts with a common part costs a comparison of all its pairs.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t or "") for t in batch.column(1).to_pylist()]
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            keys = pa.array([band_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            sizes, prints = pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, sizes, prints, keys], names=["row", "digest", "size", "fp", "keys"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([parity(s) for s in sets], pa.list_(pa.int64()))], names=["node", "hashes", "parity"])

    rows = docs.select(F.col(row_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    signed = staged(rows.mapInArrow(sign, "row long, digest binary, size long, fp long, keys array<long>"), "near-signed")
    nodes = staged(signed.groupBy("digest").agg(F.min("row").alias("node")), "near-nodes")
    lone = among(signed, "row", nodes.select("node")).withColumnRenamed("row", "node")

    def close(a: str, b: str):
        """Sets of these sizes can be similar enough."""
        return F.least(a, b) / F.greatest(a, b) >= similarity

    def few_apart(a: str, b: str, size_a: str, size_b: str):
        """Sets with these parities can be similar enough."""
        bits = sum(F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(PLACES // 64))
        return bits <= (F.col(size_a) + F.col(size_b)) * ((1 - similarity) / (1 + similarity)) + 1e-9

    def by_fingerprint() -> DataFrame:
        """Pairs of nodes of near fingerprints, at most two for each node."""
        heads = staged(lone.where("size > 0").groupBy("fp").agg(F.min(F.struct("node", "size")).alias("head")), "near-heads")
        nearest = staged(simhash.links(heads.select("fp"), DISTANCE, name="near-simhash").groupBy("dst").agg(F.min("src").alias("src")), "near-nearest")
        a, b = heads.toDF("src", "a"), heads.toDF("dst", "b")
        pairs = nearest.join(a, "src").join(b, "dst").select("a", "b")
        pairs = pairs.union(lone.join(heads, "fp").where(F.col("node") > F.col("head.node")).select("head", F.struct("node", "size")))
        pairs = pairs.where(close("a.size", "b.size")).select(F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst"))
        pairs = staged(pairs, "near-prints")
        release(heads, nearest)
        return pairs

    prints = by_fingerprint()
    placed = lone.select("node", "size", F.explode("keys").alias("key"))
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = staged(placed.join(shared, "key", "left_semi"), "near-members")
    asked = members.select("node").union(prints.select("src")).union(prints.select("dst"))
    sets = staged(among(rows, "row", asked).mapInArrow(hashed, "node long, hashes array<long>, parity array<long>"), "near-sets")
    made = [signed, nodes, prints, sets]

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs, "near-pairs")
        made.append(pairs)
        a, b = (among(sets.select("node", "hashes"), "node", pairs.select(c)).toDF(c, n) for c, n in (("src", "a"), ("dst", "b")))
        common = F.size(F.array_intersect("a", "b"))
        both = pairs.join(a, "src").join(b, "dst").select("src", "dst", common.alias("c"), (F.size("a") + F.size("b")).alias("s"))
        both = staged(both.where(F.col("c") / (F.col("s") - F.col("c")) >= similarity).select("src", "dst"), "near-links")
        made.append(both)
        return both

    def similar_after_parity(pairs: DataFrame) -> DataFrame:
        marks = sets.select("node", F.size("hashes").alias("size"), "parity")
        return similar(pairs.join(marks.toDF("src", "size_a", "pa"), "src").join(marks.toDF("dst", "size_b", "pb"), "dst").where(few_apart("pa", "pb", "size_a", "size_b")).select("src", "dst"))

    found = similar_after_parity(prints)
    for turn in range(ROUNDS + 1):
        roots = components(found, "near")
        apart = staged(members.select("key", "node", "size").join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root")), "near-apart")
        drawn = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "root", "size"))
        mixed = apart.groupBy("key").agg(drawn.alias("drawn"), (F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("key", "drawn")
        placed_all, apart = apart, staged(apart.join(mixed, "key"), "near-mixed")
        release(placed_all, roots, members)
        members = apart.select("key", "node", "size", "root", "drawn")  # bands of one component stay so
        if turn == ROUNDS:
            break
        src, dst = F.least("node", "drawn.node"), F.greatest("node", "drawn.node")
        asked = apart.where((F.col("root") != F.col("drawn.root")) & close("size", "drawn.size")).select(src.alias("src"), dst.alias("dst")).distinct()
        more = similar_after_parity(asked)
        if more.isEmpty():
            break
        found = found.union(more)
    # Sets of such similarity share one of their rarest hashes: of n hashes, ordered by how many nodes here have them, one of the first
    # n - ceil(similarity * n) + 1. Texts that have only a common part in common don't meet, however many they are.
    left = staged(apart.select("node", "root", "size").distinct(), "near-left")
    tokens = among(sets, "node", left.select("node")).select("node", F.explode("hashes").alias("hash"))
    often = tokens.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = Window.partitionBy("node")
    # Hashes of one node only come first in that order and meet nothing: they are counted, not ranked.
    rank = F.row_number().over(own.orderBy("n", "hash")) - F.count(F.lit(1)).over(own)
    rare = tokens.join(often, "hash").select("hash", "node", rank.alias("rank")).join(left, "node").withColumn("rank", F.col("rank") + F.col("size"))
    rare = rare.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1)
    rare = staged(rare.join(sets.select("node", "parity"), "node").select("hash", "node", "root", "size", "rank", "parity"), "near-rare")
    a, b = rare.toDF("hash", "src", "root_a", "size_a", "rank_a", "pa"), rare.toDF("hash", "dst", "root_b", "size_b", "rank_b", "pb")
    # The first hash that two sets share leaves no more in common than the shorter rest of both.
    reachable = 1 + F.least(F.col("size_a") - F.col("rank_a"), F.col("size_b") - F.col("rank_b"))
    enough = reachable >= (F.col("size_a") + F.col("size_b")) * (similarity / (1 + similarity)) - 1e-9
    last = a.join(b, "hash").where((F.col("src") < F.col("dst")) & (F.col("root_a") != F.col("root_b")) & close("size_a", "size_b") & enough & few_apart("pa", "pb", "size_a", "size_b"))
    found = found.union(similar(last.select("src", "dst").distinct()))
    release(apart, left, rare)
    roots = components(found, "near").withColumnRenamed("node", "_node")
    groups = staged(signed.select("row", "digest").join(nodes, "digest").join(roots, F.col("node") == F.col("_node"), "left").select("row", "node", F.coalesce("root", "node").alias("root")), "near-found")
    release(roots, *made)
    return groups


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row of docs for each group of near copies: that of least id, rows without an id last.

    Rows are told apart by a number of their own, so repeated ids, repeated rows and null ids are rows like all
    others. Null texts and texts without a word are copies of each other; very long texts are read whole. An empty table stays empty; other columns
    stay as they are.
    """
    docs = keyed(docs, "near-rows")
    found = near_copies(docs, ROW, text_col, similarity)
    ids = docs.select(F.col(ROW).alias("row"), F.col(id_col).alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    kept = found.join(ids, "row").groupBy("root").agg(F.min(order)["row"].alias("kept"))
    return without_rows(docs, found.join(kept, "root").where("row <> kept").select("row"), "near-gone")
