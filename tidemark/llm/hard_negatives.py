"""Hard negatives by exact integer scores from the tables of the Four Russians."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, numbered, release, small_batches, staged, staged_parts

GROUP = 8  # dimensions a table covers: one byte of a bit plane


def finite(vector: str, dims: int) -> Column:
    """Whether a vector has dims components, all of them finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) == dims) & F.coalesce(good, F.lit(False))


def bit_planes(vectors: np.ndarray, planes: int) -> np.ndarray:
    """(n, planes * groups) bytes: bit p of the components' two's complement, eight dimensions a byte, lowest plane first."""
    n, dims = vectors.shape
    padded = np.zeros((n, -(-dims // GROUP) * GROUP), np.int64)
    padded[:, :dims] = vectors
    return np.concatenate([np.packbits((padded >> p & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(planes)] or [np.zeros((n, 0), np.uint8)], axis=1)


def from_planes(packed: np.ndarray, planes: int) -> np.ndarray:
    """The vectors of bit_planes(), with zeros up to whole groups."""
    bits = np.unpackbits(packed.reshape(len(packed), planes, -1), axis=2, bitorder="little").astype(np.int64)
    weights = np.array([1 << p for p in range(planes - 1)] + [-(1 << planes - 1)], np.int64)
    return np.einsum("npd,p->nd", bits, weights)


def subset_sums(vectors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, n): for each group of eight components and each subset of them, written as a byte, the subset's sum in each vector."""
    n, dims = vectors.shape
    columns = vectors.T.reshape(dims // GROUP, GROUP, n).astype(kind)
    tables = np.zeros((dims // GROUP, 1, n), kind)
    for k in range(GROUP):
        tables = np.concatenate([tables, tables + columns[:, k : k + 1]], axis=1)
    return tables


def scores(tables: np.ndarray, packed: np.ndarray, planes: int, step: int = 128) -> np.ndarray:
    """(rows, n) inner products: for each plane, from the sign's down, what is there is doubled and the planes' bytes are looked up; `step` rows
    at a time, which stay in the processor's cache."""
    groups, _, n = tables.shape
    by_plane = packed.reshape(len(packed), planes, groups)
    out, found = np.zeros((len(packed), n), tables.dtype), np.empty((step, n), tables.dtype)
    for start in range(0, len(packed), step):
        total, here = out[start : start + step], by_plane[start : start + step]
        looked = found[: len(here)]
        for p in range(planes - 1, -1, -1):
            total += total
            for g in range(groups):
                np.take(tables[g], here[:, p, g], axis=0, out=looked, mode="clip")
                if p == planes - 1:
                    total -= looked
                else:
                    total += looked
    return out


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches in tables of about `rows` rows."""
    held: list[pa.RecordBatch] = []
    for part in batches:
        held.append(part)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def best(score: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Of the places `at`, those of the `most` highest scores, the earliest of equals, in that order."""
    if len(at) > most:
        least = np.partition(score[at], len(at) - most)[len(at) - most]
        above, equal = at[score[at] > least], at[score[at] == least]
        at = np.concatenate([above, equal[: most - len(above)]])
    return at[np.lexsort((at, -score[at]))]


def merged(old: tuple | None, new: tuple, most: int) -> tuple:
    """The best of two sets of (score, vec_id, row), ties by vec_id (none last), then row."""
    score, vec, row = (np.concatenate([a, b]) for a, b in zip(old, new, strict=True)) if old else new
    order = np.lexsort((row, np.where(vec == NO_ID, np.iinfo(np.int64).max, vec), vec == NO_ID, -score))[:most]
    return score[order], vec[order], row[order]


NO_ID = np.iinfo(np.int64).min  # stands for a null vec_id within tasks


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, noise: int = 7, labels: int = 10, block: int = 1024, chunk: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each hard negative.

    Components are floor(scale * x); a score is the integer inner product with the anchor; anchors are the rows whose id is divisible by `every`. An anchor's
    positives are its first `positives` other rows of its label; for each, the first `negatives` rows of other labels whose score is from `low` to `high` percent of the positive's.
    Where the id is divisible by `noise` the label first becomes (label + 1) % labels. noise=0: labels stay.

    Rows are packed once into bit planes. Anchors come in blocks of `block` (a bound on what is broadcast: block * bytes of planes), and each block scores all rows in
    place, twice: for the positives, then, with their scores, for the negatives. A task holds the block's tables of subset sums and the best rows so far
    of each anchor, whatever the number of rows; rows are never shuffled, and nothing is left out, since all scores are exact.

    Rows with a null label or vector, or a component that is null or not finite, take no part; nor does a vector shorter than the longest, whose missing
    components count as null. A null id is no anchor; it can be a negative or positive, after all ids of its score. Repeated rows are rows of
    their own, ties between equal ids go by the row. An anchor without positives, or a positive without negatives, has no row. An empty table gives an empty result. Other
    columns aren't read. Components so large that a score wouldn't fit 64 bits raise an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("long").alias("label"))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    rows = rows.where(F.col("label").isNotNull() & finite("v", dims))
    if noise:
        rows = rows.withColumn("label", F.when(F.col("vec_id") % noise == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    size = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(F.floor(x * scale).cast("double")))))).first()[0] or 0
    if 2 * max(dims, 1) * (size + 1) ** 2 >= 2**63:
        raise ValueError(f"scores of {dims} components up to {size:g} don't fit 64 bits")
    planes, kind = max(1, int(size).bit_length() + 1), np.int32 if 2 * max(dims, 1) * (size + 1) ** 2 < 2**31 else np.int64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims)
            packed = bit_planes(np.floor(v * scale).astype(np.int64), planes)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([b.tobytes() for b in packed], pa.binary())], names=["vec_id", "label", "planes"])

    packed = rows.mapInArrow(pack, "vec_id long, label long, planes binary").withColumn(ROW, F.monotonically_increasing_id())
    small_batches(spark)
    packed = staged(packed, "negatives-rows")
    anchors = staged(numbered(packed.where(F.col("vec_id") % every == 0), ["vec_id", ROW], "negatives-anchors"), "negatives-numbered")

    def scan(wanted: list, first: bool):  # noqa: ANN202
        """A pass over all rows for one block of anchors: their positives, or for each positive its negatives."""
        sent = spark.sparkContext.broadcast(wanted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, kept = sent.value, {}
            ids, marks = np.array([a[0] for a in own]), np.array([a[1] for a in own])
            tables = subset_sums(from_planes(np.frombuffer(b"".join(a[2] for a in own), np.uint8).reshape(len(own), -1), planes), kind) if dims else np.zeros((1, 256, len(own)), kind)
            bands = [(a, k, -(-low * s // 100), high * s // 100) for a, x in enumerate(own) for k, s in enumerate(x[3])] if not first else []
            for part in gathered(batches, chunk):
                vec = part["vec_id"].fill_null(int(NO_ID)).to_numpy()
                order = np.lexsort((part[ROW].to_numpy(), vec, vec == NO_ID))
                vec, label, row = vec[order], part["label"].to_numpy()[order], part[ROW].to_numpy()[order]
                bits = np.frombuffer(b"".join(part["planes"].to_pylist()), np.uint8).reshape(len(order), -1)[order] if dims else np.zeros((len(order), planes), np.uint8)
                s = np.ascontiguousarray(scores(tables, bits, planes).T)
                same = marks[:, None] == label[None, :]
                if first:
                    use = same & (ids[:, None] != row[None, :])
                    for a in np.flatnonzero(use.any(1)).tolist():
                        at = best(s[a], np.flatnonzero(use[a]), positives)
                        kept[a, 0] = merged(kept.get((a, 0)), (s[a][at], vec[at], row[at]), positives)
                for a, k, least, most in bands:
                    x, old = s[a], kept.get((a, k))
                    if old and len(old[0]) == negatives:
                        least = max(least, int(old[0][-1]))  # what is below the worst of enough rows is of no use
                    at = np.flatnonzero((x >= least) & (x <= most) & ~same[a])
                    if len(at):
                        at = best(x, at, negatives)
                        kept[a, k] = merged(old, (x[at], vec[at], row[at]), negatives)
            out = [(own[a][0], k, int(s), None if v == NO_ID else int(v), int(r)) for (a, k), found in kept.items() for s, v, r in zip(*found, strict=True)]
            names = ["anchor", "k", "score", "vec_id", "row"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], names=names)

        found = packed.mapInArrow(run, "anchor long, k long, score long, vec_id long, row long")
        best_first = Window.partitionBy("anchor", "k").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
        return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= (positives if first else negatives))

    def blocks() -> Iterator[DataFrame]:
        for start in range(0, anchors.count(), block):
            mine_now = anchors.where(F.col("position").between(start, start + block - 1)).select(ROW, "label", "planes", "vec_id").collect()
            wanted = [[r[0], r[1], bytes(r[2])] for r in mine_now]
            near = staged(scan(wanted, True), "negatives-positives")
            of: dict[int, list] = {}
            for r in near.orderBy("anchor", "rank").collect():  # at most block * positives rows
                of.setdefault(r.anchor, []).append(r.score)
            found = scan([[*w, of.get(w[0], [])] for w in wanted], False)
            names = anchors.where(F.col("position").between(start, start + block - 1)).select(F.col(ROW).alias("anchor"), F.col("vec_id").alias("anchor_id"))
            pairs = near.select("anchor", (F.col("rank") - 1).cast("long").alias("k"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
            yield found.join(pairs, ["anchor", "k"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            release(near)

    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = staged_parts(blocks(), empty, "negatives-found")
    release(packed, anchors)
    return out
