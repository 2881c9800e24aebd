"""Can a classifier tell two samples apart, and how well could it if it couldn't: a two-sample test by trees, with its permutation null.

Trees are grown level by level from histograms: features are cut into bins at exact quantiles once, and one pass over the binned rows counts, for every permutation of the labels, every
fold and every tree at once, how many rows of each label fall into each bin of each node. Counts of tasks add up, the best cut of a node is chosen from them, and all trees so far, whose
number and size are parameters and not the rows', go along with the next pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import statistics
from tidemark.operators.staging import settled

FOLDS = 5


def draw(seed: int, permutation: Column, row: Column) -> Column:
    """A number below 2^52 from a row's id, anew for each permutation."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(f"{seed}"), permutation.cast("string"), row.cast("string"))), 1, 13), 16, 10).cast("long")


def subset(seed: int, tree: int, features: int) -> np.ndarray:
    """The features that a tree looks at: the root of their number, rounded up."""
    return np.sort(np.random.default_rng([seed, tree]).permutation(features)[: int(np.ceil(np.sqrt(features)))])


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(fold, bins, labels) of about so many rows at a time."""
    held, size = [], 0
    for part in batches:
        held.append(part)
        size += len(part)
        if size >= rows:
            yield unpacked(held)
            held, size = [], 0
    if held:
        yield unpacked(held)


def unpacked(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(parts).combine_chunks()
    square = lambda c: np.stack(table[c].to_numpy(zero_copy_only=False)).astype(np.int64)
    return table["fold"].to_numpy(), square("bins"), square("labels")


def nodes(bins: np.ndarray, chosen: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """The node of each row after the levels in splits (nodes so far, 2): a feature of the tree's and the last bin that goes left; a node without a cut (-1) sends all left."""
    at = np.zeros(len(bins), np.int64)
    for level in range(int(np.log2(len(splits) + 1))):
        first = (1 << level) - 1
        feature, cut = splits[first + at, 0], splits[first + at, 1]
        right = (feature >= 0) & (bins[np.arange(len(bins)), chosen[np.maximum(feature, 0)]] > cut)
        at = 2 * at + right
    return at


def best_cut(counts: np.ndarray, weights: np.ndarray) -> tuple[int, int]:
    """(feature, bin) of the cut with the largest fall of the weighted Gini impurity, the first of equals within 1e-12; (-1, 0) where none helps. counts: (features, bins, labels)."""
    mass = counts * weights
    left = np.cumsum(mass, axis=1)[:, :-1]
    whole = mass.sum(1, keepdims=True)
    right = whole - left
    square = lambda m: (m * m).sum(2) / np.maximum(m.sum(2), 1e-300)
    gain = square(left) + square(right) - square(whole)
    usable = (left.sum(2) > 0) & (right.sum(2) > 0)
    gain = np.where(usable, gain, -np.inf)
    if not usable.any() or gain.max() <= 1e-12:
        return -1, 0
    feature, cut = np.argwhere(gain >= gain.max() - 1e-12)[0]
    return int(feature), int(cut)


def accuracies(df: DataFrame, row: str, side: str, block: str, features: list[str], permutations: int = 100, trees: int = 16, depth: int = 3, bins: int = 16, seed: int = 0) -> DataFrame:
    """(permutation, accuracy): balanced accuracy of telling side 1 from side 0, cross-validated over folds of blocks (block % 5); permutation 0 has the true labels, 1 to `permutations`
    have as many of each, dealt out anew over all rows.

    A forest of `trees` trees of `depth` levels votes by the mean of its leaves' shares, labels weighted to equal mass; each tree looks at some of the features. A fold whose test or training
    rows lack a label doesn't count. row is a unique id; rows with a null take no part. The largest thing a task holds are the histograms: trees * folds * (permutations + 1) * nodes * bins.
    """
    own = df.select(F.col(row).alias("row"), F.col(side).cast("int").alias("side"), (F.col(block) % FOLDS).cast("int").alias("fold"), *(F.col(f).cast("double").alias(f) for f in features)).dropna()
    long = own.select(F.inline(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f).alias("x")) for i, f in enumerate(features)))))
    cuts = {r["f"]: [r[f"c{k}"] for k in range(1, bins)] for r in statistics.quantiles(long, "f", "x", {f"c{k}": k / bins for k in range(1, bins)}).collect()}
    if not cuts:
        return df.sparkSession.createDataFrame([], "permutation int, accuracy double")
    below = lambda i, x: F.size(F.filter(F.array(*map(F.lit, cuts[i])), lambda c: c < x))
    binned = F.array(*(below(i, F.col(f)) for i, f in enumerate(features)))
    ones = own.where("side = 1").count()
    every = F.sequence(F.lit(1), F.lit(permutations)) if permutations else F.array().cast("array<int>")
    drawn = own.select(F.explode(F.transform(every, lambda p: F.struct(p.alias("p"), draw(seed, p, F.col("row")).alias("u")))).alias("d")).select("d.p", "d.u")
    ranked = statistics.running_counts(drawn, "p", "u", {"n": F.count(F.lit(1))})
    limits = {r["p"]: r["u"] for r in ranked.where(F.col("n_upto") >= ones).groupBy("p").agg(F.min("u").alias("u")).collect()} if ones else {}
    table = F.array(*(F.lit(limits.get(p, -1)) for p in range(1, permutations + 1))) if permutations else None
    labels = F.concat(F.array("side"), F.transform(every, lambda p: (draw(seed, p, F.col("row")) <= F.get(table, p - 1)).cast("int"))) if permutations else F.array("side")
    rows = settled(own.select("fold", binned.alias("bins"), labels.alias("labels")))
    chosen = np.array([subset(seed, t, len(features)) for t in range(trees)])
    names = [(p, f, t) for p in range(permutations + 1) for f in range(FOLDS) for t in range(trees)]

    def size_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for fold, _, label in gathered(batches):
            counts = np.stack([[(label[fold == f] == c).sum(0) for c in (0, 1)] for f in range(FOLDS)])  # folds, labels, permutations
            where = np.argwhere(counts >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(where[:, k]) for k in range(3)] + [pa.array(counts.ravel())], names=["f", "c", "p", "n"])

    sizes = np.zeros((FOLDS, 2, permutations + 1))
    for r in rows.mapInArrow(size_of, "f long, c long, p long, n long").groupBy("f", "c", "p").agg(F.sum("n").alias("n")).collect():
        sizes[r.f, r.c, r.p] = r.n
    training = sizes.sum(0)[None] - sizes
    weights = np.divide(training.sum(1, keepdims=True), 2 * training, out=np.zeros_like(training), where=training > 0)
    sound = (sizes > 0).all(1) & (training > 0).all(1)  # folds, permutations
    splits = np.zeros((len(names), 0, 2), np.int64)

    def passed(rows: DataFrame, task, schema: str) -> DataFrame:  # noqa: ANN001
        sent = rows.sparkSession.sparkContext.broadcast(splits)
        return rows.mapInArrow(lambda batches: task(batches, sent.value), schema)

    for level in range(depth):
        width, m = 1 << level, chosen.shape[1]

        def count(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(names), width * m * bins * 2), np.int64)
            for fold, b, label in gathered(batches):
                for k, (p, f, t) in enumerate(names):
                    use = fold != f
                    part = b[use]
                    at = nodes(part, chosen[t], known[k])
                    index = ((at[:, None] * m + np.arange(m)) * bins + part[:, chosen[t]]) * 2 + label[use, p][:, None]
                    total[k] += np.bincount(index.ravel(), minlength=total.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names))), pa.array([x.tobytes() for x in total], pa.binary())], names=["tree", "counts"])

        def choose(part: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x, np.int64) for x in part["counts"]).reshape(width, m, bins, 2)
            tree = int(part["tree"].iloc[0])
            p, f, _ = names[tree]
            return pd.DataFrame([(tree, i, *best_cut(total[i], weights[f, :, p])) for i in range(width)], columns=["tree", "node", "feature", "cut"])

        found = passed(rows, count, "tree long, counts binary").groupBy("tree").applyInPandas(choose, "tree long, node long, feature long, cut long").collect()
        new = np.full((len(names), width, 2), -1, np.int64)
        for r in found:
            new[r.tree, r.node] = r.feature, r.cut
        splits = np.concatenate([splits, new], axis=1)

    leaves = 1 << depth

    def fill(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), leaves * 2), np.int64)
        for fold, b, label in gathered(batches):
            for k, (p, f, t) in enumerate(names):
                use = fold != f
                total[k] += np.bincount(nodes(b[use], chosen[t], known[k]) * 2 + label[use, p], minlength=leaves * 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(names)), leaves * 2)), pa.array(np.tile(np.arange(leaves * 2), len(names))), pa.array(total.ravel())], names=["tree", "at", "n"])

    shares = np.full((len(names), leaves), 0.5)
    mass = np.zeros((len(names), leaves, 2))
    for r in passed(rows, fill, "tree long, at long, n long").groupBy("tree", "at").agg(F.sum("n").alias("n")).collect():
        mass[r.tree, r.at // 2, r.at % 2] = r.n
    mass *= np.array([weights[f, :, p] for p, f, _ in names])[:, None]
    np.divide(mass[:, :, 1], mass.sum(2), out=shares, where=mass.sum(2) > 0)

    def judge(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
        right = np.zeros((permutations + 1, FOLDS, 2), np.int64)
        for fold, b, label in gathered(batches):
            for f in range(FOLDS):
                use = fold == f
                for p in range(permutations + 1):
                    first = (p * FOLDS + f) * trees
                    vote = sum(shares[first + t][nodes(b[use], chosen[t], known[first + t])] for t in range(trees)) / trees
                    hit = (vote > 0.5) == (label[use, p] == 1)
                    right[p, f] += np.array([hit[label[use, p] == c].sum() for c in (0, 1)])
        where = np.argwhere(right >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(where[:, k]) for k in range(3)] + [pa.array(right.ravel())], names=["p", "f", "c", "n"])

    hits = np.zeros((permutations + 1, FOLDS, 2))
    for r in passed(rows, judge, "p long, f long, c long, n long").groupBy("p", "f", "c").agg(F.sum("n").alias("n")).collect():
        hits[r.p, r.f, r.c] = r.n
    by_label = np.divide(hits, sizes.transpose(2, 0, 1), out=np.zeros_like(hits), where=sizes.transpose(2, 0, 1) > 0).mean(2)  # permutations, folds
    out = [(p, float(by_label[p][sound[:, p]].mean()) if sound[:, p].any() else None) for p in range(permutations + 1)]
    return df.sparkSession.createDataFrame(out, "permutation int, accuracy double")


def verdict(found: DataFrame, share: float = 0.95) -> DataFrame:
    """One row (accuracy, null_mean, null_limit, told_apart) of accuracies(): whether the true labels' is over that share of the null's."""
    null = statistics.quantiles(found.where("permutation > 0").select(F.lit(1).alias("k"), "accuracy").where("accuracy is not null"), "k", "accuracy", {"null_limit": share})
    mean = found.where("permutation > 0").agg(F.avg("accuracy").alias("null_mean"))
    own = found.where("permutation = 0").select("accuracy")
    return own.join(mean).join(null.drop("k")).select("accuracy", "null_mean", "null_limit", (F.col("accuracy") > F.col("null_limit")).alias("told_apart"))
