"""Pairs of devices that report at the same ticks, and how often they are in the same state."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Devices of a block, and ticks of a slice: a task holds two blocks over one slice.
BLOCK, SLICE = 1000, 8192


def tally(table: pa.Table) -> pa.Table:
    """Counts of all pairs of two blocks of devices: dense matrices of devices by ticks, multiplied."""
    keys, row = np.unique(table["key"].to_numpy(), return_inverse=True)
    ticks, column = np.unique(table["tick"].to_numpy(), return_inverse=True)
    on, off = (np.zeros((len(keys), len(ticks)), np.float32) for _ in range(2))
    state = table["state"].to_numpy()
    there = np.zeros_like(on)
    there[row, column] = 1
    on[row[state == 1], column[state == 1]] = 1
    off[row[state == 0], column[state == 0]] = 1
    block = np.zeros(len(keys), np.int64)
    block[row] = table["block"].to_numpy()
    mine = np.flatnonzero(block == table["lo"][0].as_py())
    theirs = np.flatnonzero(block == table["hi"][0].as_py())
    product = lambda m: m[mine] @ m[theirs].T  # noqa: E731 (counts below 2 ** 24 are exact)
    n, same = product(there), product(on) + product(off)
    known = product(on + off)
    i, j = np.nonzero(n if table["lo"][0].as_py() != table["hi"][0].as_py() else np.triu(n, 1))
    a, b = keys[mine[i]], keys[theirs[j]]
    counts = [pa.array(m[i, j].astype(np.int64)) for m in (n, known, same)]
    return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *counts], names=["a", "b", "n", "known", "same"])


def agreement(states: DataFrame, group: str, key: str, tick: str, state: str, block: int | None = None, ticks: int | None = None) -> DataFrame:
    """One row (a, b, n, agree) for each two keys a < b of one group that share a tick: how many they share, and the share of
    those at which the states (boolean) are equal; ticks where either state is null count in n only, and agree is null if no other is there.

    states has one row for each key and tick at most; key and tick are longs, rows without one of them or without a group meet nothing.
    Keys are dealt into blocks by a hash, ticks into slices; each two blocks of a group meet in one task for each slice, so neither
    the rows that meet nor the pairs they make are shuffled, but for the sums over slices where there are several.
    """
    block, ticks = block or BLOCK, ticks or SLICE
    own = states.select(F.col(group).alias("g"), F.col(key).cast("long").alias("key"), F.col(tick).cast("long").alias("tick"), F.coalesce(F.col(state).cast("int"), F.lit(-1)).alias("state")).dropna(subset=["g", "key", "tick"])
    most = own.groupBy("g").agg(F.count_distinct("key").alias("n"), F.min("tick").alias("first"), F.max("tick").alias("last")).agg(F.max("n"), F.min("first"), F.max("last")).first()
    blocks = -(-(most[0] or 1) // block)
    slices = 1 + ((most[2] or 0) - (most[1] or 0)) // ticks
    dealt = own.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("slice", F.floor((F.col("tick") - F.lit(most[1] or 0)) / ticks))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("g", "slice", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "key", "tick", "state")
    found = dealt.groupBy("g", "slice", "lo", "hi").applyInArrow(tally, "a long, b long, n long, known long, same long")
    if slices > 1:
        found = found.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "known", "same")))
    return found.select("a", "b", "n", F.when(F.col("known") > 0, F.col("same") / F.col("known")).alias("agree"))
