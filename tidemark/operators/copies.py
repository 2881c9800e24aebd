"""Whether a series repeats another: the largest correlation of each of its windows with any stretch of the other.

The other series is cut into blocks with a halo of a window's length, the windows are dealt to blocks in batches, and a task correlates one batch with one
block by FFT (overlap-save: only offsets that lie whole in the block and its halo are kept). So nothing holds a whole series, and the work is windows by blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 1e-12  # a stretch or window of less variation correlates with nothing


def best_offsets(x: np.ndarray, known: np.ndarray, windows: np.ndarray, offsets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window (k, length, channels) the largest correlation with x (n, channels) at the offsets 0 to offsets - 1, and the least offset that has it within rounding.

    Sums over windows come from prefix sums about the block's mean; an offset whose stretch holds an unknown row isn't considered. Nan where there is none, or no variation.
    """
    length = windows.shape[1]
    pad = lambda a: np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
    x = np.where(known[:, None], x, 0.0)
    x = np.where(known[:, None], x - x.sum(0) / max(1, known.sum()), 0.0)
    span = lambda a: (pad(a)[length:] - pad(a)[:-length])[:offsets]
    sums, squares = span(x), span(x * x)
    power = (squares - sums * sums / length).sum(1)
    usable = (span(known.astype(float)[:, None])[:, 0] > length - 0.5) & (power > LEAST)
    best, where = np.full(len(windows), np.nan), np.zeros(len(windows), np.int64)
    if not usable.any():
        return best, where
    size = 1 << int(np.ceil(np.log2(len(x) + length)))
    spectrum = np.fft.rfft(x, size, axis=0)
    norm = np.sqrt(np.where(usable, power, 1.0))
    for i, w in enumerate(windows):
        w = w - w.mean(0)
        own = np.sqrt((w * w).sum())
        if own * own < LEAST:
            continue
        met = np.fft.irfft((spectrum * np.conj(np.fft.rfft(w, size, axis=0))).sum(1), size)[: len(norm)]
        r = np.where(usable, met / (norm * own), -np.inf)
        best[i] = r.max()
        where[i] = int(np.flatnonzero(r >= best[i] - 1e-9)[0])
    return best, where


def largest_correlations(series: DataFrame, reference: DataFrame, key: str, position: str, channels: list[str], length: int, block: int = 1 << 16, batch: int = 256) -> DataFrame:
    """(key, window, r, at): for each window of `length` rows of a key's series, one after another, the largest correlation over all channels together with any
    stretch of the key's reference, and where that begins; of stretches that are equal within 1e-9 the first.

    position numbers the rows of a key without gaps, from 0. A window with a missing row or a null isn't judged and has no row; a stretch with one isn't considered. r is
    null for a window without variation, or where no stretch is left. A key without reference has no row. Both sides may be of any length: a task holds
    block + length rows of one and batch * length of the other.
    """
    at = F.col(position)
    finite = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    plain = lambda df: df.where(F.col(key).isNotNull() & at.isNotNull()).select(key, at.cast("long").alias("_p"), *(finite(c).alias(f"_c{i}") for i, c in enumerate(channels)))
    ref, own = plain(reference), plain(series)
    ends = ref.groupBy(key).agg(F.floor(F.max("_p") / block).alias("_last_block")).join(own.groupBy(key).agg(F.floor(F.max("_p") / (length * batch)).alias("_last_batch")), key)
    to_ref, to_own = ends.toDF("_key", "_blocks", "_batches"), ends.toDF("_key", "_blocks", "_batches")
    first_block = F.greatest(F.lit(0), F.floor((F.col("_p") - (length - 1)) / block))
    blocks = ref.join(to_ref, F.col(key) == F.col("_key")).withColumn("_block", F.explode(F.sequence(first_block, F.floor(F.col("_p") / block)))).withColumn("_batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_batches"))))
    dealt = own.join(to_own, F.col(key) == F.col("_key")).withColumn("_batch", F.floor(F.col("_p") / (length * batch))).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks"))))
    values = [f"_c{i}" for i in range(len(channels))]
    kind = dict(series.dtypes)[key]

    def correlate(names: tuple, stretch: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        label, number, some = names
        x, known = np.zeros((block + length - 1, len(values))), np.zeros(block + length - 1, bool)
        place = stretch["_p"].to_numpy() - number * block
        rows = stretch[values].to_numpy(float)
        x[place], known[place] = rows, ~np.isnan(rows).any(1)
        windows = np.full((batch * length, len(values)), np.nan)
        windows[part["_p"].to_numpy() - some * batch * length] = part[values].to_numpy(float)
        windows = windows.reshape(batch, length, len(values))
        whole = np.flatnonzero(~np.isnan(windows).any((1, 2)))
        used = int(np.flatnonzero(known).max(initial=-1)) + 1  # a last block is short
        if used < length:
            return pd.DataFrame({key: pd.Series([label] * len(whole), dtype=object), "window": some * batch + whole, "r": np.full(len(whole), np.nan), "at": np.zeros(len(whole), np.int64)})
        r, where = best_offsets(x[:used], known[:used], windows[whole], min(block, used - length + 1))
        return pd.DataFrame({key: pd.Series([label] * len(whole), dtype=object), "window": some * batch + whole, "r": r, "at": number * block + where})

    names = [key, "_block", "_batch"]
    found = dealt.groupBy(*names).cogroup(blocks.toDF(*blocks.columns).groupBy(*names)).applyInPandas(lambda n, a, b: correlate(n, b, a), f"{key} {kind}, window long, r double, at long")
    known = F.when(~F.isnan("r"), F.struct(F.round("r", 9).alias("_near"), (-F.col("at")).alias("_back"), F.col("r").alias("r")))
    best = found.where(F.col("window").isNotNull()).groupBy(key, "window").agg(F.max(known).alias("_best"))
    return best.select(key, "window", F.col("_best.r").alias("r"), (-F.col("_best._back")).alias("at"))


def standardised(df: DataFrame, reference: DataFrame, key: str, channels: list[str]) -> DataFrame:
    """Channels of df about the reference's mean of the key, in units of its deviation (in their own unit where it doesn't vary)."""
    stats = reference.groupBy(F.col(key).alias("_key")).agg(*(x for c in channels for x in (F.avg(c).alias(f"_{c}_mean"), F.stddev_pop(c).alias(f"_{c}_sd"))))
    scaled = {c: (F.col(c) - F.col(f"_{c}_mean")) / F.when(F.col(f"_{c}_sd") > 1e-9, F.col(f"_{c}_sd")).otherwise(1.0) for c in channels}
    return df.join(stats, F.col(key) == F.col("_key")).withColumns(scaled).select(*df.columns)


def copied(correlations: DataFrame, key: str, level: float = 0.99) -> DataFrame:
    """(key, windows, copied, percent): the windows that could be judged, and those that correlate beyond the level."""
    over = F.count(F.when(F.col("r") > level, 1))
    return correlations.groupBy(key).agg(F.count("r").alias("windows"), over.alias("copied"), (100 * over / F.nullif(F.count("r"), F.lit(0))).alias("percent"))


def informative(percent: Column, most: float = 97.0) -> Column:
    """Whether copies can be told at all: a held-out part of the same recording scores less than `most` itself."""
    return percent < most
