"""Periods of a series and the cycles they cut it into.

Autocorrelation to large lags is a sum over blocks, each by FFT with a halo of the largest lag. Cycles are a graph: each quiet run has one successor, about a period
later, and those that the first bound leads to are found by pointer doubling, in as many rounds as the logarithm of the number of cycles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import lookups, sliced, windows
from tidemark.operators.sliced import Series
from tidemark.operators.staging import settled


def lagged_products(df: DataFrame, key: str, position: str, value: str, lags: int, block: int = 1 << 16) -> DataFrame:
    """(key, lag, s): the sum of x_i x_(i+lag) of each key, for lags 0 to `lags`, x about its mean. position numbers the rows of a key without gaps.

    A row goes to its own block and, as halo, to those before it that reach it. Nulls count as the mean. A task holds one block and its halo.
    """
    x = F.coalesce(F.when(~F.isnan(value), F.col(value)) - F.col("_mean"), F.lit(0.0))
    means = df.groupBy(F.col(key).alias("_key")).agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias("_mean"))
    own = df.join(means, F.col(key).eqNullSafe(F.col("_key"))).select(key, F.col(position).cast("long").alias("_p"), x.alias("_x"))
    first = F.greatest(F.lit(0), F.floor((F.col("_p") - lags) / block))
    dealt = own.withColumn("_block", F.explode(F.sequence(first, F.floor(F.col("_p") / block))))
    kind = dict(df.dtypes)[key]

    def products(names: tuple, part: pd.DataFrame) -> pd.DataFrame:
        label, number = names
        x = np.zeros(block + lags)
        x[part["_p"].to_numpy() - number * block] = part["_x"].to_numpy()
        used = int(part["_p"].max() - number * block) + 1
        size = 1 << int(np.ceil(np.log2(used + min(used, block) + 1)))
        s = np.fft.irfft(np.fft.rfft(x[:used], size) * np.conj(np.fft.rfft(x[: min(used, block)], size)), size)[: min(lags + 1, used)]
        return pd.DataFrame({key: pd.Series([label] * len(s), dtype=object), "lag": np.arange(len(s)), "s": s})

    found = dealt.groupBy(key, "_block").applyInPandas(products, f"{key} {kind}, lag long, s double")
    return found.groupBy(key, "lag").agg(F.sum("s").alias("s"))


def period(df: DataFrame, key: str, position: str, value: str, dt: float, low: float = 10.0, high: float = 120.0, height: float = 0.5, span: float | None = None, block: int = 1 << 16) -> DataFrame:
    """(key, period): the lag in seconds, from `low` to `high`, of the first peak of the autocorrelation that reaches `height`; null where none does.

    A peak is higher than its neighbours (the middle of equal ones), within the lags from low to high. span: only so many seconds from the start count, by default 20 times `high`.
    """
    lo, hi = int(low / dt), int(high / dt)
    used = df.where(F.col(position) < int((20 * high if span is None else span) / dt))
    sums = lagged_products(used, key, position, value, hi, block)
    whole = sums.where("lag = 0").select(F.col(key).alias("_key"), F.col("s").alias("_s"))
    curve = sums.join(whole, F.col(key).eqNullSafe(F.col("_key"))).where((F.col("lag") >= lo) & (F.col("lag") < hi)).select(key, "lag", F.round(F.col("s") / F.when(F.col("_s") > 0, F.col("_s")), 12).alias("r"))
    over = Window.partitionBy(key).orderBy("lag")  # hi - lo rows a key at most
    flat = curve.withColumn("_new", F.when(F.col("r").eqNullSafe(F.lag("r").over(over)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(over))
    runs = flat.groupBy(key, "_run").agg(F.first("r").alias("r"), F.floor((F.min("lag") + F.max("lag")) / 2).alias("lag"))
    across = Window.partitionBy(key).orderBy("_run")
    peak = (F.col("r") >= height) & (F.col("r") > F.lag("r").over(across)) & (F.col("r") > F.lead("r").over(across))
    found = runs.withColumn("_peak", F.coalesce(peak, F.lit(False))).groupBy(key).agg(F.min(F.when(F.col("_peak"), F.col("lag"))).alias("_lag"))
    every = df.select(F.col(key).alias("_key")).distinct()
    return every.join(found, F.col("_key").eqNullSafe(F.col(key)), "left").select(F.col("_key").alias(key), (F.col("_lag") * dt).alias("period"))


def quiet_runs(df: DataFrame, key: str, order: list[str], still: str, least: float = 1.0, rows: int | None = None) -> DataFrame:
    """(key, run, mid, size): the runs of rows that are still, from first to last row `least` or longer; order begins with the time, a number."""
    time = order[0]
    own = windows.run_id(Series(df, key, order, rows), "run", still).rows.where(still)
    found = own.groupBy(key, "run").agg(F.min(time).alias("_a"), F.max(time).alias("_b")).where(F.col("_b") - F.col("_a") >= least)
    return found.select(key, "run", ((F.col("_a") + F.col("_b")) / 2).alias("mid"), (F.col("_b") - F.col("_a")).alias("size"))


def chained(first: DataFrame, following: DataFrame, key: str) -> DataFrame:
    """(key, at): what is reached from first (key, at) over following (key, at, to), where each node has one successor, or a null one.

    By pointer doubling: each round adds what the reached ones reach over pointers of twice the length, so a chain of n takes log2(n) rounds.
    """
    reached, jumps = settled(first), following.select(F.col(key).alias("_key"), F.col("at").alias("_at"), "to").where("to is not null")
    while not jumps.isEmpty():
        step = reached.join(jumps, F.col(key).eqNullSafe(F.col("_key")) & (F.col("at") == F.col("_at"))).select(key, F.col("to").alias("at"))
        reached = settled(reached.union(step).distinct())
        second = jumps.toDF("_key2", "_at2", "_to2")
        jumps = settled(jumps.join(second, F.col("_key").eqNullSafe(F.col("_key2")) & (F.col("to") == F.col("_at2"))).select("_key", "_at", F.col("_to2").alias("to")))
    return reached


def cycles(df: DataFrame, key: str, order: list[str], still: str, periods: DataFrame, least: float = 1.0, rows: int | None = None) -> DataFrame:
    """(key, cycle, start, end): stretches between the middles of quiet runs that are about a period apart.

    The first bound is the middle of the longest quiet run in the first period, or else the first. After a bound comes the longest quiet run (the first of equals) whose middle is 0.7 to
    1.3 periods later, and the two are a cycle; where there is none, the search begins anew at the first run later than that. periods: (key, period), none null.
    """
    time = order[0]
    starts = df.groupBy(F.col(key).alias("_key")).agg(F.min(time).alias("_start")).join(periods.select(F.col(key).alias("_pkey"), "period").where("period > 0"), F.col("_key").eqNullSafe(F.col("_pkey"))).drop("_pkey")
    runs = settled(quiet_runs(df, key, order, still, least, rows).join(starts, F.col(key).eqNullSafe(F.col("_key"))).drop("_key"))
    longest = lambda c: F.max(F.when(c, F.struct(F.col("size"), (-F.col("mid")).alias("back"), F.col("run"))))
    first = runs.groupBy(key).agg(longest(F.col("mid") < F.col("_start") + F.col("period")).alias("_in"), F.min(F.struct("mid", "run")).alias("_any")).select(key, F.coalesce("_in.run", "_any.run").alias("at"))
    # A run's candidates lie in two stretches of a period's length at most, so runs meet by key and stretch.
    bucket = F.floor(F.col("mid") / F.col("period"))
    after = F.col("mid") + 0.7 * F.col("period"), F.col("mid") + 1.3 * F.col("period")
    asked = runs.select(key, F.col("run").alias("at"), after[0].alias("_from"), after[1].alias("_to"), F.explode(F.sequence(F.floor(after[0] / F.col("period")), F.floor(after[1] / F.col("period")))).alias("_b"))
    met = asked.join(runs.select(F.col(key).alias("_key"), "run", "mid", "size", bucket.alias("_b2")), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_b2"))).where("mid > _from and mid < _to")
    near = met.groupBy(key, "at").agg(F.max(F.struct(F.col("size"), (-F.col("mid")).alias("back"), F.col("run"))).alias("_best")).select(F.col(key).alias("_nkey"), F.col("at").alias("_nat"), F.col("_best.run").alias("near"))
    late = lookups.following(runs.select(key, after[1].alias("mid"), F.col("run").alias("at")), runs.select(key, "mid", "run"), key, "mid", "run", rows)
    following = settled(late.join(near, F.col(key).eqNullSafe(F.col("_nkey")) & (F.col("at") == F.col("_nat")), "left").select(key, "at", F.coalesce("near", "run").alias("to"), F.col("near").isNotNull().alias("_cycle")))
    reached = chained(first, following, key)
    at = reached.select(F.col(key).alias("_rkey"), F.col("at").alias("_rat"))
    chosen = following.where("_cycle").join(at, F.col(key).eqNullSafe(F.col("_rkey")) & (F.col("at") == F.col("_rat"))).select(key, "at", "to")
    mids = runs.select(F.col(key).alias("_key"), "run", "mid")
    out = chosen.join(mids.toDF("_ka", "_ra", "start"), F.col(key).eqNullSafe(F.col("_ka")) & (F.col("at") == F.col("_ra"))).join(mids.toDF("_kb", "_rb", "end"), F.col(key).eqNullSafe(F.col("_kb")) & (F.col("to") == F.col("_rb")))
    return Series(out.select(key, "start", "end"), key, ["start"], rows).running(cycle=sliced.number()).rows
