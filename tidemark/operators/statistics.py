"""Distribution statistics as grouped aggregation.

Exact ranks need no group in one task: values are counted first, and the counted values of a key are a series in the order of the values, whose running
counts come from sliced.Series. So the rows are read once, whatever is asked of their ranks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import sliced
from tidemark.operators.sliced import Series


def running_counts(df: DataFrame, key: str, value: str, counts: dict[str, Column], rows: int | None = None, following: bool = False) -> DataFrame:
    """One row for each key and distinct value: the counts (sums of rows, or of anything), "<name>_upto" (of this and all lesser values), "<name>_all", and if asked for, next_value, the one following."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(*(c.alias(n) for n, c in counts.items()))
    folds = {f"{n}_upto": sliced.total(F.col(n)) for n in counts} | {f"{n}_from": sliced.remaining(F.col(n)) for n in counts}
    own = Series(counted, key, [value], rows)
    if following:
        own = own.framed(0, 1, next_value=lambda w: F.lead(value).over(w))
    own = own.running(**folds)
    return own.rows.select(key, value, *counts, *(c for n in counts for c in (F.col(f"{n}_upto"), (F.col(f"{n}_upto") + F.col(f"{n}_from") - F.col(n)).alias(f"{n}_all"))), *(["next_value"] if following else []))


def between(value: str, shares: dict[str, float]) -> list[Column]:
    """For a grouped table of running_counts(), whose count is n: "_<name>_a" and "_<name>_b", the values at both sides of each share of the ranks, and "_<name>_s", how far between."""
    at = {name: F.lit(p) * (F.col("n_all") - 1) for name, p in shares.items()}
    return [c for name, p in at.items() for c in (F.min(F.when(F.col("n_upto") > F.floor(p), F.col(value))).alias(f"_{name}_a"), F.min(F.when(F.col("n_upto") > F.ceil(p), F.col(value))).alias(f"_{name}_b"), F.first(p - F.floor(p)).alias(f"_{name}_s"))]


def line(name: str) -> Column:
    a, b = F.col(f"_{name}_a"), F.col(f"_{name}_b")
    return F.when(a == b, a).otherwise(a + (b - a) * F.col(f"_{name}_s"))


def quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float], rows: int | None = None) -> DataFrame:
    """Exact quantiles of each key, by linear interpolation: one column for each name in shares."""
    found = running_counts(df, key, value, {"n": F.count(F.lit(1))}, rows).groupBy(key).agg(*between(value, shares))
    return found.select(key, *(line(n).alias(n) for n in shares))


def mad(df: DataFrame, key: str, value: str, rows: int | None = None) -> DataFrame:
    """1.4826 times the median distance from the median."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_w"))
    ranked = lambda d, v: running_counts(d, key, v, {"n": F.sum("_w")}, rows).groupBy(key).agg(*between(v, {"m": 0.5}))
    middle = ranked(counted, value).select(F.col(key).alias("_key"), line("m").alias("_m"))
    away = counted.join(middle, F.col(key).eqNullSafe(F.col("_key"))).select(key, F.abs(F.col(value) - F.col("_m")).alias("_away"), "_w")
    return ranked(away, "_away").select(key, (1.4826 * line("m")).alias("mad"))


def distances(df: DataFrame, key: str, value: str, side: str, rows: int | None = None) -> DataFrame:
    """Kolmogorov-Smirnov and Wasserstein distances of the two sides (0 and 1) of each key."""
    ranked = running_counts(df, key, value, {f"n{s}": F.count(F.when(F.col(side) == s, 1)) for s in (0, 1)}, rows, following=True)
    gap = F.abs(F.col("n0_upto") / F.nullif(F.col("n0_all"), F.lit(0)) - F.col("n1_upto") / F.nullif(F.col("n1_all"), F.lit(0)))
    return ranked.groupBy(key).agg(F.max(gap).alias("ks"), F.sum(gap * (F.col("next_value") - F.col(value))).alias("wasserstein"))


def autocorrelation(df: DataFrame, key: str, value: str, order: list[str], lags: int, rows: int | None = None) -> DataFrame:
    """Sum of x_i x_(i+k) by n times the variance, x about its mean, for lags 0 to `lags` (below n); 0 for a constant series. All lags are offsets in one window,
    of a series that is cut where it is long; means come from a grouped aggregate."""
    whole = df.groupBy(F.col(key).alias("_key")).agg(F.avg(value).alias("_mean"), F.var_pop(value).alias("var"), F.count(value).alias("n"))
    own = df.join(whole, F.col(key).eqNullSafe(F.col("_key"))).select(key, *order, (F.col(value) - F.col("_mean")).alias("_x"))
    shifted = Series(own, key, order, rows).framed(lags, **{f"p{k}": (lambda w, k=k: F.col("_x") * (F.lag("_x", k).over(w) if k else F.col("_x"))) for k in range(lags + 1)}).rows
    sums = shifted.groupBy(key).agg(*(F.sum(f"p{k}").alias(f"p{k}") for k in range(lags + 1))).join(whole, F.col(key).eqNullSafe(F.col("_key")))
    acf = F.array(*(F.struct(F.lit(k).alias("lag"), F.when(F.col("var") < 1e-12, 0.0).otherwise(F.col(f"p{k}") / (F.col("var") * F.col("n"))).alias("acf")) for k in range(lags + 1)))
    return sums.select(key, "n", F.inline(acf)).where("lag < n").drop("n")


def seeded(seed: str, *parts: Column) -> Column:
    """A whole number below 2^32 from the parts, the same wherever it is computed."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def bootstrapped(df: DataFrame, key: str, block: str, value: str, share: float, reps: int = 200, seed: str = "boot", rows: int | None = None) -> DataFrame:
    """(key, quantile, sigma): an exact quantile of each key and its standard deviation over `reps` draws of as many blocks, with replacement.

    What is drawn are blocks, so a draw is a table of how often each block counts; joined to the counted values of the blocks it gives each draw's ranks without copying a row more than once a draw.
    Nulls take no part. sigma is null with fewer than two draws.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, block, value).agg(F.count(F.lit(1)).alias("_c"))
    blocks = Series(counted.select(key, block).distinct(), key, [block], rows).running(_i=sliced.number(), _left=sliced.remaining(F.lit(1))).rows
    blocks = blocks.select(F.col(key).alias("_key"), F.col(block).alias("_block"), (F.col("_i") - 1).alias("_i"), (F.col("_i") + F.col("_left") - 1).alias("_k"))
    draws = blocks.select("_key", "_k", "_i", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("_rep")).select("_key", "_rep", (seeded(seed, F.col("_rep"), F.col("_i")) % F.col("_k")).alias("_j"))
    often = draws.groupBy("_key", "_rep", "_j").agg(F.count(F.lit(1)).alias("_times")).toDF("_dkey", "_rep", "_j", "_times")
    named = blocks.join(often, F.col("_key").eqNullSafe(F.col("_dkey")) & (F.col("_i") == F.col("_j"))).select("_key", "_block", "_rep", "_times")
    drawn = counted.join(named, F.col(key).eqNullSafe(F.col("_key")) & F.col(block).eqNullSafe(F.col("_block"))).select(F.struct(F.col(key).alias("k"), F.col("_rep").alias("rep")).alias("_of"), value, (F.col("_c") * F.col("_times")).alias("_w"))
    each = running_counts(drawn, "_of", value, {"n": F.sum("_w")}, rows).groupBy("_of").agg(*between(value, {"q": share}))
    spread = each.groupBy(F.col("_of.k").alias("_skey")).agg(F.stddev_samp(line("q")).alias("sigma"))
    whole = running_counts(counted, key, value, {"n": F.sum("_c")}, rows).groupBy(key).agg(*between(value, {"q": share})).select(key, line("q").alias("quantile"))
    return whole.join(spread, F.col(key).eqNullSafe(F.col("_skey"))).select(key, "quantile", "sigma")


def tolerance(own: Column, other: Column) -> Column:
    """Twice the deviation of a difference whose sides have these."""
    return 2 * F.sqrt(own * own + other * other)


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """The limit distribution's chance of a Kolmogorov-Smirnov distance of d or more between samples of n and m equal distributions: 2 * sum of (-1)^(k-1) exp(-2 k^2 x^2)."""
    x2 = d * d * n * m / (n + m)
    # For a small x the terms fall slowly, and the other form of the same sum, of pi^2 / 8 x^2, is exact to double precision.
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * x2))
    head = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0.0), lambda a, k: a + F.exp(-F.pow(2 * k - 1, F.lit(2)) * math.pi**2 / (8 * x2)))
    small = 1 - F.sqrt(2 * math.pi / x2) * head
    return F.when(x2 <= 0, 1.0).when(x2 < 1, small).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def similarity(df: DataFrame, key: str, value: str, side: str, order: list[str], lags: int = 10, rows: int | None = None) -> DataFrame:
    """One row for each key that compares two series (sides 0 and 1, ordered by `order`): distances of values (by side 0's range) and of
    increments, Kolmogorov-Smirnov on values of four digits with its p-value and its critical value for the lesser length, and autocorrelations. A
    key whose side 0 is constant has no row. All three distances are read off one table of counted values."""
    tagged = df.withColumn("_series", F.struct(key, side))
    steps = Series(tagged, "_series", order, rows).framed(1, _step=lambda w: F.col(value) - F.lag(value).over(w)).rows
    kinds = F.array(F.struct(F.lit("v").alias("kind"), F.col(value).alias("x")), F.struct(F.lit("k").alias("kind"), F.round(value, 4).alias("x")), F.struct(F.lit("s").alias("kind"), F.col("_step").alias("x")))
    long = steps.select(key, side, F.inline(kinds)).select(F.struct(key, "kind").alias("_k"), "x", side)
    at = lambda kind, s: F.when((F.col("_k.kind") == kind) & (F.col(f"n{s}") > 0), F.col("x"))
    ranked = running_counts(long, "_k", "x", {f"n{s}": F.count(F.when(F.col(side) == s, 1)) for s in (0, 1)}, rows, following=True)
    gap = F.abs(F.col("n0_upto") / F.nullif(F.col("n0_all"), F.lit(0)) - F.col("n1_upto") / F.nullif(F.col("n1_all"), F.lit(0)))
    of = lambda kind, c: F.when(F.col("_k.kind") == kind, c)
    area = gap * (F.col("next_value") - F.col("x"))
    spans = {"_range": ("v", F.max(at("v", 0)) - F.min(at("v", 0))), "_srange": ("s", F.max(at("s", 0)) - F.min(at("s", 0)))}
    found = ranked.groupBy(F.col(f"_k.{key}").alias(key)).agg(F.sum(of("v", area)).alias("_w"), F.max(of("k", gap)).alias("ks"), F.sum(of("s", area)).alias("_wi"), *(c.alias(n) for n, (_, c) in spans.items()), *(F.first(of("v", F.col(f"n{s}_all")), ignorenulls=True).alias(f"_n{s}") for s in (0, 1)))
    acf = autocorrelation(tagged, "_series", value, order, lags, rows).select(F.col(f"_series.{key}").alias(key), F.col(f"_series.{side}").alias("_side"), "lag", "acf")
    apart = F.max(F.when(F.col("_side") == 0, F.col("acf"))) - F.max(F.when(F.col("_side") == 1, F.col("acf")))
    curves = acf.groupBy(key, "lag").agg(apart.alias("_d")).groupBy(key).agg(F.avg(F.abs("_d")).alias("acf_diff"), F.avg(F.col("_d") * F.col("_d")).alias("acf_mse"))
    out = found.where("_range >= 1e-12").join(curves, key)
    least = F.least("_n0", "_n1")
    return out.select(key, (F.col("_w") / F.col("_range")).alias("w_value"), "ks", ks_p_value(F.col("ks"), least, least).alias("ks_p"), (1.36 * F.sqrt(2.0 / least)).alias("ks_critical"), (F.col("_wi") / F.when(F.col("_srange") > 1e-12, F.col("_srange")).otherwise(1.0)).alias("w_step"), "acf_diff", "acf_mse")


def verdict(value: Column, good: float, ok: float) -> Column:
    return F.when(value < good, "GOOD").when(value < ok, "OK").otherwise("POOR")


def correlation(x: str, y: str, least: int = 10) -> Column:
    """Pearson's r over pairs of finite numbers; null for fewer than `least` pairs and for a constant side."""
    pair = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    a, b = F.when(pair, F.col(x)), F.when(pair, F.col(y))
    return F.when((F.count(a) >= least) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))


def cross_lags(df: DataFrame, sensor: str, tick: str, value: str, most: int) -> DataFrame:
    """For each pair of sensors (a before b) the shift of b, of -most to most ticks around the end of the span, at which they correlate best (the least of equals).

    df has one row for each sensor and tick. Ticks without a row count as the sensor's mean; a shift at which no rows meet isn't considered, and a constant
    sensor has correlation 0. Each row is dealt to 2 * most + 1 ticks and meets the other sensors' rows there, so work grows with the ticks, not their square.
    """
    span = df.agg(F.min(tick).alias("_first"), (F.max(tick) - F.min(tick) + 1).alias("_n"))  # one row
    means = df.groupBy(F.col(sensor).alias("_key")).agg(F.avg(value).alias("_mean"))
    own = df.join(means, F.col(sensor).eqNullSafe(F.col("_key"))).select(F.col(sensor).alias("a"), F.col(tick).alias("_t"), (F.col(value) - F.col("_mean")).alias("x")).join(F.broadcast(span))
    own = own.select("a", (F.col("_t") - F.col("_first")).alias("i"), "x", "_n")
    power = own.groupBy("a").agg(F.sum(F.col("x") * F.col("x")).alias("p"))
    shifted = own.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).select(F.col("a").alias("b"), F.pmod(F.col("i") + F.col("lag"), F.col("_n")).alias("i"), F.col("x").alias("y"), "lag")
    met = own.select("a", "i", "x").join(shifted, "i").where("a < b").groupBy("a", "b", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    scale = F.sqrt(F.col("p") * F.col("q"))
    r = met.join(power, "a").join(power.toDF("b", "q"), "b").select("a", "b", "lag", (F.col("s") / F.when(scale > 0, scale).otherwise(1.0)).alias("r"))
    best = r.groupBy("a", "b").agg(F.max(F.struct(F.round("r", 9).alias("r"), (-F.col("lag")).alias("back"))).alias("m"))
    return best.select("a", "b", (-F.col("m.back")).alias("lag"), F.col("m.r").alias("r"))


def mode_bin(df: DataFrame, key: str, value: str, bins: int = 30) -> DataFrame:
    """The fullest of `bins` equal bins of each key's range (the lowest of equals) and its middle."""
    ends = df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    counted = df.join(ends, key).groupBy(key, "_lo", "_hi", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy(key, "_lo", "_hi").agg(F.max(F.struct("n", (-F.col("bin")).alias("_b"))).alias("_m"))
    return best.select(key, (-F.col("_m._b")).alias("bin"), F.col("_m.n").alias("n"), (F.col("_lo") + (0.5 - F.col("_m._b")) * width).alias("middle"))


def otsu(df: DataFrame, key: str, value: str, shares: list[int] | None = None, least: int = 10, rows: int | None = None) -> DataFrame:
    """The threshold, among percentiles 10, 12, to 88, that parts the values of each key (up to it, and above) with the least variance within both parts; the first of
    equals. A threshold that leaves fewer than `least` values on a side isn't considered; a key without any has no row. With both parts' means.

    Counts, sums and squares up to each percentile are read off one ranked table; there is no second pass over the rows.
    """
    shares = shares or list(range(10, 90, 2))
    x = F.col("_y")
    whole = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.avg(value).alias("_mean"))
    centred = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_w")).join(whole, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_y", F.col(value) - F.col("_mean"))
    ranked = running_counts(centred, key, value, {"n": F.sum("_w"), "s": F.sum(x * F.col("_w")), "q": F.sum(x * x * F.col("_w"))}, rows)
    # Each percentile lies between two ranks: the rows that hold them, a few of each key, have all that is needed of the values up to them.
    rank = lambda p, side: (F.floor if side == "a" else F.ceil)(p / 100 * (F.col("n_all") - 1))
    # Only percentiles near a row's ranks are tried, not all for each row; the first and last are widened by one against rounding.
    near = lambda x: F.least(F.greatest(F.coalesce(x, F.lit(min(shares))), F.lit(min(shares))), F.lit(max(shares))).cast("int")
    part = 100 / F.nullif(F.col("n_all") - 1, F.lit(0))
    tries = F.sequence(near(F.floor((F.col("n_upto") - F.col("n") - 1) * part) - 1), F.when(F.col("n_all") > 1, near(F.ceil(F.col("n_upto") * part) + 1)).otherwise(max(shares)))
    held = lambda side: F.transform(F.filter(tries, lambda p: p.isin(shares) & (rank(p, side) >= F.col("n_upto") - F.col("n")) & (rank(p, side) < F.col("n_upto"))), lambda p: F.struct(p.alias("p"), F.lit(side).alias("side")))
    ends = ranked.groupBy(F.col(key).alias("_key")).agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.sum("q").alias("_q"))
    hits = ranked.select(key, F.col(value).alias("v"), "n_upto", "s_upto", "q_upto", "n_all", F.inline(F.concat(held("a"), held("b"))))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{c}_{side}")
    tried = hits.groupBy(key, "p").agg(*(of(side, c) for side in "ab" for c in ("v", "n_upto", "s_upto", "q_upto")), F.first("n_all").alias("_all"))
    share = F.col("p") / 100 * (F.col("_all") - 1)
    t = F.when(F.col("v_a") == F.col("v_b"), F.col("v_a")).otherwise(F.col("v_a") + (F.col("v_b") - F.col("v_a")) * (share - F.floor(share)))
    tried = tried.join(ends, F.col(key).eqNullSafe(F.col("_key"))).select(key, "p", t.alias("t"), *(F.when(t >= F.col("v_b"), F.col(f"{c}_upto_b")).otherwise(F.col(f"{c}_upto_a")).alias(c) for c in "nsq"), "_n", "_s", "_q")
    m, r, u = F.col("_n") - F.col("n"), F.col("_s") - F.col("s"), F.col("_q") - F.col("q")
    within = F.col("q") - F.col("s") * F.col("s") / F.col("n") + u - r * r / m
    sound = tried.where((F.col("n") >= least) & (m >= least)).select(key, F.struct(within.alias("within"), "p", "t", (F.col("s") / F.col("n")).alias("low"), (r / m).alias("high")).alias("_try"))
    best = sound.groupBy(key).agg(F.min("_try").alias("_best")).join(whole, F.col(key).eqNullSafe(F.col("_key")))
    return best.select(key, F.col("_best.p").alias("percentile"), F.col("_best.t").alias("threshold"), (F.col("_best.low") + F.col("_mean")).alias("low_mean"), (F.col("_best.high") + F.col("_mean")).alias("high_mean"))


def transitions(df: DataFrame, key: str, state: str, order: list[str], rows: int | None = None) -> DataFrame:
    """Shares of the next states after each state, over changes of state."""
    after = Series(df.select(key, state, *order), key, order, rows).framed(0, 1, _next=lambda w: F.lead(state).over(w)).rows
    counts = after.select(F.col(state).alias("a"), F.col("_next").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("a")))
