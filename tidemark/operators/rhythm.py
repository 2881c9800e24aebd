"""Appliances that switch: phases of a noisy series, how long they last, and logs that are kept only around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import sliced, statistics, windows
from tidemark.operators.sliced import Series
from tidemark.operators.staging import settled


def phases(df: DataFrame, key: str, order: list[str], value: str, width: int, vote: int, rows: int | None = None) -> DataFrame:
    """df with `state` ("on", "off", or "unknown" where there is nothing to tell it from) and the cut: `threshold`, `low_mean`, `high_mean`.

    A row is on where the centred deviation of `width` rows is over Otsu's threshold of the key, and then as the majority of the `vote` rows around it, a tie being
    off. A key that has no threshold (fewer than 100 deviations, or no part of ten) is left out.
    """
    whole = lambda w: windows.centred(width, w)
    own = Series(df, key, order, rows).framed(width // 2, (width - 1) // 2, _noise=lambda w: F.when(F.count(value).over(whole(w)) == width, F.stddev_samp(value).over(whole(w))))
    own = own.same(settled(own.df))
    own.ready = True
    cuts = statistics.otsu(own.rows, key, "_noise", rows=rows).drop("percentile").withColumnRenamed(key, "_key")
    enough = own.rows.groupBy(F.col(key).alias("_ekey")).agg(F.count("_noise").alias("_n")).where("_n >= 100").drop("_n")
    cuts = settled(cuts.join(enough, F.col("_key").eqNullSafe(F.col("_ekey"))).drop("_ekey"))
    cut = own.same(own.df.join(own.beside(cuts), F.col(key).eqNullSafe(F.col("_key"))).drop("_key").withColumn("_on", F.when(F.col("_noise") > F.col("threshold"), 1.0).when(F.col("_noise").isNotNull(), 0.0)), ready=own.is_cut)
    voted = cut.framed(vote // 2, (vote - 1) // 2, _share=lambda w: F.avg("_on").over(windows.centred(vote, w)))
    state = F.when(F.col("_share").isNull(), "unknown").when(F.col("_share") > 0.5, "on").otherwise("off")
    return voted.at_hand().rows.withColumn("state", state).drop("_noise", "_on", "_share")


def durations(df: DataFrame, key: str, time: str, state: str, gap: float = 60.0, least: float = 30.0, also: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """(key, state, start, seconds): phases one after another, in seconds of the clock, those of more than `least`. A gap of more than `gap` between rows is an off phase;
    what lies next to another phase of the same state is one with it. also: what orders rows of one time."""
    own = Series(df.select(key, time, state, *(also or [])), key, [time, *(also or [])], rows).framed(1, _before=lambda w: F.lag(time).over(w), _was=lambda w: F.lag(state).over(w))
    jump = F.coalesce(F.col(time) - F.col("_before") > gap, F.lit(False))
    begins = F.array(F.when(jump, F.struct(F.col("_before").alias("start"), F.lit(1).alias("after"), F.lit("off").alias("s"))), F.when(F.col("_before").isNull() | jump | ~F.col(state).eqNullSafe(F.col("_was")), F.struct(F.col(time).alias("start"), F.lit(0).alias("after"), F.col(state).alias("s"))))
    # Two phases can begin at one time: a row's, and the gap behind it.
    events = own.rows.select(key, F.explode(F.filter(begins, lambda x: x.isNotNull())).alias("_e")).select(key, "_e.start", "_e.after", F.col("_e.s").alias("state"))
    events = settled(events) if own.is_cut else events
    ran = windows.run_id(Series(events, key, ["start", "after"], rows), "_run", "state").rows.groupBy(key, "_run").agg(F.min("start").alias("start"), F.first("state").alias("state"))
    ends = df.groupBy(F.col(key).alias("_key")).agg(F.max(time).alias("_end"))
    next_start = Series(ran, key, ["_run"], rows).framed(0, 1, _next=lambda w: F.lead("start").over(w)).rows
    out = next_start.join(ends, F.col(key).eqNullSafe(F.col("_key"))).select(key, "state", "start", (F.coalesce("_next", "_end") - F.col("start")).alias("seconds"))
    return out.where(F.col("seconds") > least)


def robust(df: DataFrame, key: str, value: str, rounds: int = 5, share: float = 0.25, floor: float = 0.05) -> DataFrame:
    """(key, n, middle, spread): the median after values under `share` of it have been dropped, anew until none is or `rounds` are over, and 1.4826 times the median distance
    from it, `floor` of the median at least. n counts all values. Each round is a grouped rank of what is left."""
    total, left = df.groupBy(F.col(key).alias("_key")).agg(F.count(value).alias("n")), settled(df.where(F.col(value).isNotNull()).select(key, value))
    for _ in range(rounds):
        cut = statistics.quantiles(left, key, value, {"_m": 0.5}).withColumnRenamed(key, "_ckey")
        kept = settled(left.join(cut, F.col(key).eqNullSafe(F.col("_ckey"))).where(F.col(value) >= share * F.col("_m")).select(key, value))
        same, left = kept.count() == left.count(), kept
        if same:
            break
    middle = statistics.quantiles(left, key, value, {"middle": 0.5})
    spread = statistics.mad(left, key, value).withColumnRenamed(key, "_mkey")
    out = middle.join(spread, F.col(key).eqNullSafe(F.col("_mkey"))).join(total, F.col(key).eqNullSafe(F.col("_key")))
    return out.select(key, "n", "middle", F.greatest("mad", floor * F.col("middle")).alias("spread"))


def rhythm(df: DataFrame, key: str, order: list[str], value: str, width: int, vote: int, least_ratio: float = 1.5, most_apart: float = 10.0, rows: int | None = None) -> DataFrame:
    """(key, threshold, ratio, on_n, on_seconds, on_spread, off_n, off_seconds, off_spread) of each key that has a rhythm; the time, first in order, in seconds.

    A rhythm has noise in its on phases of `least_ratio` times that in its off phases or more, three phases of each kind, and medians no more than `most_apart` times from each other.
    Spreads are half of the median at most.
    """
    found = settled(phases(df, key, order, value, width, vote, rows))
    cuts = found.groupBy(F.col(key).alias("_key")).agg(F.first("threshold").alias("threshold"), (F.first("high_mean") / (F.first("low_mean") + 1e-10)).alias("ratio")).where(F.col("ratio") >= least_ratio)
    lasting = durations(found, key, order[0], "state", also=order[1:], rows=rows).where("state <> 'unknown'").select(F.struct(key, "state").alias("_of"), "seconds")
    stats = robust(lasting, "_of", "seconds").select(F.col(f"_of.{key}").alias(key), F.col("_of.state").alias("state"), "n", "middle", F.least("spread", F.col("middle") * 0.5).alias("spread"))
    of = lambda s, c, n: F.max(F.when(F.col("state") == s, F.col(c))).alias(n)
    both = stats.groupBy(key).agg(*(of(s, c, f"{s}_{n}") for s in ("on", "off") for c, n in (("n", "n"), ("middle", "seconds"), ("spread", "spread"))))
    apart = F.greatest("on_seconds", "off_seconds") / (F.least("on_seconds", "off_seconds") + 1e-10)
    return cuts.join(both.where((F.col("on_n") >= 3) & (F.col("off_n") >= 3) & (apart <= most_apart)), F.col(key).eqNullSafe(F.col("_key"))).select(key, "threshold", "ratio", *(f"{s}_{n}" for s in ("on", "off") for n in ("n", "seconds", "spread")))


def gated(df: DataFrame, key: str, order: list[str], off: str, lead: float = 45.0, tail: float = 45.0, rows: int | None = None) -> DataFrame:
    """Rows that a log keeps that is only written around activity: those not off, those less than `tail` after an off run began, and those less than `lead` before it
    ends, if a row that isn't off follows. off: a column of true and false; the time, first in order, in seconds."""
    time = order[0]
    own = Series(df, key, order, rows).framed(1, 1, _starts=lambda w: F.col(off) & ~F.coalesce(F.lag(off).over(w), F.lit(False)), _ends=lambda w: F.col(off) & ~F.coalesce(F.lead(off).over(w), F.lit(False)))
    own = own.running(_from=sliced.last(F.when(F.col("_starts"), F.col(time))), _to=sliced.upcoming(F.when(F.col("_ends"), F.col(time))), _later=sliced.upcoming(F.when(~F.col(off), F.lit(1))))
    keep = ~F.col(off) | (F.col(time) - F.col("_from") < tail) | (F.col("_later").isNotNull() & (F.col("_to") - F.col(time) < lead))
    return own.rows.where(keep).select(*df.columns)


def labelled(df: DataFrame, key: str, order: list[str], label: str, value: str, least: int = 20, rows: int | None = None) -> DataFrame:
    """(label, segments, seconds, spread, rows, mean, sd): what recordings say of each of their labels; the time, first in order, in seconds.

    Segments are runs of a label within a key, from first to last row, half a second at least; seconds is their median and spread 1.4826 times the median distance from it, a tenth
    of it at least. mean and sd are the value's over all rows of the label, null where it has fewer than `least`.
    """
    time = order[0]
    runs = windows.run_id(Series(df, key, order, rows), "_run", label).rows.groupBy(key, "_run").agg(F.first(label).alias(label), F.greatest((F.max(time) - F.min(time)).cast("double"), F.lit(0.5)).alias("_s"))
    runs = settled(runs)
    middle = statistics.quantiles(runs, label, "_s", {"seconds": 0.5}, rows)
    mad = statistics.mad(runs, label, "_s", rows).withColumnRenamed(label, "_mlabel")
    count = runs.groupBy(F.col(label).alias("_clabel")).agg(F.count(F.lit(1)).alias("segments"))
    enough = F.count(F.lit(1)) >= least
    values = df.groupBy(F.col(label).alias("_vlabel")).agg(F.count(F.lit(1)).alias("rows"), F.when(enough, F.avg(value)).alias("mean"), F.when(enough, F.stddev_pop(value)).alias("sd"))
    out = middle
    for other, name in ((mad, "_mlabel"), (count, "_clabel"), (values, "_vlabel")):
        out = out.join(other, F.col(label).eqNullSafe(F.col(name)))
    return out.select(label, "segments", "seconds", F.greatest("mad", F.col("seconds") / 10).alias("spread"), "rows", "mean", "sd")


def next_labels(df: DataFrame, key: str, order: list[str], label: str, rows: int | None = None) -> DataFrame:
    """(a, b, share): the chance that label b follows a, over changes of label; a label that nothing ever follows goes to the one with most segments (of equals the first by name)."""
    known = statistics.transitions(df, key, label, order, rows).select("a", "b", "share")
    runs = windows.run_id(Series(df, key, order, rows), "_run", label).rows.select(key, "_run", label).distinct()
    counts = settled(runs.groupBy(F.col(label).alias("a")).agg(F.count(F.lit(1)).alias("_n")))
    most = counts.agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("a").alias("b"))).alias("_m")).select(F.col("_m.b").alias("b"))  # one row
    last = counts.join(known.select("a").distinct(), "a", "left_anti").select("a").join(F.broadcast(most)).select("a", "b", F.lit(1.0).alias("share"))
    return known.unionByName(last)
