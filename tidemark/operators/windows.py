"""Windowed logic over ordered series: exposure, rates, runs, latches.

Functions of a Series give it back with a column more; they need no series whole in one task. Functions of a window are for Series.framed().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators import sliced
from tidemark.operators.sliced import Series


def exposure_mean(x: Column, over: WindowSpec, width: int) -> Column:
    """Sum of the last `width` readings by the full width: what is before the start counts as zero."""
    return F.sum(x).over(over.rowsBetween(1 - width, 0)) / width


def dose(s: Series, name: str, x: Column, dt: float, period: float) -> Series:
    return s.running(**{name: sliced.total(x)}).with_columns(**{name: F.col(name) * dt / period})


def rate_of_change(x: Column, over: WindowSpec, width: int, dt: float, per: float) -> Column:
    """0 for the first rows."""
    return F.coalesce((x - F.lag(x, width).over(over)) / (width * dt) * per, F.lit(0.0))


def centred(width: int, over: WindowSpec) -> WindowSpec:
    """A centred frame; of an even one the extra row is before."""
    return over.rowsBetween(-(width // 2), (width - 1) // 2)


def run_id(s: Series, name: str, state: str) -> Series:
    """Number of the run of equal states, null states included."""
    changed = s.framed(1, **{name: lambda w: F.when(F.row_number().over(w) == 1, 1).when(F.col(state).eqNullSafe(F.lag(state).over(w)), 0).otherwise(1)})
    return changed.running(**{name: sliced.total(F.col(name))})


def latch(s: Series, name: str, trigger: Column, clear: Column, latching: bool = False, on: object = 1, off: object = 0) -> Series:
    """`on` from a trigger to a clear (a latching one never clears), and so on; `off` before."""
    marks = F.when(trigger, 1) if latching else F.when(trigger, 1).when(clear, 0)
    return s.running(**{name: sliced.last(marks)}).with_columns(**{name: F.when(F.col(name) == 1, on).otherwise(off)})


def threshold_alarm(s: Series, name: str, x: Column, level: float, above: bool = True, hysteresis: float = 0.0, latching: bool = False, on: object = 1, off: object = 0) -> Series:
    """On at or beyond the level, off again strictly beyond the hysteresis on the other side."""
    trigger, clear = (x >= level, x < level - hysteresis) if above else (x <= level, x > level + hysteresis)
    return latch(s, name, trigger, clear, latching, on, off)


def unwrapped_sign(s: Series, name: str, flip: Column) -> Series:
    """1 or -1: the sign by which a series of quaternions becomes continuous, from rotation.flips()."""
    return s.running(**{name: sliced.total(flip)}).with_columns(**{name: F.when(F.col(name) % 2 == 1, -1.0).otherwise(1.0)})


def since(s: Series, name: str, moving: Column, seconds: Column, dt: float) -> Series:
    """Seconds of stillness: 0 while moving, dt at the first still row; before any movement counted from the first row."""
    own = s.running(_last=sliced.last(F.when(moving, seconds)), _start=sliced.first(seconds))
    return own.same(own.df.withColumn(name, F.coalesce(seconds - F.col("_last"), seconds - F.col("_start") + dt)).drop("_last", "_start"))


def moving(axes: list[Column], over: WindowSpec, width: int, threshold: float) -> Column:
    """Whether the largest standard deviation of the axes over the last `width` rows is over the threshold."""
    frame = over.rowsBetween(1 - width, 0)
    sd = [deviation(F.collect_list(a).over(frame)) for a in axes]
    return (F.greatest(*sd) if len(sd) > 1 else sd[0]) > threshold


def deviation(xs: Column) -> Column:
    """Population deviation of an array by Welford's recurrence in the array's order, as engines of SQL compute it: where it is a threshold's very value, the last bit decides on which side it is."""
    zero = F.lit(0.0)

    def step(a: Column, x: Column) -> Column:
        mean = a["mean"] + (x - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("mean"), (a["m2"] + (x - mean) * (x - a["mean"])).alias("m2"))

    return F.aggregate(F.transform(xs, lambda x: x.cast("double")), F.struct(zero.alias("n"), zero.alias("mean"), zero.alias("m2")), step, lambda a: F.sqrt(a["m2"] / F.nullif(a["n"], zero)))


def stillness(still: Column, detect: float, pre_alarm: float) -> Column:
    return F.when(still >= detect + pre_alarm, "alert").when(still >= detect, "pre_alarm").otherwise("ok")


def gap_bounds(log: DataFrame, key: str, tick: str, value: str, width: int, low: float, high: float, rows: int | None = None) -> DataFrame:
    """log (one row for each key and tick there is) with the bounds `mean_low`, `mean_high` of the mean over the last `width` ticks and the number
    `missing` of ticks in it without a row: what is missing lies between low and high, what is before the first row is 0."""
    frame = lambda w: w.rangeBetween(1 - width, 0)
    own = Series(log, key, [tick], rows).framed(width - 1, _known=lambda w: F.sum(value).over(frame(w)), _have=lambda w: F.count(value).over(frame(w))).running(_first=sliced.first(F.col(tick)))
    missing = F.least(F.col(tick) - F.col("_first") + 1, F.lit(width)) - F.col("_have")
    out = own.rows.withColumn("missing", missing)
    return out.select(*log.columns, "missing", ((F.col("_known") + low * F.col("missing")) / width).alias("mean_low"), ((F.col("_known") + high * F.col("missing")) / width).alias("mean_high"))


def dose_segments(log: DataFrame, key: str, tick: str, value: str, *held: str, rows: int | None = None) -> Series:
    """log with the number `segment` of the gapless run of ticks, `gap` (ticks missing before the row), `inside`, the sum from its run's first row on,
    and for each column held its value at the run's first row, "<name>_first"."""
    own = Series(log, key, [tick], rows).framed(1, gap=lambda w: F.coalesce(F.col(tick) - F.lag(tick).over(w) - 1, F.lit(0)), _new=lambda w: F.lag(tick).over(w).isNull() | (F.col(tick) - F.lag(tick).over(w) > 1))
    own = own.running(segment=sliced.total((F.col("gap") > 0).cast("int")), _all=sliced.total(F.col(value)))
    start = {f"{c}_first": sliced.last(F.when(F.col("_new"), F.col(c))) for c in held}
    own = own.running(_before=sliced.last(F.when(F.col("_new"), F.col("_all") - F.col(value))), **start)
    own = own.with_columns(inside=F.col("_all") - F.col("_before"))
    return own.same(own.df.drop("_new", "_all", "_before"))


def rolling_deviation(x: Column, over: WindowSpec, width: int) -> Column:
    """Sample deviation over the last `width` rows; null where it has fewer than max(2, width // 2)."""
    frame = over.rowsBetween(1 - width, 0)
    return F.when(F.count(x).over(frame) >= max(2, width // 2), F.stddev_samp(x).over(frame))


def held(s: Series, column: str, every: int, floor: float) -> DataFrame:
    """column filled backwards, at least `floor`, and held for `every` rows each."""
    own = s.running(_filled=sliced.upcoming(F.col(column)), _i=sliced.number()).with_columns(_block=F.floor((F.col("_i") - 1) / every))
    block = Window.partitionBy(s.key, "_block").orderBy("_i")
    return own.rows.withColumn(column, F.first(F.greatest("_filled", F.lit(floor))).over(block)).drop("_filled", "_i", "_block")


def episodes(df: DataFrame, key: str, start: str, end: str, apart: float, rows: int | None = None) -> DataFrame:
    """Intervals of a key less than `apart` from the end of all before them, merged: key, episode, start, end, n."""
    own = Series(df, key, [start, end], rows).running(_reach=sliced.highest(F.col(end))).framed(1, _reach_before=lambda w: F.lag("_reach").over(w))
    new = F.when(F.col("_reach_before").isNull() | (F.col(start) - F.col("_reach_before") >= apart), 1).otherwise(0)
    return own.running(episode=sliced.total(new)).rows.groupBy(key, "episode").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"))


def runs(s: Series, state: str) -> DataFrame:
    """One row for each run of a state: key, run, state, first, last, n."""
    time = s.order[0]
    return run_id(s, "run", state).rows.groupBy(s.key, "run").agg(F.first(state).alias(state), F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))
