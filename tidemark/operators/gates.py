"""Gates: each check is a query that counts violations, and gives one row (key, check, violations) for each key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import lookups, sliced, windows
from tidemark.operators.sliced import Series


def counted(df: DataFrame, key: str, **checks: Column) -> DataFrame:
    """Rows of each key for which a check's column is true, one row for each check."""
    sums = df.groupBy(key).agg(*(F.count(F.when(c, 1)).alias(n) for n, c in checks.items()))
    return sums.select(key, F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in checks))))


def out_of_range(x: Column, low: float, high: float) -> Column:
    """Not a finite number within the bounds."""
    return F.coalesce(F.isnan(x) | (x < low - 1e-9) | (x > high + 1e-9), F.lit(True))


def off_grid(x: Column, resolution: float, low: float, high: float) -> Column:
    """Neither a multiple of the resolution nor at a bound."""
    n = x / resolution
    return ~((F.abs(n - F.rint(n)) < 1e-6 + 1e-9 * F.abs(n)) | (x == low) | (x == high))


def timestamps(log: DataFrame, key: str, tick: str, gaps: DataFrame, start: str, end: str, span: int = 64) -> DataFrame:
    """Ticks between a key's first and last without a row and outside all announced gaps, rows inside a gap, and repeated ticks."""
    seen = log.groupBy(key, tick).agg(F.count(F.lit(1)).alias("_n"))
    grid = seen.groupBy(key).agg(F.min(tick).alias("_a"), F.max(tick).alias("_b")).select(key, "_b", F.explode(F.sequence("_a", "_b", F.lit(4096))).alias("_from"))
    grid = grid.select(key, F.explode(F.sequence("_from", F.least("_b", F.col("_from") + 4095))).alias(tick))
    missing = lookups.outside(grid.join(seen, [key, tick], "left_anti"), gaps, key, tick, start, end, span)
    marks = [(missing, "missing", F.lit(1)), (seen, "repeated", F.col("_n") - 1)]
    inside = seen.select(key, tick).join(lookups.outside(seen, gaps, key, tick, start, end, span).select(key, tick), [key, tick], "left_anti")
    marks.append((inside, "inside_gap", F.lit(1)))
    parts = [df.select(key, F.lit(name).alias("rule"), n.cast("long").alias("violations")) for df, name, n in marks]
    parts += [log.select(key).distinct().select(key, F.lit(name).alias("rule"), F.lit(0).cast("long").alias("violations")) for _, name, _ in marks]
    return reduce(DataFrame.unionByName, parts).groupBy(key, "rule").agg(F.sum("violations").alias("violations"))


def alarm(log: DataFrame, key: str, order: list[str], value: str, reported: str, level: float, hysteresis: float = 0.0, above: bool = True, latching: bool = False, seconds: str | None = None, gap: float = 0.0, rows: int | None = None) -> DataFrame:
    """Rows whose reported alarm (1 or 0) isn't the latch's. At the first row, and where `seconds` is named after every gap longer than `gap`, the latch
    starts anew: a reading between the levels leaves it as it is reported there, since what was before isn't known."""
    x = F.col(value)
    on, off = (x >= level, x < level - hysteresis) if above else (x <= level, x > level + hysteresis)
    anew = lambda w: F.lag(F.lit(1)).over(w).isNull() | (F.coalesce(F.col(seconds) - F.lag(seconds).over(w) > gap, F.lit(False)) if seconds else F.lit(False))
    own = Series(log, key, order, rows).framed(1, _anew=anew)
    marks = F.when(on, 1).when(F.col("_anew"), F.when(off, 0).otherwise(F.col(reported)))
    marks = marks if latching else marks.when(off, 0)
    return counted(own.running(_state=sliced.last(marks)).rows, key, alarm=F.col("_state") != F.col(reported))


def exposure(log: DataFrame, key: str, tick: str, value: str, reported: str, width: int, low: float, high: float, resolution: float) -> DataFrame:
    """Rows whose reported mean over `width` ticks isn't exact where no tick is missing, or beyond the bounds where one is."""
    bounds = windows.gap_bounds(log, key, tick, value, width, low, high)
    y, near = F.col(reported), resolution / 2 + 1e-9
    return counted(bounds, key, stel_exact=(F.col("missing") == 0) & (F.abs(y - F.col("mean_low")) > near), stel_bounded=(F.col("missing") > 0) & ((y < F.col("mean_low") - near) | (y > F.col("mean_high") + near)))


def dose(log: DataFrame, key: str, tick: str, value: str, reported: str, share: float, low: float, high: float, resolution: float) -> DataFrame:
    """Rows whose reported dose (the running sum times `share`) is off within a run without gaps, and gaps across which it grows by what no readings could give."""
    own = windows.dose_segments(log, key, tick, value, reported, value).framed(1, _before=lambda w: F.lag(reported).over(w)).rows
    y = F.col(reported)
    expected = F.when(F.col("segment") == 0, F.col("inside") * share).otherwise(F.col(f"{reported}_first") + (F.col("inside") - F.col(f"{value}_first")) * share)
    jump, least, most = y - F.col("_before"), (F.col(value) + low * F.col("gap")) * share, (F.col(value) + high * F.col("gap")) * share
    return counted(own, key, twa_segment=F.abs(y - expected) > F.when(F.col("segment") == 0, resolution / 2).otherwise(resolution) + 1e-9, twa_jump=(F.col("gap") > 0) & ((jump < least - resolution - 1e-9) | (jump > most + resolution + 1e-9)))


def cause(log: DataFrame, key: str, order: list[str], seconds: str, alarm_on: Column, event_on: Column, within: float) -> DataFrame:
    """Alarm rows without an event in the last `within` seconds, and alarm rows without any event so far."""
    own = Series(log.withColumn("_on", alarm_on), key, order).running(_last=sliced.last(F.when(event_on, F.col(seconds)))).rows
    return counted(own, key, no_recent_cause=F.col("_on") & F.coalesce(F.col(seconds) - F.col("_last") >= within, F.lit(True)), no_cause=F.col("_on") & F.col("_last").isNull())


def bumps(log: DataFrame, key: str, order: list[str], testing: str, channels: dict[str, tuple[float, float, float]], before: int = 30, rows: int | None = None) -> DataFrame:
    """Runs of `testing` rows in which some channel doesn't move first at the run's own first row, counted by key, and keys without any run.

    channels: (clean reading, reading of the mixture, resolution) of each column. It has moved where it is on the mixture's side of the clean reading by more than a twentieth of the way, two
    resolutions at least; rows from `before` ahead of the run to its end are looked at.
    """
    own = windows.run_id(Series(log, key, order, rows), "_run", testing).running(_i=sliced.number())
    runs = own.rows.where(testing).groupBy(key, "_run").agg(F.min("_i").alias("_s"), (F.max("_i") + 1).alias("_e")).withColumn("_a", F.greatest(F.lit(1), F.col("_s") - before))
    moved = {c: (1 if mix > clean else -1) * (F.col(c) - clean) > max(2 * step, 0.05 * abs(mix - clean)) for c, (clean, mix, step) in channels.items()}
    met = lookups.within(own.rows.select(key, "_i", *channels), runs, key, "_i", "_a", "_e", max(64, before))
    onsets = met.groupBy(key, "_run", "_s").agg(*(F.min(F.when(m, F.col("_i"))).alias(f"_{c}") for c, m in moved.items()))
    late = reduce(lambda a, b: a | b, (~F.col(f"_{c}").eqNullSafe(F.col("_s")) for c in channels))
    found = log.select(F.col(key).alias("_key")).distinct().join(onsets.withColumn("_late", late), F.col("_key").eqNullSafe(F.col(key)), "left").groupBy("_key")
    counts = found.agg(F.count(F.when(F.col("_late"), 1)).alias("bump_late"), F.when(F.count("_run") == 0, 1).otherwise(0).cast("long").alias("bump_missing"))
    return counts.select(F.col("_key").alias(key), F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in ("bump_late", "bump_missing")))))


def roll_up(checks: DataFrame, key: str) -> DataFrame:
    """One row for each key: whether all checks passed, how many failed, and their names in order."""
    failed = F.col("violations") > 0
    return checks.groupBy(key).agg((F.count(F.when(failed, 1)) == 0).alias("passed"), F.count(F.when(failed, 1)).alias("n_failed"), F.array_join(F.array_sort(F.collect_list(F.when(failed, F.col("rule")))), ",").alias("failed"))


def pass_matrix(checks: DataFrame, row: Column, column: str, columns: list) -> DataFrame:
    """For each row and value of the column (the columns named), the share of checks that passed."""
    return checks.groupBy(row.alias("row")).pivot(column, columns).agg(F.avg((F.col("violations") == 0).cast("int")))
