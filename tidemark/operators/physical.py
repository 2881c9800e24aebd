"""Physical plausibility of motion logs: orientation, gravity and turning rate have to fit each other, and a reference recording."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rotation
from tidemark.operators import statistics
from tidemark.operators.sliced import Series
from tidemark.operators.staging import settled

# Bounds of the checks.
WIDTH_TOLERANCE, GRAVITY_DEGREES, RATE_TOLERANCE, JUMP, FLIP, MOVING = 1e-3, 2.0, 0.25, 0.3, 0.1, 3.0


def squared(q: str) -> Column:
    """Of the last three components: over 1 there is no such rotation."""
    return sum((F.coalesce(F.col(f"{q}.{c}"), F.lit(0.0)) ** 2 for c in "yz"), F.coalesce(F.col(f"{q}.x"), F.lit(0.0)) ** 2)


def length(v: str) -> Column:
    return F.sqrt(F.col(f"{v}.x") ** 2 + F.col(f"{v}.y") ** 2 + F.col(f"{v}.z") ** 2)


def steps(log: Series, seconds: str, q: str) -> Series:
    """log with `dt` (since the row before), `degrees` turned, and `jump`: whether a component changes by more than 0.3 though the step isn't a change of sign."""
    part = lambda w, c: (F.col(f"{q}.{c}"), F.lag(f"{q}.{c}").over(w))

    def jump(w):  # noqa: ANN001, ANN202
        pairs = [part(w, c) for c in "xyz"]
        big = reduce(lambda a, b: a | b, (F.abs(x - y) > JUMP for x, y in pairs))
        return big & ~reduce(lambda a, b: a & b, (F.abs(x + y) < FLIP for x, y in pairs))

    return log.framed(1, dt=lambda w: F.col(seconds) - F.lag(seconds).over(w), degrees=lambda w: rotation.angle_degrees(F.col(q), F.lag(q).over(w)), jump=lambda w: F.coalesce(jump(w), F.lit(False)))


def rates(log: Series, seconds: str, q: str, rows: int | None = None) -> DataFrame:
    """steps() with `regular` (no more than twice the key's median step) and `rate` in degrees a second, null on irregular steps."""
    key, stepped = log.key, steps(log, seconds, q).at_hand()
    own = stepped.rows
    usual = statistics.quantiles(own.where("dt > 0"), key, "dt", {"_usual": 0.5}, rows).withColumnRenamed(key, "_key")
    own = own.join(stepped.beside(usual), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    own = own.withColumn("regular", F.coalesce((F.col("dt") > 0) & (F.col("dt") <= 2 * F.col("_usual")), F.lit(False)))
    return own.withColumn("rate", F.when(F.col("regular"), F.col("degrees") / F.col("dt"))).drop("_usual")


def quiet(log: Series, accel: str, width: int = 20, absolute: bool = False, rows: int | None = None) -> DataFrame:
    """log with `quiet`: the acceleration is near 1 and steadier than half of the key's rows are (absolute: nearer 1, and steadier than 0.01)."""
    key, calm = log.key, log.with_columns(_size=length(accel)).framed(width // 2, width // 2, _steady=lambda w: F.when(F.count("_size").over(w.rowsBetween(-(width // 2), (width - 1) // 2)) > 1, F.stddev_samp("_size").over(w.rowsBetween(-(width // 2), (width - 1) // 2)))).at_hand()
    own = calm.rows
    near = F.abs(F.col("_size") - 1)
    if absolute:
        return own.withColumn("quiet", F.coalesce((near < 0.02) & (F.col("_steady") < 0.01), F.lit(False))).drop("_size", "_steady")
    half = statistics.quantiles(own.where("_size is not null and _steady is not null"), key, "_steady", {"_half": 0.5}, rows).withColumnRenamed(key, "_key")
    own = own.join(calm.beside(half), F.col(key).eqNullSafe(F.col("_key")), "left")
    return own.withColumn("quiet", F.coalesce((near < 0.05) & (F.col("_steady") < F.col("_half")), F.lit(False))).drop("_size", "_steady", "_half", "_key")


def resting(log: Series, rate: str, accel: str) -> Series:
    """log with `rest` and `moving`, by the median of ten rows' rates around each, and an acceleration near 1 for rest."""
    middle = lambda w: F.percentile(rate, F.lit(0.5)).over(w.rowsBetween(-5, 4))
    own = log.framed(5, 4, _middle=middle).with_columns(moving=F.coalesce(F.col("_middle") >= MOVING, F.lit(False)), rest=F.coalesce((F.col("_middle") < MOVING) & (F.abs(length(accel) - 1) < 0.05), F.lit(False)))
    return own.same(own.df.drop("_middle"))


def tilted(q: str, accel: str) -> Column:
    """Degrees between the acceleration and where the orientation has the vertical."""
    cosine = rotation.once(F.struct(rotation.gravity(F.col(q)).alias("g"), F.col(accel).alias("a")), lambda s: sum((s["g"][c] * s["a"][c] for c in "yz"), s["g"]["x"] * s["a"]["x"]) / F.sqrt(s["a"]["x"] ** 2 + s["a"]["y"] ** 2 + s["a"]["z"] ** 2))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def gate(log: DataFrame, reference: DataFrame, key: str, order: list[str], seconds: str, q: str, accel: str, copies: DataFrame | None = None, most_copied: float = 5.0, rows: int | None = None) -> DataFrame:
    """(key, rule, value, low, high, passed) of each key and check, against the reference of the same key:

    validity: percent of rows that are no rotation; gravity: median degrees between acceleration and vertical on quiet rows; rate: 99th percentile of the turning
    rate, by a quarter around the reference's; jumps: one-row jumps of the orientation; gap_jumps: jumps over gaps that turn faster than the reference's 99th
    percentile and a quarter; copy: percent of windows that are copied, from copies.copied(). A value that can't be had (no quiet row, no step) is null and fails.
    """
    series = Series(log, key, order, rows)
    own, ref, log = rates(series, seconds, q, rows), rates(Series(reference, key, order, rows), seconds, q, rows), series.rows
    usual = settled(statistics.quantiles(ref.where("rate is not null"), key, "rate", {"_usual": 0.99}, rows))
    fast = statistics.quantiles(own.where("rate is not null"), key, "rate", {"value": 0.99}, rows)
    calm = statistics.quantiles(quiet(series, accel, rows=rows).where("quiet").select(key, tilted(q, accel).alias("_tilt")).where("_tilt is not null"), key, "_tilt", {"value": 0.5}, rows)
    wide = log.groupBy(key).agg((100 * F.avg((squared(q) > 1 + WIDTH_TOLERANCE).cast("int"))).alias("value"))
    limits = own.join(series.beside(usual.withColumnRenamed(key, "_key")), F.col(key).eqNullSafe(F.col("_key")), "left")
    beyond = F.col("jump") & ~F.col("regular") & (F.col("degrees") / F.greatest("dt", F.lit(1e-3)) > F.col("_usual") * (1 + RATE_TOLERANCE))
    jumps = limits.groupBy(key).agg(F.count(F.when(F.col("jump") & F.col("regular"), 1)).cast("double").alias("a"), F.count(F.when(beyond, 1)).cast("double").alias("b"))
    none, usual = F.lit(None).cast("double"), usual.withColumnRenamed(key, "_key")
    parts = [
        wide.select(key, F.lit("validity").alias("rule"), "value", none.alias("low"), F.lit(0.0).alias("high")),
        calm.select(key, F.lit("gravity").alias("rule"), "value", none.alias("low"), F.lit(GRAVITY_DEGREES).alias("high")),
        fast.join(usual, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.lit("rate").alias("rule"), "value", (F.col("_usual") * (1 - RATE_TOLERANCE)).alias("low"), (F.col("_usual") * (1 + RATE_TOLERANCE)).alias("high")),
        jumps.select(key, F.lit("jumps").alias("rule"), F.col("a").alias("value"), none.alias("low"), F.lit(0.0).alias("high")),
        jumps.select(key, F.lit("gap_jumps").alias("rule"), F.col("b").alias("value"), none.alias("low"), F.lit(0.0).alias("high")),
    ]
    if copies is not None:
        parts.append(copies.select(key, F.lit("copy").alias("rule"), F.col("percent").alias("value"), none.alias("low"), F.lit(most_copied).alias("high")))
    rules = ["validity", "gravity", "rate", "jumps", "gap_jumps", *(["copy"] if copies is not None else [])]
    every = log.select(F.col(key).alias("_key")).distinct().select("_key", F.explode(F.array(*map(F.lit, rules))).alias("_rule"))
    found = every.join(reduce(DataFrame.unionByName, parts), F.col("_key").eqNullSafe(F.col(key)) & (F.col("_rule") == F.col("rule")), "left")
    strict = F.when(F.col("_rule") == "gravity", F.col("value") < F.col("high")).otherwise(F.col("value") <= F.col("high"))
    passed = F.coalesce(strict & F.coalesce(F.col("value") >= F.col("low"), F.col("_rule") != "rate"), F.lit(False))
    return found.select(F.col("_key").alias(key), F.col("_rule").alias("rule"), "value", "low", "high", passed.alias("passed"))
