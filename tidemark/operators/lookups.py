"""Joins of series in time: as-of, interpolation, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import sliced
from tidemark.operators.sliced import Series


def as_of(queries: DataFrame, samples: DataFrame, key: str, time: str, value: str, clip: bool = False, rows: int | None = None) -> DataFrame:
    """queries with the last value of samples at or before each time; before the first sample that one's (`clip`), or null.

    Both are put in one ordered series by key, so there is one shuffle and no join that grows with
    the product. Of samples at one time the one that sorts last counts.
    """
    both = queries.withColumn("_value", F.lit(None).cast(samples.schema[value].dataType)).withColumn("_query", F.lit(1)).unionByName(
        samples.select(key, time, F.col(value).alias("_value"), F.lit(0).alias("_query")), allowMissingColumns=True)
    found = Series(both, key, [time, "_query", "_value"], rows).running(_held=sliced.last(F.col("_value")), _next=sliced.upcoming(F.col("_value"))).rows.where("_query = 1")
    return found.withColumn(value, F.coalesce("_held", "_next") if clip else F.col("_held")).drop("_value", "_query", "_held", "_next")


def aligned(left: DataFrame, right: DataFrame, key: str, order: list[str], rows: int | None = None) -> DataFrame:
    """Rows of both sides that have the same number within their key, in order: (key, i, left, right), each side a struct of its other columns, null where the other is longer."""
    def side(df: DataFrame, name: str) -> DataFrame:
        own = Series(df, key, order, rows).running(_i=sliced.number()).rows
        return own.select(F.col(key).alias(f"_{name}_key"), F.col("_i").alias(f"_{name}_i"), F.struct(*(c for c in df.columns if c != key)).alias(name))

    both = side(left, "left").join(side(right, "right"), F.col("_left_key").eqNullSafe(F.col("_right_key")) & (F.col("_left_i") == F.col("_right_i")), "full")
    return both.select(F.coalesce("_left_key", "_right_key").alias(key), F.coalesce("_left_i", "_right_i").alias("i"), "left", "right")


def following(queries: DataFrame, samples: DataFrame, key: str, time: str, value: str, rows: int | None = None, at: bool = False) -> DataFrame:
    """queries with the value of the first sample strictly after each time (at: or at it), or null."""
    both = queries.withColumn("_query", F.lit(1)).unionByName(samples.select(key, time, F.col(value).alias("_value"), F.lit(2 if at else 0).alias("_query")), allowMissingColumns=True)
    return Series(both, key, [time, "_query", "_value"], rows).running(_next=sliced.upcoming(F.col("_value"))).rows.where("_query = 1").withColumn(value, F.col("_next")).drop("_value", "_query", "_next")


def neighbours(queries: DataFrame, samples: DataFrame, key: str, time: str, value: str, rows: int) -> DataFrame:
    """queries with the samples (t, v) at or before each time, `_a`, and at or after it, `_b`."""
    known = samples.select(key, time, F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_at"))
    both = queries.withColumn("_query", F.lit(1)).unionByName(known.withColumn("_query", F.lit(0)), allowMissingColumns=True)
    return Series(both, key, [time, "_query"], rows).running(_a=sliced.last(F.col("_at")), _b=sliced.upcoming(F.col("_at"))).rows.where("_query = 1").drop("_at", "_query")


def interpolated(queries: DataFrame, samples: DataFrame, key: str, time: str, value: str, rows: int | None = None) -> DataFrame:
    """queries with the value of samples at each time by linear interpolation, constant beyond the ends. time is a number."""
    a, b = F.col("_a"), F.col("_b")
    share = (F.col(time) - a["t"]) / (b["t"] - a["t"])
    line = F.when(a["t"] == b["t"], a["v"]).when(a["t"] == F.col(time), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * share)
    return neighbours(queries, samples, key, time, value, rows).withColumn(value, F.coalesce(line, a["v"], b["v"])).drop("_a", "_b")


def nearest(queries: DataFrame, samples: DataFrame, key: str, time: str, value: str, rows: int | None = None) -> DataFrame:
    """queries with the value of the sample nearest in time, the earlier of two equally near. time is a number."""
    a, b = F.col("_a"), F.col("_b")
    near = F.when(a.isNull() | (b["t"] - F.col(time) < F.col(time) - a["t"]), b["v"]).otherwise(a["v"])
    return neighbours(queries, samples, key, time, value, rows).withColumn(value, near).drop("_a", "_b")


def outside(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str, span: int) -> DataFrame:
    """Points in no interval [start, end) of their key."""
    cut = intervals.where(F.col(end) > F.col(start)).select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / span), F.floor((F.col("_e") - 1) / span))))
    meets = (F.col(key) == F.col("_k")) & (F.floor(F.col(time) / span) == F.col("_b")) & (F.col(time) >= F.col("_s")) & (F.col(time) < F.col("_e"))
    return points.join(cut, meets, "left_anti")


def within(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str, span: int) -> DataFrame:
    """Pairs of points and intervals [start, end) of one key. time, start and end are whole numbers.

    Intervals are dealt to buckets of `span`, so the join is an equi-join and its work follows the pairs that meet.
    """
    cut = intervals.where(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / span), F.floor((F.col(end) - 1) / span))))
    own = points.withColumn("_bucket", F.floor(F.col(time) / span))
    return own.join(cut, [key, "_bucket"]).where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_bucket")
