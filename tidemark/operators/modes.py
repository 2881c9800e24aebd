"""Modes of a device that an event begins and that last until readings are back where they were."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import lookups, sliced
from tidemark.operators.sliced import Series
from tidemark.operators.staging import settled


def until_back(log: DataFrame, key: str, order: list[str], value: str, events: DataFrame, start: str, end: str, resolution: float, rows: int | None = None) -> DataFrame:
    """log with `mode`: whether an event is on, from its first row (the time, first in order, at or after start) on, through its end, and until the value is back within `resolution` of what it
    was in the row before the event (in the first row, if there is none). An event whose value never comes back lasts to the end of its key's rows.

    events: (key, start, end). Where a value is back is looked up by its bucket of one resolution and the two beside it, in order of rows; a row there that is too far after all sends its event on
    to the next look, so each round handles all events that still search, and there are as many rounds as such rows in a line, mostly one.
    """
    time, named = order[0], log.columns
    own = Series(log, key, order, rows).running(_i=sliced.number())
    own = own.same(settled(own.df))
    lines = own.rows.select(key, F.col(time).alias("_t"), "_i", F.col(value).alias("_x"))
    asked = events.where(F.col(end) >= F.col(start)).select(F.col(key), F.col(start).alias("_t"), F.col(end).alias("_end")).distinct()
    asked = lookups.following(asked, lines, key, "_t", "_i", rows, at=True).where("_i is not null").select(key, F.col("_i").alias("_from"), F.col("_end").alias("_t"))
    asked = lookups.following(asked, lines, key, "_t", "_i", rows, at=True).select(key, "_from", F.col("_i").alias("_to"))
    before = lines.select(F.col(key).alias("_bkey"), F.col("_i").alias("_b"), F.col("_x").alias("_base"))
    search = asked.join(before, F.col(key).eqNullSafe(F.col("_bkey")) & (F.col("_b") == F.greatest(F.col("_from") - 1, F.lit(1)))).select(key, "_from", "_to", "_base")
    done, search = settled(search.where("_to is null or _base is null").select(key, "_from", F.lit(None).cast("long").alias("_back"))), settled(search.where("_to is not null and _base is not null"))
    bucket = lambda x: F.floor(x / resolution)
    places = lines.where("_x is not null").select(F.struct(F.col(key).alias("k"), bucket(F.col("_x")).alias("b")).alias("_at"), F.col("_i").alias("_to"), F.struct(F.col("_i").alias("i"), F.col("_x").alias("x")).alias("_hit"))
    while not search.isEmpty():
        each = search.withColumn("_b", F.explode(F.sequence(bucket(F.col("_base")) - 1, bucket(F.col("_base")) + 1))).select(F.struct(F.col(key).alias("k"), F.col("_b").alias("b")).alias("_at"), "_from", "_to", "_base")
        hits = lookups.following(each, places, "_at", "_to", "_hit", rows, at=True)
        first = settled(hits.groupBy(F.col("_at.k").alias(key), "_from", "_base").agg(F.min("_hit").alias("_hit")))
        near = F.col("_hit").isNull() | (F.abs(F.col("_hit.x") - F.col("_base")) <= resolution)
        done = settled(done.unionByName(first.where(near).select(key, "_from", F.col("_hit.i").alias("_back"))))
        search = settled(first.where(~near).select(key, "_from", (F.col("_hit.i") + 1).alias("_to"), "_base"))
    forever = F.lit((1 << 62)).cast("long")
    ends = done.groupBy(F.col(key).alias("_dkey"), F.col("_from").alias("_di")).agg(F.max(F.coalesce("_back", forever)).alias("_until"))
    marked = own.same(own.df.join(ends, F.col(key).eqNullSafe(F.col("_dkey")) & (F.col("_i") == F.col("_di")), "left").drop("_dkey", "_di")).running(_until=sliced.highest(F.col("_until")))
    return marked.rows.select(*named, F.coalesce(F.col("_i") < F.col("_until"), F.lit(False)).alias("mode"))
