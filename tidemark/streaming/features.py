"""Streaming forms: the same columns as in batch, with watermarks and state by device."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(rows: DataFrame, key: str, time: str, value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count, mean, deviation, least and largest reading of each key and window. On a stream, rows later than `late` are dropped."""
    own = rows.withWatermark(time, late) if rows.isStreaming else rows
    found = own.groupBy(key, F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))
    return found.select(key, F.col("w.start").alias("start"), "n", "mean", "sd", "low", "high")


def sessions(rows: DataFrame, key: str, time: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Episodes of a key's rows less than `gap` apart. On a stream each is given once the watermark has passed it."""
    own = rows.withWatermark(time, late) if rows.isStreaming else rows
    found = own.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latched(rows: DataFrame, key: str, order: str, value: str, level: float, clear: float) -> DataFrame:
    """(key, order, alarm, dose) of each row: the latch of windows.threshold_alarm and the running sum, whose state goes on from batch to batch.
    Rows of a key must come in order from batch to batch; within a batch they are sorted."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on, total = state.get if state.exists else (0, 0.0)
        for part in [pd.concat(list(parts)).sort_values(order)]:
            alarms, doses = [], []
            for x in part[value]:
                on = 1 if x >= level else 0 if x < clear else on
                total += x
                alarms.append(on)
                doses.append(total)
            yield pd.DataFrame({key: part[key], order: part[order], "alarm": alarms, "dose": doses})
        state.update((on, total))

    types = dict(rows.dtypes)
    return rows.select(key, order, value).groupBy(key).applyInPandasWithState(run, f"{key} {types[key]}, {order} {types[order]}, alarm int, dose double", "alarm int, dose double", "append", GroupStateTimeout.NoTimeout)
