"""Streams with event-time timers: rows in order of their time whatever order they come in, exposure with a ring buffer, alerts when nothing comes.

A row is handled once the watermark has passed it, so what arrives late but within the watermark's delay changes nothing, and the rows are the batch form's, but for
those the watermark hasn't passed yet. Rows later than that are dropped by Spark and counted: late_rows(). State is kept by key in the state store (RocksDB has to
be the provider, see needs_rocksdb()) and holds what is waiting, the last `width` readings, or the last times, never a whole series.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidemark.operators import sliced
from tidemark.operators.sliced import Series


def needs_rocksdb(spark: SparkSession) -> None:
    """Timers need this provider of state; it is a setting of the session, to be made before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, over all progress the query still remembers."""
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)


class InOrder(StatefulProcessor):
    """Exposure, dose and alarm of each row, in order of (time, tie), when the watermark passes it."""

    def __init__(self, width: int, level: float, clear: float, idle_ms: int) -> None:
        self.width, self.level, self.clear, self.idle_ms = width, level, clear, idle_ms

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, tie long, x double")
        self.known = handle.getValueState("known", "ring array<double>, dose double, alarm int, last long")

    def plan(self, rows: list) -> None:
        """One timer, at the first waiting row."""
        if rows:
            self.handle.registerTimer(min(r[0] for r in rows))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        new = [(int(m), int(t), float(x)) for part in rows for m, t, x in zip(part["ms"], part["tie"], part["x"], strict=True)]
        held = [tuple(r) for r in self.waiting.get()]
        self.waiting.appendList(new)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.plan([*held, *new])
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        ready, rest = sorted(r for r in held if r[0] <= passed), [r for r in held if r[0] > passed]
        if not ready and not rest:
            self.known.clear()  # nothing for so long that the device counts as new
            yield pd.DataFrame()
            return
        ring, dose, alarm, last = self.known.get() if self.known.exists() else ([], 0.0, 0, 0)
        ring, out = list(ring), []
        for ms, tie, x in ready:
            ring, dose, last = [*ring, x][-self.width :], dose + x, ms
            mean = sum(ring) / self.width
            alarm = 1 if mean >= self.level else 0 if mean < self.clear else alarm
            out.append((key[0], tie, mean, dose, alarm))
        self.known.update((ring, dose, alarm, last))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self.plan(rest or [(last + self.idle_ms,)])
        yield pd.DataFrame(out, columns=["key", "tie", "mean", "dose", "alarm"])

    def close(self) -> None:
        pass


def exposures(rows: DataFrame, key: str, time: str, tie: str, value: str, width: int, level: float, clear: float, late: str = "1 day", idle: float = 30 * 86400.0) -> DataFrame:
    """(key, tie, mean, dose, alarm) of each row: the mean of the last `width` readings, their running sum, and the alarm on the mean with hysteresis.

    On a stream each row is given when the watermark passes it; a device without rows for `idle` seconds begins anew after that. A batch gives the same columns for all rows.
    """
    if not rows.isStreaming:
        own = Series(rows, key, [time, tie]).framed(width - 1, mean=lambda w: F.sum(value).over(w.rowsBetween(1 - width, 0)) / width).running(dose=sliced.total(F.col(value)))
        own = own.running(alarm=sliced.last(F.when(F.col("mean") >= level, 1).when(F.col("mean") < clear, 0)))
        return own.rows.select(key, tie, "mean", "dose", F.coalesce("alarm", F.lit(0)).alias("alarm"))
    kind = dict(rows.dtypes)[key]
    own = rows.withWatermark(time, late).select(time, F.col(key).alias("key"), F.unix_millis(time).alias("ms"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("x"))
    found = own.groupBy("key").transformWithStateInPandas(InOrder(width, level, clear, int(idle * 1000)), f"key {kind}, tie long, mean double, dose double, alarm int", "append", "eventtime")
    return found.withColumnRenamed("key", key).withColumnRenamed("tie", tie)


class Silence(StatefulProcessor):
    """An alert when nothing comes within a limit of a row."""

    def __init__(self, limit_ms: int) -> None:
        self.limit_ms = limit_ms

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.times = handle.getListState("times", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        known = {r[0] for r in self.times.get()}
        known |= {int(m) for part in rows for m in part["ms"]}
        order = sorted(known)
        alone = [a for a, b in zip(order, [*order[1:], None], strict=True) if b is None or b - a > self.limit_ms]
        # A time that another follows within the limit is no alert. It is kept while a row before it can still come, which it would follow.
        passed = timerValues.getCurrentWatermarkInMs()
        self.times.put([(m,) for m in sorted({*alone, *(m for m in order if m >= passed)})])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for m in alone:
            self.handle.registerTimer(m + self.limit_ms + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs() - self.limit_ms - 1
        held = [tuple(r) for r in self.times.get()]
        if (at,) not in held:  # a row came in between, in the batch that lets the timer go
            yield pd.DataFrame()
            return
        rest = [r for r in held if r[0] != at]
        if rest:
            self.times.put(rest)
        else:
            self.times.clear()
        yield pd.DataFrame({"key": [key[0]], "since_ms": [at], "alert_ms": [at + self.limit_ms]})

    def close(self) -> None:
        pass


def silences(rows: DataFrame, key: str, time: str, limit: float, late: str = "1 day") -> DataFrame:
    """(key, since_ms, alert_ms): times of a key's rows after which none came for more than `limit` seconds, and when that was known.

    Over all rows it tells devices that have fallen silent; over the rows of movement it is a stillness alarm. On a stream an alert is given as soon as the watermark has passed it, without waiting
    for the next row; a batch gives those and that of each key's last row. A row that arrives out of order, but within the delay, can still take back an alert that wasn't due.
    """
    ms = F.unix_millis(time)
    if not rows.isStreaming:
        own = Series(rows.select(key, ms.alias("since_ms")).distinct(), key, ["since_ms"]).framed(0, 1, _next=lambda w: F.lead("since_ms").over(w)).rows
        return own.where(F.col("_next").isNull() | (F.col("_next") - F.col("since_ms") > int(limit * 1000))).select(key, "since_ms", (F.col("since_ms") + int(limit * 1000)).alias("alert_ms"))
    kind = dict(rows.dtypes)[key]
    own = rows.withWatermark(time, late).select(time, F.col(key).alias("key"), ms.alias("ms"))
    return own.groupBy("key").transformWithStateInPandas(Silence(int(limit * 1000)), f"key {kind}, since_ms long, alert_ms long", "append", "eventtime").withColumnRenamed("key", key)
