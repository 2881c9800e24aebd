"""Streams with timers give the batch's rows, whatever order rows come in; forecasts against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast
from tidemark.streaming import timers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("user_id", F.col("user_id") % 3)


def streamed(spark, tmp_path, name, e, f, shuffled):
    """Rows of a stream over files in order of time, those of one file and its neighbour mixed if `shuffled`."""
    timers.needs_rocksdb(spark)
    order = F.unix_micros("ts") + (F.xxhash64("event_id") % 86_400_000_000 if shuffled else 0)
    e.withColumn("_o", order).orderBy("_o").drop("_o").coalesce(1).write.option("maxRecordsPerFile", 250).parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = f(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert q.exception() is None
    return q, spark.table(name)


def passed(e):
    """Rows that the last watermark has passed."""
    return e.agg((F.unix_millis(F.max("ts")) - 3 * 86_400_000)).first()[0]


@pytest.mark.parametrize("shuffled", [False, True])
def test_exposure_stream_is_batch(spark, tmp_path, events, shuffled):
    f = lambda s: timers.exposures(s, "user_id", "ts", "event_id", "value", 10, 40.0, 30.0, late="3 days")
    q, found = streamed(spark, tmp_path, f"exposed_{int(shuffled)}", events, f, shuffled)
    rows = lambda df: {(r.user_id, r.event_id): (round(r["mean"], 9), round(r.dose, 6), r.alarm) for r in df.collect()}
    batch, stream = rows(f(events)), rows(found)
    due = {(r.user_id, r.event_id) for r in events.where(F.unix_millis("ts") < passed(events)).collect()}
    assert timers.late_rows(q) == 0
    assert due <= set(stream) and len(due) > 700 and all(batch[k] == v for k, v in stream.items())


def test_silence_stream_is_batch(spark, tmp_path, events):
    f = lambda s: timers.silences(s, "user_id", "ts", 4 * 3600.0, late="3 days")
    _, found = streamed(spark, tmp_path, "silent", events, f, True)
    rows = lambda df: sorted(map(tuple, df.collect()))
    batch, stream = rows(f(events)), rows(found)
    assert [r for r in stream if r[2] < passed(events)] == [r for r in batch if r[2] < passed(events)] and len(stream) > 20
    assert set(stream) <= set(batch)


def test_late_rows_are_counted(spark, tmp_path, events):
    early = events.agg(F.min("ts")).first()[0]
    late = events.where("event_id % 100 = 0").withColumn("ts", F.lit(early)).withColumn("event_id", F.col("event_id") + 10**6)
    n = late.count()
    timers.needs_rocksdb(spark)
    for i, part in enumerate((events, late)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    f = lambda s: timers.silences(s, "user_id", "ts", 3600.0, late="1 day")
    total = 0
    for i in range(2):
        source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in*"))
        if i == 0:
            (tmp_path / "in1").rename(tmp_path / "held")
        else:
            (tmp_path / "held").rename(tmp_path / "in1")
        q = f(source).writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        total += timers.late_rows(q)
    assert total == n


# --- forecasts


@pytest.mark.parametrize("detrend", [None, 21])
def test_transfer_matches_numpy(spark, detrend):
    rng = np.random.default_rng(3)
    window, series = 6, {}
    for k, n in (("a", 900), ("b", 400), ("short", 12)):
        x = np.zeros(n)
        for i in range(2, n):
            x[i] = 1.2 * x[i - 1] - 0.5 * x[i - 2] + rng.normal() + 0.01 * i
        series[k] = x + 20, np.cumsum(rng.normal(size=n)) / 3 + 20
    table = lambda s: spark.createDataFrame(pd.DataFrame([{"k": k, "t": i, "v": float(v)} for k, p in series.items() for i, v in enumerate(p[s])]))
    for rows in (None, 150):
        found = {(r.k, r.model): r for r in forecast.transfer(table(0), table(1), "k", ["t"], "v", window, 0.3, detrend, rows).collect()}
        assert {k for k, _ in found} == {"a", "b"} and len(found) == 8
        for k in ("a", "b"):
            real, other = series[k]
            if detrend:
                flat = lambda x: x - pd.Series(x).rolling(detrend, center=True, min_periods=1).mean().to_numpy()
                real, other = flat(real), flat(other)
            train = max(window + 1, int(len(real) * 0.3))
            design = lambda x: (np.column_stack([np.ones(len(x) - window), np.lib.stride_tricks.sliding_window_view(x[:-1], window)]), x[window:])
            test_x, test_y = design(real[train - window :])
            want = {"lag_1": test_x[:, -1], "lag_window": test_x[:, 1]}
            for name, x in (("real", real[:train]), ("synthetic", other[:train])):
                a, b = design(x)
                want[name] = test_x @ np.linalg.lstsq(a, b, rcond=None)[0]
            span = np.ptp(test_y) if detrend else np.ptp(series[k][0])
            base = np.sqrt(np.mean((test_y - want["lag_1"]) ** 2))
            for name, p in want.items():
                r, e = found[k, name], np.sqrt(np.mean((test_y - p) ** 2))
                assert (r.n, r.rmse, r.mae, r.nrmse, r.relative) == (len(test_y), pytest.approx(e, rel=1e-7), pytest.approx(np.abs(test_y - p).mean(), rel=1e-7), pytest.approx(e / span, rel=1e-7), pytest.approx(e / base, rel=1e-7))
