"""Fusion and fall detection by plain numpy and by brute force, and their queries."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import motion, statistics
from tidemark.plans import catalog, sensors  # noqa: F401

SF = "/root/testdata/sf0.001"


def matrix(q):
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def test_gradient_is_the_numerical_one():
    rng = np.random.default_rng(1)
    for _ in range(20):
        q, d, s = rng.normal(size=4), tuple(rng.normal(size=3)), tuple(rng.normal(size=3))
        cost = lambda q: 0.5 * np.sum((matrix(q).T @ d - s) ** 2)  # noqa: B023, E731
        want = [(cost(q + h) - cost(q - h)) / 2e-6 for h in np.eye(4) * 1e-6]
        assert motion.misfit(q[0], tuple(q[1:]), d, s) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("with_mag", [True, False])
def test_static_device_keeps_its_orientation(with_mag):
    rng = np.random.default_rng(2)
    for _ in range(10):
        q = rng.normal(size=4)
        q /= np.linalg.norm(q)
        body = matrix(q).T
        accel, mag = np.tile(body @ (0, 0, 1), (50, 1)), np.tile(body @ (0.6, 0, -0.8), (50, 1))
        found = motion.fuse(accel, np.zeros((50, 3)), mag if with_mag else None, 0.04, 0.1)[-1]
        assert matrix(found).T @ (0, 0, 1) == pytest.approx(body @ (0, 0, 1), abs=0.01)
        assert not with_mag or abs(found @ q) == pytest.approx(1, abs=1e-3)


def test_turning_device_is_followed():
    turns = np.radians(30 * 0.04 * np.arange(200))
    mag = np.stack([0.6 * np.cos(turns), -0.6 * np.sin(turns), np.full(200, -0.8)], axis=1)
    found = motion.fuse(np.tile((0.0, 0.0, 1.0), (200, 1)), np.tile((0.0, 0.0, 30.0), (200, 1)), mag, 0.04, 0.05)[-1]
    assert abs((2 * np.degrees(np.arctan2(found[3], found[0])) - np.degrees(turns[-1]) + 180) % 360 - 180) < 5


def test_falls(spark):
    spike, tilt = np.zeros(12, bool), [0, 0, 10, 70, 80, 80, 80, 20, 0, 0, 0, 0]
    spike[[1, 5, 9]] = True
    df = spark.createDataFrame([("a", i, bool(s), float(t)) for i, (s, t) in enumerate(zip(spike, tilt, strict=True))], "k string, i int, spike boolean, tilt double")
    states = lambda d, within: [r.state for r in motion.falls(d, "k", ["i"], F.col("spike"), F.col("tilt"), within, 2, 60.0).orderBy("i").collect()]
    assert states(df, 3) == ["ok"] * 3 + ["pre_alarm"] * 2 + ["alert"] * 2 + ["ok"] * 5
    assert states(df, 2) == ["ok"] * 5 + ["pre_alarm"] * 2 + ["ok"] * 5
    assert states(df.limit(0), 2) == []


def test_tilt_is_measured_against_the_first_rows(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 3)) * 0.2 + np.outer(np.linspace(1, -1, 40), [0, 0, 1]) + [0.5, 0, 0]
    df = spark.createDataFrame([("a", i, tuple(map(float, v))) for i, v in enumerate(a)], "k string, i int, a struct<x:double,y:double,z:double>")
    up = a[:6].mean(0)
    mean = np.array([a[max(0, i - 3) : i + 1].mean(0) for i in range(40)])
    want = np.degrees(np.arccos(mean @ up / np.linalg.norm(mean, axis=1) / np.linalg.norm(up)))
    for rows in (None, 12):
        found = motion.tilts(df, "k", ["i"], "a", 4, 6, rows).orderBy("i").collect()
        assert [r.tilt for r in found] == pytest.approx(want.tolist(), abs=1e-6) and [r["size"] for r in found] == pytest.approx(np.linalg.norm(a, axis=1).tolist())


def test_queries_against_rows_taken_one_device_at_a_time(spark):
    rows = duckdb.sql(f"SELECT user_id, event_id, value FROM '{SF}/events.parquet' ORDER BY user_id, event_id").fetchall()
    by_device = {}
    for u, i, v in rows:
        by_device.setdefault(u, []).append((i, v))
    fused = {(r.user_id, r.event_id): r for r in catalog.QUERIES["orientation_fusion"](spark, SF).collect()}
    assert len(fused) == len(rows)
    for u, own in by_device.items():
        v = np.array([x for _, x in own])
        a, zero = np.radians(v), np.zeros(len(v))
        q = motion.fuse(np.stack([np.sin(a), zero, np.cos(a)], 1), np.stack([zero, v, zero], 1), None, 0.04, 0.1)
        assert [fused[u, i].w for i, _ in own] == pytest.approx(q[:, 0].round(6).tolist(), abs=2e-6)


def walked(spike, tilt, within, pre_alarm, limit):
    """States of one device, by walking from spike to spike."""
    out, spikes, n = ["ok"] * len(spike), list(np.flatnonzero(spike)), len(spike)
    while spikes:
        s = spikes.pop(0)
        down = [k for k in range(s, min(n, s + within)) if tilt[k] >= limit]
        if down:
            up = next((k for k in range(down[0], n) if tilt[k] < limit / 2), n)
            for k in range(down[0], up):
                out[k] = "pre_alarm" if k < down[0] + pre_alarm else "alert"
            spikes = [k for k in spikes if k >= up]
    return out


@pytest.mark.parametrize("rows", [None, 60])
def test_falls_are_those_of_a_walk(spark, rows):
    rng = np.random.default_rng(12)
    table, want = [], {}
    for k, n in (("a", 400), ("b", 90), ("calm", 30)):
        spike = rng.random(n) < (0.2 if k != "calm" else 0)
        tilt = np.clip(np.repeat(rng.uniform(0, 60, n // 5), 5) + rng.normal(0, 4, n), 0, 90)
        table += [(k, i, bool(s), float(t)) for i, (s, t) in enumerate(zip(spike, tilt, strict=True))]
        want[k] = walked(spike, tilt, 7, 3, 30.0)
    df = spark.createDataFrame(table, "k string, i int, spike boolean, tilt double")
    found = motion.falls(df, "k", ["i"], F.col("spike"), F.col("tilt"), 7, 3, 30.0, rows).orderBy("k", "i").collect()
    assert {k: [r.state for r in found if r.k == k] for k in want} == want and set(want["a"]) == {"ok", "pre_alarm", "alert"}


def test_cross_lags_are_those_of_rolled_arrays(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=60)
    series = {"a": a, "b": np.roll(a, -3) + rng.normal(size=60) / 5, "c": rng.normal(size=60), "d": np.full(60, 2.0)}
    rows = [(k, t + 100, float(v)) for k, x in series.items() for t, v in enumerate(x)]
    found = statistics.cross_lags(spark.createDataFrame(rows, "s string, t long, v double"), "s", "t", "v", 5).collect()
    assert len(found) == 6
    for f in found:
        x, y = (series[k] - series[k].mean() for k in (f.a, f.b))
        scale = (x.std() * y.std() * 60) or 1
        want = {lag: round(float(x @ np.roll(y, lag) / scale), 9) for lag in range(-5, 6)}
        lag = max(want, key=want.get)
        assert (f.lag, f.r) == (lag, pytest.approx(want[lag], abs=1e-8))
    assert next(f.lag for f in found if (f.a, f.b) == ("a", "b")) == 3
