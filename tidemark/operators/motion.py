"""Motion by device: orientation fusion, whose state feeds back on itself, by Python over each device's rows in order; falls and directions as column expressions and joins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import lookups, periods, sliced
from tidemark.operators.sliced import Series
from tidemark.operators.staging import settled


def cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def inner(a: tuple, b: tuple) -> float:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def unit(a: tuple) -> tuple | None:
    n = math.sqrt(inner(a, a))
    return tuple(x / n for x in a) if n > 0 else None


def to_body(w: float, u: tuple, d: tuple) -> tuple:
    """A direction of the world as the body at (w, u) sees it: d + 2 w (d x u) + 2 u x (u x d)."""
    a, b = cross(d, u), cross(u, cross(u, d))
    return tuple(d[i] + 2 * w * a[i] + 2 * b[i] for i in range(3))


def misfit(w: float, u: tuple, d: tuple, seen: tuple) -> np.ndarray:
    """The gradient, by (w, u), of half the squared difference between where the body should see d and where it does."""
    f = tuple(x - y for x, y in zip(to_body(w, u, d), seen, strict=True))
    turn, along, ud, uf, df = cross(f, d), cross(d, u), inner(u, d), inner(u, f), inner(d, f)
    return np.array([2 * inner(along, f), *(2 * w * turn[i] + 2 * ud * f[i] + 2 * uf * d[i] - 4 * df * u[i] for i in range(3))])


def from_directions(up: tuple, forward: tuple | None) -> np.ndarray:
    """The orientation whose vertical the body sees at up, and whose north near forward: the eigenvector of Davenport's matrix of the two frames."""
    up = unit(up) or (0.0, 0.0, 1.0)
    forward = forward or ((1.0, 0.0, 0.0) if abs(up[0]) < 0.9 else (0.0, 1.0, 0.0))
    north = unit(tuple(f - inner(forward, up) * x for f, x in zip(forward, up, strict=True)))
    if north is None:
        return from_directions(up, None)
    frame = np.array([north, cross(up, north), up])  # rows: the world's axes in the body
    b = frame.T @ np.eye(3)
    k = np.zeros((4, 4))
    k[0, 0], k[1:, 1:] = np.trace(b), b + b.T - np.trace(b) * np.eye(3)
    k[0, 1:] = k[1:, 0] = (b[1, 2] - b[2, 1], b[2, 0] - b[0, 2], b[0, 1] - b[1, 0])
    return np.linalg.eigh(k)[1][:, -1]


def fuse(accel: np.ndarray, gyro: np.ndarray, mag: np.ndarray | None, dt: float, beta: float) -> np.ndarray:
    """Orientations (n, 4) by gradient descent on gravity and the magnetic field, with turning rates in degrees a second; w >= 0."""
    q = from_directions(tuple(accel[0]), None if mag is None else tuple(mag[0]))
    out = np.empty((len(accel), 4))
    for i, (a, g) in enumerate(zip(accel.tolist(), np.radians(gyro).tolist(), strict=True)):
        w, u = float(q[0]), tuple(q[1:].tolist())
        spin = cross(u, tuple(g))
        rate = 0.5 * np.array([-inner(u, tuple(g)), *(w * g[k] + spin[k] for k in range(3))])
        down = unit(tuple(a))
        if down:
            gradient = misfit(w, u, (0.0, 0.0, 1.0), down)
            m = unit(tuple(mag[i].tolist())) if mag is not None else None
            if m:
                h = to_body(-w, u, m)
                gradient = gradient + misfit(w, u, (math.hypot(h[0], h[1]), 0.0, h[2]), m)
            size = np.linalg.norm(gradient)
            rate = rate - beta * gradient / size if size > 0 else rate
        q = q + rate * dt
        q = q / np.linalg.norm(q)
        out[i] = q if q[0] >= 0 else -q
    return out


def orientations(df: DataFrame, key: str, order: str, accel: list[str], gyro: list[str], mag: list[str] | None = None, dt: float = 0.04, beta: float = 0.1) -> DataFrame:
    """(key, order, w, x, y, z) of each row: each device's rows in order, dt seconds apart."""
    types = dict(df.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        q = fuse(part[accel].to_numpy(float), part[gyro].to_numpy(float), part[mag].to_numpy(float) if mag else None, dt, beta)
        return pd.DataFrame({key: part[key], order: part[order], **{c: q[:, k] for k, c in enumerate("wxyz")}})

    return df.select(key, order, *accel, *gyro, *(mag or [])).groupBy(key).applyInPandas(run, f"{key} {types[key]}, {order} {types[order]}, w double, x double, y double, z double")


def tilts(df: DataFrame, key: str, order: list[str], accel: str, mean: int, reference: int, rows: int | None = None) -> DataFrame:
    """df with `size` of the acceleration and `tilt`: degrees between the mean of the last `mean` accelerations and that of the key's first `reference` ones; an acceleration of nothing is at 90 degrees to all."""
    frame = lambda w: w.rowsBetween(1 - mean, 0)
    own = Series(df, key, order, rows).framed(mean - 1, **{f"_{c}": (lambda w, c=c: F.avg(f"{accel}.{c}").over(frame(w))) for c in "xyz"}).running(_i=sliced.number())
    up = own.rows.where(F.col("_i") <= reference).groupBy(F.col(key).alias("_key")).agg(*(F.avg(f"{accel}.{c}").alias(f"_u{c}") for c in "xyz"))
    length = lambda names: F.sqrt(sum((F.col(n) ** 2 for n in names[1:]), F.col(names[0]) ** 2))
    inner = F.col("_x") * F.col("_ux") + F.col("_y") * F.col("_uy") + F.col("_z") * F.col("_uz")
    cosine = inner / F.greatest(length(["_x", "_y", "_z"]), F.lit(1e-9)) / F.nullif(length(["_ux", "_uy", "_uz"]), F.lit(0.0))
    found = own.rows.join(up, F.col(key).eqNullSafe(F.col("_key")))
    return found.select(*df.columns, length([f"{accel}.{c}" for c in "xyz"]).alias("size"), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))).alias("tilt"))


def falls(df: DataFrame, key: str, order: list[str], spike: Column, tilt: Column, within: int, pre_alarm: int, limit: float, rows: int | None = None) -> DataFrame:
    """df with `state`: ok; from the first row tilted by the limit among the `within` rows from a spike on, pre_alarm for that many rows and then alert, until
    upright again (below half the limit). Spikes before that are part of the same fall.

    Each spike that leads to a fall has the first spike after that fall's end as its successor, and the falls that count are those reached from a key's first: a chain of few rows,
    not a walk over the series.
    """
    own = Series(df.withColumn("_spike", F.coalesce(spike, F.lit(False))).withColumn("_tilt", tilt), key, order, rows).running(_i=sliced.number())
    own = own.running(_down=sliced.upcoming(F.when(F.col("_tilt") >= limit, F.col("_i"))), _up=sliced.upcoming(F.when(F.col("_tilt") < limit / 2, F.col("_i"))))
    own = own.same(settled(own.df))
    ends = own.rows.select(F.col(key).alias("_key"), F.col("_i").alias("_at"), F.col("_up").alias("_end"))
    spikes = own.rows.where(F.col("_spike") & (F.col("_down") < F.col("_i") + within)).select(key, F.col("_i").alias("at"), "_down")
    found = settled(spikes.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_down") == F.col("_at"))).select(key, "at", "_down", "_end"))
    after = lookups.following(found.where("_end is not null").select(key, (F.col("_end") - 0.5).alias("t"), "at"), found.select(key, F.col("at").cast("double").alias("t"), F.col("at").alias("to")), key, "t", "to", rows)
    reached = periods.chained(found.groupBy(key).agg(F.min("at").alias("at")), after.select(key, "at", "to"), key).select(F.col(key).alias("_rkey"), F.col("at").alias("_rat"))
    chosen = found.join(reached, F.col(key).eqNullSafe(F.col("_rkey")) & (F.col("at") == F.col("_rat"))).select(F.col(key).alias("_key"), F.col("_down").alias("_from"), F.struct(F.col("_down").alias("a"), F.col("_end").alias("b")).alias("_fall"))
    marked = own.same(own.df.join(chosen, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_i") == F.col("_from")), "left").drop("_key", "_from")).running(_fall=sliced.last(F.col("_fall")))
    i, fall = F.col("_i"), F.col("_fall")
    on = fall.isNotNull() & (fall["b"].isNull() | (i < fall["b"]))
    state = F.when(on & (i < fall["a"] + pre_alarm), "pre_alarm").when(on, "alert").otherwise("ok")
    return marked.rows.select(*df.columns, state.alias("state"))


def spike_then_still(df: DataFrame, key: str, order: list[str], accel: str, spike_g: float, limit: float, within: int, pre_alarm: int, reference: int, mean: int, rows: int | None = None) -> DataFrame:
    """df with `state` by falls(): a spike is an acceleration of spike_g or more, the tilt that of the gravity direction of `mean` rows against the first `reference` rows."""
    own = tilts(df, key, order, accel, mean, reference, rows)
    return falls(own, key, order, F.col("size") >= spike_g, F.col("tilt"), within, pre_alarm, limit, rows).drop("size", "tilt")


def mean_direction(df: DataFrame, key: str, v: str) -> DataFrame:
    """(key, x, y, z, spread): each key's mean unit vector of v, and the root mean square angle to it in degrees."""
    n = F.sqrt(F.col(f"{v}.x") ** 2 + F.col(f"{v}.y") ** 2 + F.col(f"{v}.z") ** 2)
    own = df.select(key, *((F.col(f"{v}.{c}") / n).alias(f"_{c}") for c in "xyz"))
    sums = own.groupBy(key).agg(*(F.avg(f"_{c}").alias(c) for c in "xyz"))
    size = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    middle = sums.select(key, *((F.col(c) / size).alias(c) for c in "xyz"))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sum((F.col(f"_{c}") * F.col(c) for c in "yz"), F.col("_x") * F.col("x"))))))
    return own.join(middle, key).groupBy(key, "x", "y", "z").agg(F.sqrt(F.avg(angle * angle)).alias("spread"))
