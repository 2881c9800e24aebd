"""Fits and comparisons of orientations: hard-iron offsets, orientations on a common grid, counter-rotation, fingerprints of motion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rotation
from tidemark.operators import lookups, physical, sliced, statistics, windows
from tidemark.operators.sliced import Series
from tidemark.operators.staging import settled

# Share of its 95th percentile from which a sensor turns; seconds and degrees of episodes that count.
TURNING, MERGE_S, LEAST_S, LEAST_DEGREES = 0.2, 1.0, 1.0, 1.0


def matrix(q: Column) -> list[list[Column]]:
    """Rows of the rotation matrix of a unit quaternion: what turns the body's directions into the world's."""
    w, x, y, z = (q[c] for c in "wxyz")
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def solved(gram: np.ndarray, right: np.ndarray, tolerance: float = 1e-10) -> np.ndarray | None:
    """gram^-1 right by Cholesky with the largest remaining pivot first; None where a pivot falls below tolerance times the first."""
    a, order, n = gram.astype(float).copy(), [], len(gram)
    factor, left = np.zeros((n, n)), list(range(n))
    first = max(a.diagonal().max(), 0.0)
    for k in range(n):
        p = max(left, key=lambda i: a[i, i])
        if a[p, p] <= tolerance * first or first == 0:
            return None
        factor[:, k] = a[:, p] / np.sqrt(a[p, p])
        factor[order, k] = 0.0
        a -= np.outer(factor[:, k], factor[:, k])
        order.append(p)
        left.remove(p)
    lower = factor[order]
    y = np.linalg.solve(lower, right[order])
    out = np.empty(n)
    out[order] = np.linalg.solve(lower.T, y)
    return out


def hard_iron(df: DataFrame, key: str, q: str, field: str) -> DataFrame:
    """(key, n, bx, by, bz, mx, my, mz): the constant offset b of a magnetometer and the world's field -m, by least squares on R b + m = R field over all rows of a key.

    The normal equations are sums of nine entries of R, the field and the turned field, so they merge over tasks, and no row is left out. Where the orientations don't determine them
    (all about one axis, too few) the six are null. Rows with a null take no part.
    """
    r, v = matrix(F.col(q)), [F.col(f"{field}.{c}") for c in "xyz"]
    turned = [sum((r[i][j] * v[j] for j in (1, 2)), r[i][0] * v[0]) for i in range(3)]
    own = df.select(key, *(r[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)), *(v[i].cast("double").alias(f"v{i}") for i in range(3)), *(turned[i].alias(f"t{i}") for i in range(3))).where(" and ".join(f"t{i} is not null" for i in range(3)))
    names = [*(f"r{i}{j}" for i in range(3) for j in range(3)), *(f"v{i}" for i in range(3)), *(f"t{i}" for i in range(3))]
    sums = own.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in names))
    kind = dict(df.dtypes)[key]

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for row in part[["n", *names]].to_numpy(float):
                n, turn = row[0], row[1:10].reshape(3, 3)
                gram = np.block([[n * np.eye(3), turn.T], [turn, n * np.eye(3)]])
                answer = solved(gram, row[10:16])
                found.append([None] * 6 if answer is None else answer.tolist())
            yield pd.concat([part[[key, "n"]].reset_index(drop=True), pd.DataFrame(found, columns=["bx", "by", "bz", "mx", "my", "mz"], dtype=float)], axis=1)

    return sums.mapInPandas(solve, f"{key} {kind}, n long, bx double, by double, bz double, mx double, my double, mz double")


def between(a: Column, b: Column, share: Column) -> Column:
    """The orientation on the shortest way from a to b, `share` of it along: spherical interpolation."""
    def mixed(x: Column) -> Column:
        inner = rotation.dot(x["a"], x["b"])
        b = rotation.quaternion(*(F.when(inner < 0, -x["b"][c]).otherwise(x["b"][c]) for c in "wxyz"))
        angle = F.acos(F.least(F.abs(inner), F.lit(1.0)))
        near = angle < 1e-9
        p, q = F.when(near, 1 - x["s"]).otherwise(F.sin((1 - x["s"]) * angle) / F.sin(angle)), F.when(near, x["s"]).otherwise(F.sin(x["s"] * angle) / F.sin(angle))
        return rotation.quaternion(*(p * x["a"][c] + q * b[c] for c in "wxyz"))

    return rotation.once(F.struct(rotation.normalised(a).alias("a"), rotation.normalised(b).alias("b"), share.alias("s")), mixed)


def on_grid(df: DataFrame, key: str, seconds: str, q: str, hertz: float = 10.0, rows: int | None = None) -> DataFrame:
    """(key, tick, q): orientations at the ticks of a grid of `hertz`, from the first tick at or after a key's first row to the last before its last row, each between the rows around it.

    Of rows at one time the first by value counts. The neighbours of all ticks come from one ordered series, not a join; a key's ticks are dealt out in blocks of 4,096.
    """
    once = df.where(F.col(seconds).isNotNull() & F.col(q).isNotNull()).groupBy(key, F.col(seconds).alias("_t")).agg(F.min(q).alias("_q"))
    ends = once.groupBy(key).agg(F.ceil(F.min("_t") * hertz).cast("long").alias("_a"), (F.ceil(F.max("_t") * hertz) - 1).cast("long").alias("_b")).where("_a <= _b")
    blocks = ends.select(key, "_b", F.explode(F.sequence("_a", "_b", F.lit(4096).cast("long"))).alias("_from"))
    grid = blocks.select(key, F.explode(F.sequence("_from", F.least("_b", F.col("_from") + 4095))).alias("tick")).withColumn("_t", F.col("tick") / hertz)
    found = lookups.neighbours(grid, once, key, "_t", "_q", rows)
    a, b = F.col("_a"), F.col("_b")
    share = F.when(b["t"] > a["t"], (F.col("_t") - a["t"]) / (b["t"] - a["t"])).otherwise(0.0)
    # A tick at a row's own time has that row on its left, and the next on its right only if it is that row too.
    return found.select(key, "tick", F.when(a["t"] == F.col("_t"), rotation.normalised(a["v"])).otherwise(between(a["v"], b["v"], share)).alias("q"))


def yaw_rates(df: DataFrame, key: str, seconds: str, q: str, hertz: float = 10.0, rows: int | None = None) -> DataFrame:
    """(key, tick, rate): degrees a second about the world's vertical, from each tick to the next."""
    own = Series(on_grid(df, key, seconds, q, hertz, rows), key, ["tick"], rows).framed(0, 1, _next=lambda w: F.lead("q").over(w)).rows.where("_next is not null")
    step = own.select(key, "tick", rotation.product(F.col("_next"), rotation.conjugate(F.col("q"))).alias("_d"))
    size = F.sqrt(F.col("_d.x") ** 2 + F.col("_d.y") ** 2 + F.col("_d.z") ** 2)
    sign = F.when(F.col("_d.w") < 0, -1.0).otherwise(1.0)
    angle = 2 * F.atan2(size, F.abs("_d.w"))
    return step.select(key, "tick", F.degrees(F.when(size > 0, sign * F.col("_d.z") / size * angle).otherwise(0.0) * hertz).alias("rate"))


def counter_rotation(yaws: DataFrame, pairs: DataFrame, key: str, hertz: float = 10.0, merge: float = MERGE_S, least: float = LEAST_S, rows: int | None = None) -> DataFrame:
    """(a, b, per_sample_pct, episodes, both_turn, counter_pct) of each pair (a, b) of sensors in pairs, over the ticks that both have in yaws, from yaw_rates().

    A sensor turns where its rate is over a fifth of its 95th percentile over these ticks. per_sample_pct: of the ticks at which both do, the percentage of opposite senses.
    Stretches in which either turns, less than `merge` seconds apart, are one episode; those of `least` seconds or longer count. Of episodes in which both turn a degree or more, counter_pct is the
    percentage of opposite senses. Percentages of nothing are null. Ticks are numbered as they follow one another, so a gap that both have doesn't part an episode.
    """
    x, y = yaws.select(F.col(key).alias("a"), F.col("tick"), F.col("rate").alias("wa")), yaws.select(F.col(key).alias("b"), "tick", F.col("rate").alias("wb"))
    met = pairs.select("a", "b").join(x, "a").join(y, ["b", "tick"])
    own = settled(met.select(F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string")).alias("_pair"), "a", "b", "tick", "wa", "wb"))
    level = lambda c, n: statistics.quantiles(own.select("_pair", F.abs(c).alias("_r")), "_pair", "_r", {n: 0.95}, rows)
    limits = level("wa", "_la").join(level("wb", "_lb"), "_pair").select("_pair", (TURNING * F.col("_la")).alias("_la"), (TURNING * F.col("_lb")).alias("_lb"))
    on = lambda s: F.abs(f"w{s}") > F.col(f"_l{s}")
    turning = own.join(limits, "_pair").withColumn("_both", on("a") & on("b")).withColumn("_any", on("a") | on("b")).drop("_la", "_lb")
    s = Series(turning, "_pair", ["tick"], rows).running(i=sliced.number(), _ca=sliced.total(F.col("wa")), _cb=sliced.total(F.col("wb")))
    s = s.same(settled(s.df))
    opposite = F.signum("wa") != F.signum("wb")
    senses = s.rows.groupBy("_pair", "a", "b").agg((100 * F.count(F.when(F.col("_both") & opposite, 1)) / F.nullif(F.count(F.when(F.col("_both"), 1)), F.lit(0))).alias("per_sample_pct"))
    marked = windows.run_id(s, "_run", "_any").rows.where("_any")
    runs = marked.groupBy("_pair", "_run").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"))
    whole = windows.episodes(runs, "_pair", "start", "end", merge * hertz, rows).where((F.col("end") - F.col("start")) / hertz >= least)
    # What an episode turns is the difference of running sums at its last row and before its first.
    at = s.rows.select(F.col("_pair").alias("_p"), "i", "_ca", "_cb", "wa", "wb")
    first = at.select("_p", F.col("i").alias("_i"), (F.col("_ca") - F.col("wa")).alias("_a0"), (F.col("_cb") - F.col("wb")).alias("_b0"))
    last = at.select(F.col("_p").alias("_p2"), F.col("i").alias("_i2"), F.col("_ca").alias("_a1"), F.col("_cb").alias("_b1"))
    turned = whole.join(first, (F.col("_pair") == F.col("_p")) & (F.col("start") == F.col("_i"))).join(last, (F.col("_pair") == F.col("_p2")) & (F.col("end") - 1 == F.col("_i2")))
    ya, yb = (F.col("_a1") - F.col("_a0")) / hertz, (F.col("_b1") - F.col("_b0")) / hertz
    both = (F.abs(ya) >= LEAST_DEGREES) & (F.abs(yb) >= LEAST_DEGREES)
    counts = turned.groupBy(F.col("_pair").alias("_cp")).agg(F.count(F.lit(1)).alias("episodes"), F.count(F.when(both, 1)).alias("both_turn"), F.count(F.when(both & (F.signum(ya) != F.signum(yb)), 1)).alias("_counter"))
    out = senses.join(counts, F.col("_pair") == F.col("_cp"), "left")
    zero = F.lit(0).cast("long")
    return out.select("a", "b", "per_sample_pct", F.coalesce("episodes", zero).alias("episodes"), F.coalesce("both_turn", zero).alias("both_turn"), (100 * F.col("_counter") / F.nullif(F.col("both_turn"), F.lit(0))).alias("counter_pct"))


def fingerprint(log: DataFrame, key: str, order: list[str], seconds: str, q: str, accel: str, field: str, longest: float = 0.2, rows: int | None = None) -> DataFrame:
    """(key, part, x): the values that a sensor's motion is told by, as one long table.

    F1x, F1y, F1z: direction of the acceleration at rest; F2x to F2z: the axis of turning, without sign, while moving; F3: degrees between that axis and the vertical; F4: the turning rate
    while moving; F5: strength of the magnetic field at rest. Rest is what physical.resting() says; a key at rest in less than 1 % of its rows takes the slowest tenth instead.
    """
    s = Series(log, key, order, rows).framed(1, _dt=lambda w: F.col(seconds) - F.lag(seconds).over(w), _turn=lambda w: rotation.product(rotation.conjugate(F.lag(q).over(w)), F.col(q)))
    size = F.sqrt(F.col("_turn.x") ** 2 + F.col("_turn.y") ** 2 + F.col("_turn.z") ** 2)
    step = (F.col("_dt") > 0) & (F.col("_dt") <= longest)
    s = s.with_columns(_speed=F.when(step, F.degrees(2 * F.atan2(size, F.abs("_turn.w"))) / F.col("_dt")), _axis=F.when(size > 0, rotation.vector(*(F.abs(F.col(f"_turn.{c}") / size) for c in "xyz"))))
    sign = F.when(F.col("_turn.w") < 0, -1.0).otherwise(1.0)
    s = s.with_columns(_signed=F.when(size > 0, rotation.vector(*(sign * F.col(f"_turn.{c}") / size for c in "xyz"))))
    w = physical.resting(s, "_speed", accel).at_hand().rows.withColumn("_unhurried", F.coalesce("_speed", F.lit(float("inf"))))
    slow = statistics.quantiles(w, key, "_unhurried", {"_slow": 0.1}, rows).join(w.groupBy(F.col(key).alias("_key")).agg(F.avg(F.col("rest").cast("int")).alias("_share")), F.col(key).eqNullSafe(F.col("_key"))).drop(key)
    w = w.join(s.beside(settled(slow)), F.col(key).eqNullSafe(F.col("_key")))
    rest = F.when(F.col("_share") < 0.01, F.col("_unhurried") <= F.col("_slow")).otherwise(F.col("rest"))
    moves = F.coalesce(F.col("_speed") > physical.MOVING, F.lit(False))
    upright = rotation.once(F.struct(rotation.gravity(F.col(q)).alias("g"), F.col("_signed").alias("a")), lambda s: F.abs(sum((s["g"][c] * s["a"][c] for c in "yz"), s["g"]["x"] * s["a"]["x"])))
    parts = [(f"F1{c}", rest, F.col(f"{accel}.{c}") / physical.length(accel)) for c in "xyz"] + [(f"F2{c}", moves, F.col(f"_axis.{c}")) for c in "xyz"]
    parts += [("F3", moves, F.degrees(F.acos(F.least(upright, F.lit(1.0))))), ("F4", moves, F.col("_speed")), ("F5", rest, physical.length(field))]
    long = w.select(key, F.inline(F.array(*(F.struct(F.lit(n).alias("part"), F.when(c, x.cast("double")).alias("x")) for n, c, x in parts))))
    return long.where("x is not null and not isnan(x)")


def fingerprint_distance(prints: DataFrame, side: str, rows: int | None = None) -> DataFrame:
    """(part, distance) of the two sides (0 and 1) of fingerprints: Wasserstein distances, the mean of three axes for F1 and F2, Kolmogorov-Smirnov for F4. All nine come from one ranking of counted values."""
    found = statistics.distances(prints, "part", "x", side, rows)
    value = F.when(F.col("part") == "F4", F.col("ks")).otherwise(F.col("wasserstein"))
    return found.groupBy(F.substring("part", 1, 2).alias("part")).agg(F.avg(value).alias("distance"))
