"""Quaternions as structs (w, x, y, z) of doubles, in column expressions. q_ab takes frame a to frame b."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def dot(a: Column, b: Column) -> Column:
    return a["w"] * b["w"] + a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def normalised(q: Column) -> Column:
    n = F.sqrt(dot(q, q))
    return quaternion(*(q[c] / n for c in "wxyz"))


def conjugate(q: Column) -> Column:
    return quaternion(q["w"], -q["x"], -q["y"], -q["z"])


def product(a: Column, b: Column) -> Column:
    aw, ax, ay, az = (a[c] for c in "wxyz")
    bw, bx, by, bz = (b[c] for c in "wxyz")
    return quaternion(aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a nested call would copy its expression wherever it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def rotated(q: Column, v: Column) -> Column:
    """v turned by q: v + 2 w (u x v) + 2 u x (u x v) for a unit quaternion (w, u)."""
    return once(F.struct(normalised(q).alias("q"), v.alias("v")), lambda x: rotated_by_unit(x["q"], x["v"]))


def rotated_by_unit(q: Column, v: Column) -> Column:
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    u, own = tuple(q[c] for c in "xyz"), tuple(v[c] for c in "xyz")
    t = tuple(2 * c for c in cross(u, own))
    return vector(*(own[i] + q["w"] * t[i] + c for i, c in enumerate(cross(u, t))))


def from_axis_angle(v: Column) -> Column:
    """A rotation vector (radians; its length is the angle)."""
    a = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])
    s = F.when(a > 0, F.sin(a / 2) / a).otherwise(0.0)
    return quaternion(F.cos(a / 2), v["x"] * s, v["y"] * s, v["z"] * s)


def from_euler(roll: Column, pitch: Column, yaw: Column) -> Column:
    """Yaw, then pitch, then roll about the moving axes, in degrees: the product of the three turns, written out."""
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(F.radians(a) / 2), F.sin(F.radians(a) / 2)) for a in (roll, pitch, yaw))
    return quaternion(cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy)


def canonical(q: Column) -> Column:
    """Of the two signs that are one rotation, that with w >= 0."""
    return F.when(q["w"] < 0, quaternion(*(-q[c] for c in "wxyz"))).otherwise(q)


def with_w(x: Column, y: Column, z: Column) -> Column:
    """A unit quaternion from its last three components; w is 0 where they are too long."""
    return quaternion(F.sqrt(F.greatest(1 - (x * x + y * y + z * z), F.lit(0.0))), x, y, z)


def angle_degrees(a: Column, b: Column) -> Column:
    """The angle of the rotation between two orientations, whatever their signs."""
    cosine = once(F.struct(a.alias("a"), b.alias("b")), lambda x: dot(x["a"], x["b"]) / F.sqrt(dot(x["a"], x["a"]) * dot(x["b"], x["b"])))
    return F.degrees(2 * F.acos(F.least(F.abs(cosine), F.lit(1.0))))


def gravity(q: Column) -> Column:
    """The direction of the vertical in the body's frame."""
    return rotated(conjugate(q), vector(F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def tilt_degrees(a: Column, b: Column) -> Column:
    """The angle between the verticals of two orientations."""
    cosine = lambda x: x["g"]["x"] * x["h"]["x"] + x["g"]["y"] * x["h"]["y"] + x["g"]["z"] * x["h"]["z"]
    inner = once(F.struct(gravity(a).alias("g"), gravity(b).alias("h")), cosine)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner))))


def flips(q: Column, over: WindowSpec) -> Column:
    """1 where the sign of a quaternion has turned against the one before it. A running sum of flips, by its parity, unwraps a series."""
    return F.when(dot(q, F.lag(q).over(over)) < 0, 1).otherwise(0)


def angular_speed(q: Column, seconds: Column, over: WindowSpec) -> Column:
    """Degrees a second since the row before."""
    return angle_degrees(q, F.lag(q).over(over)) / (seconds - F.lag(seconds).over(over))
