"""Row-wise geometry as Column expressions; they stay in Catalyst and whole-stage code.

Points, quaternions and poses are struct columns (``x, y[, z]``, ``x, y, z, w``, ``position, orientation``),
given by name or as a Column; a literal struct serves as a constant operand.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.numeric import ColumnLike, col, dbl, let

TURN = 2 * math.pi


def parts(struct: ColumnLike, *names: str) -> list[Column]:
    """Fields of a struct column, as doubles."""
    s = col(struct)
    return [s[n].cast("double") for n in names]


def point(x: ColumnLike, y: ColumnLike, z: ColumnLike | None = None) -> Column:
    fields = [dbl(x).alias("x"), dbl(y).alias("y")]
    return F.struct(*fields, *([dbl(z).alias("z")] if z is not None else []))


def quaternion(x: ColumnLike, y: ColumnLike, z: ColumnLike, w: ColumnLike) -> Column:
    return F.struct(dbl(x).alias("x"), dbl(y).alias("y"), dbl(z).alias("z"), dbl(w).alias("w"))


def quat_to_yaw(q: ColumnLike) -> Column:
    """Rotation about z; the quaternion isn't normalised first."""
    x, y, z, w = parts(q, "x", "y", "z", "w")
    return F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (y * y + z * z))


def quat_to_rpy(q: ColumnLike) -> Column:
    """``struct<roll, pitch, yaw>``; at the poles and beyond pitch is half a turn's half by sign."""
    x, y, z, w = parts(q, "x", "y", "z", "w")
    s = 2.0 * (w * y - z * x)
    pitch = F.when(F.abs(s) >= 1.0, F.signum(s) * (math.pi / 2)).otherwise(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))
    roll = F.atan2(2.0 * (w * x + y * z), 1.0 - 2.0 * (x * x + y * y))
    return F.struct(roll.alias("roll"), pitch.alias("pitch"), quat_to_yaw(q).alias("yaw"))


def yaw_to_quat(yaw: ColumnLike) -> Column:
    half = dbl(yaw) / 2.0
    return quaternion(F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half))


def rpy_to_quat(roll: ColumnLike, pitch: ColumnLike, yaw: ColumnLike) -> Column:
    """Yaw about z, then pitch about y, then roll about x."""
    halves = [dbl(a) / 2.0 for a in (roll, pitch, yaw)]
    (sr, sp, sy), (cr, cp, cy) = [F.sin(h) for h in halves], [F.cos(h) for h in halves]
    return quaternion(
        sr * cp * cy - cr * sp * sy,
        cr * sp * cy + sr * cp * sy,
        cr * cp * sy - sr * sp * cy,
        cr * cp * cy + sr * sp * sy,
    )


def normalize_angle(angle: ColumnLike) -> Column:
    """Into [-pi, pi): pi becomes -pi."""
    return F.pmod(dbl(angle) + math.pi, F.lit(TURN)) - math.pi


def angle_diff(a: ColumnLike, b: ColumnLike) -> Column:
    return normalize_angle(dbl(a) - dbl(b))


def length(x: Column, y: Column) -> Column:
    """The root of the sum of squares, as SQL has it; ``hypot``, whose last digit may be another, where squares overflow
    or vanish."""
    squares = x * x + y * y
    return F.when((squares > 1e-280) & (squares < float("inf")), F.sqrt(squares)).otherwise(F.hypot(x, y))


def distance_2d(p: ColumnLike, q: ColumnLike) -> Column:
    (ax, ay), (bx, by) = parts(p, "x", "y"), parts(q, "x", "y")
    return F.hypot(ax - bx, ay - by)


def distance_3d(p: ColumnLike, q: ColumnLike) -> Column:
    d = [a - b for a, b in zip(parts(p, "x", "y", "z"), parts(q, "x", "y", "z"), strict=True)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def twist_to_speed(linear: ColumnLike) -> Column:
    x, y, z = parts(linear, "x", "y", "z")
    return F.sqrt(x * x + y * y + z * z)


def twist_to_speed_2d(linear: ColumnLike) -> Column:
    return F.hypot(*parts(linear, "x", "y"))


def to_xy(p: ColumnLike) -> list[Column]:
    """Columns ``x, y`` for a select."""
    return [c.alias(n) for c, n in zip(parts(p, "x", "y"), "xy", strict=True)]


def to_xyz(p: ColumnLike) -> list[Column]:
    return [c.alias(n) for c, n in zip(parts(p, "x", "y", "z"), "xyz", strict=True)]


def to_numpy_2d(p: ColumnLike) -> Column:
    """``array<double>`` (x, y): a collected column stacks to an (N, 2) matrix."""
    return F.array(*parts(p, "x", "y"))


def to_numpy_3d(p: ColumnLike) -> Column:
    return F.array(*parts(p, "x", "y", "z"))


def pose_to_xyyaw(pose: ColumnLike) -> Column:
    """``struct<x, y, yaw>`` of a pose (``position``, ``orientation``)."""
    p = col(pose)
    x, y = parts(p["position"], "x", "y")
    return F.struct(x.alias("x"), y.alias("y"), quat_to_yaw(p["orientation"]).alias("yaw"))


def along_cross(dx: Column, dy: Column, heading: Column) -> tuple[Column, Column]:
    """A displacement in a frame that is turned by ``heading``."""
    c, s = F.cos(heading), F.sin(heading)
    return dx * c + dy * s, dy * c - dx * s


def slerp(q0: Column, q1: Column, alpha: Column) -> Column:
    """Spherical interpolation on the shorter arc; nearly equal quaternions are mixed linearly; unit result."""
    a, b = parts(q0, "x", "y", "z", "w"), parts(q1, "x", "y", "z", "w")
    dot = sum((p * q for p, q in zip(a[1:], b[1:], strict=True)), a[0] * b[0])

    def weights(d: Column) -> Column:
        angle = F.acos(F.least(F.abs(d), F.lit(1.0)))
        near = F.abs(d) > 0.9995
        sine = F.when(near, 1.0).otherwise(F.sin(angle))
        wa = F.when(near, 1.0 - alpha).otherwise(F.sin((1.0 - alpha) * angle) / sine)
        wb = F.when(near, alpha).otherwise(F.sin(alpha * angle) / sine)
        return F.struct(wa.alias("a"), F.when(d < 0, -wb).otherwise(wb).alias("b"))

    def unit(m: Column) -> Column:
        x, y, z, w = parts(m, "x", "y", "z", "w")
        return let(F.sqrt(x * x + y * y + z * z + w * w), lambda n: quaternion(*[c / F.when(n == 0, 1.0).otherwise(n) for c in (x, y, z, w)]))

    mixed = let(let(dot, weights), lambda v: quaternion(*[p * v["a"] + q * v["b"] for p, q in zip(a, b, strict=True)]))
    return let(mixed, unit)
