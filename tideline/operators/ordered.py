"""Per-row operators over ordered sequences: calculus, smoothing, angles, paths. All are window expressions.

Each takes ``by`` (the columns that name a sequence) and ``order`` (time, then a unique tie-breaker), and adds
one column. The first row of a difference is null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.geometry import TURN, along_cross, angle_diff, length, parts, pose_to_xyyaw, quat_to_yaw
from tideline.functions.numeric import NAN, ColumnLike, col, dbl, running, safe_div, sequence
from tideline.operators.segments import accumulated, around, chunks

Columns = Sequence[ColumnLike]
#: Rows of a sequence that a moving average takes in one task.
CHUNK = 1 << 18
#: Operators take the least and greatest value of the first column of ``order`` (``segments.span``), a number, to work
#: in segments of it, so that a long sequence is many tasks; ``by`` and ``order`` are then names. None: a task a sequence.
Bounds = tuple[float, float] | None
Divide = Callable[[Column, Column], Column]


def neighbouring(df: DataFrame, by: Columns, order: Columns, bounds: Bounds, after: bool = False, **state: Column) -> tuple[DataFrame, dict[str, Column], dict[str, Column], list[str]]:
    """(the frame, the states of the row before, if ``after`` those of the row after, columns to drop once these are used)."""
    if bounds is None:
        w = sequence(by, order)
        return df, {n: F.lag(c).over(w) for n, c in state.items()}, {n: F.lead(c).over(w) for n, c in state.items()}, []
    df = around(df, {"_row": F.struct(*[c.alias(n) for n, c in state.items()])}, by, order, bounds, strict=True, after=after)
    before, behind = ({n: F.col(f"_row_{side}")[n] for n in state} for side in ("before", "after"))
    return df, before, behind, ["_row_before", *(["_row_after"] if after else [])]


def with_diff(df: DataFrame, x: ColumnLike, t: ColumnLike, by: Columns, order: Columns, out: str = "diff", bounds: Bounds = None) -> DataFrame:
    """Backward difference quotient."""
    x, t = dbl(x), dbl(t)
    df, was, _, extra = neighbouring(df, by, order, bounds, x=x, t=t)
    return df.withColumn(out, safe_div(x - was["x"], t - was["t"])).drop(*extra)


def with_integral(df: DataFrame, x: ColumnLike, t: ColumnLike, by: Columns, order: Columns, out: str = "integral", bounds: Bounds = None) -> DataFrame:
    """Cumulative trapezoid, 0 at the first row; a NaN stays in all later rows."""
    w, x, t = sequence(by, order), dbl(x), dbl(t)
    if bounds is not None:
        return accumulated(df, F.struct(x.alias("x"), t.alias("t")), lambda a, b: 0.5 * (b["x"] + a["x"]) * (b["t"] - a["t"]), by, order, bounds, out)
    step = F.coalesce(0.5 * (x + F.lag(x).over(w)) * (t - F.lag(t).over(w)), F.lit(0.0))
    return df.withColumn("_step", step).withColumn(out, F.sum("_step").over(running(by, order))).drop("_step")


def with_moving_average(df: DataFrame, x: ColumnLike, window: int, by: Columns, order: Columns, out: str = "moving_average", bounds: Bounds = None, chunk: int = CHUNK) -> DataFrame:
    """Centred mean over ``window`` rows (one more before than after if even); null unless all are there, NaN if one is NaN."""
    if window < 1:
        raise ValueError("window must be at least 1")
    if bounds is not None:
        df = chunks(df, by, order, bounds, max(chunk, window), window // 2)
        by = [*by, "_chunk"]
    w = sequence(by, order).rowsBetween(-(window // 2), (window - 1) // 2)
    x = dbl(x)
    df = df.withColumn(out, F.when(F.count(x).over(w) == window, F.avg(x).over(w)))
    return df if bounds is None else df.where("_own").drop("_chunk", "_own")


def _turn_step(a: Column, before: Column) -> Column:
    """The difference of two angles by the shorter way; half a turn keeps the sign of the raw difference."""
    raw = a - before
    m = F.pmod(raw + math.pi, F.lit(TURN)) - math.pi
    m = F.when((m == -math.pi) & (raw > 0), F.lit(math.pi)).otherwise(m)
    return F.when(F.abs(raw) < math.pi, raw).otherwise(m)


def with_unwrapped(df: DataFrame, angle: ColumnLike, by: Columns, order: Columns, out: str = "unwrapped", bounds: Bounds = None) -> DataFrame:
    """Angles without jumps of over half a turn."""
    a = dbl(angle)
    mend = lambda b, a: F.when(b.isNull() | (F.abs(a - b) < math.pi), F.lit(0.0)).otherwise(_turn_step(a, b) - (a - b))
    if bounds is not None:
        done = accumulated(df, F.struct(a.alias("a")), lambda p, q: mend(p["a"], q["a"]), by, order, bounds, "_fix")
        return done.withColumn(out, a + F.col("_fix")).drop("_fix")
    fix = mend(F.lag(a).over(sequence(by, order)), a)
    return df.withColumn("_fix", fix).withColumn(out, a + F.sum("_fix").over(running(by, order))).drop("_fix")


def with_cumulative_distance(df: DataFrame, position: ColumnLike, by: Columns, order: Columns, out: str = "distance", bounds: Bounds = None) -> DataFrame:
    """Length of the path so far in the x-y plane, from 0."""
    w = sequence(by, order)
    x, y = parts(position, "x", "y")
    if bounds is not None:
        return accumulated(df, F.struct(x.alias("x"), y.alias("y")), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]), by, order, bounds, out)
    step = F.coalesce(F.hypot(x - F.lag(x).over(w), y - F.lag(y).over(w)), F.lit(0.0))
    return df.withColumn("_step", step).withColumn(out, F.sum("_step").over(running(by, order))).drop("_step")


def with_velocity(df: DataFrame, position: ColumnLike, t: ColumnLike, by: Columns, order: Columns, out: str = "velocity", bounds: Bounds = None, divide: Divide = safe_div) -> DataFrame:
    """Speed in the x-y plane since the row before; ``divide`` says what it is where no time has passed."""
    t = dbl(t)
    x, y = parts(position, "x", "y")
    df, was, _, extra = neighbouring(df, by, order, bounds, x=x, y=y, t=t)
    return df.withColumn(out, divide(length(x - was["x"], y - was["y"]), t - was["t"])).drop(*extra)


def with_yaw_rate(df: DataFrame, orientation: ColumnLike, t: ColumnLike, by: Columns, order: Columns, out: str = "yaw_rate", bounds: Bounds = None, divide: Divide = safe_div) -> DataFrame:
    """Turn since the row before by the shorter way, per time; ``divide`` says what it is where no time has passed. No
    running sum is needed for that."""
    t, yaw = dbl(t), quat_to_yaw(orientation)
    df, was, _, extra = neighbouring(df, by, order, bounds, yaw=yaw, t=t)
    return df.withColumn(out, divide(_turn_step(yaw, was["yaw"]), t - was["t"])).drop(*extra)


def gradient(x: Column, before: Column, after: Column) -> Column:
    """Central difference at unit spacing, one-sided at the ends, null for a single row."""
    return F.when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2.0)


def xyyaw(df: DataFrame, pose: ColumnLike | dict[str, float]) -> Column:
    """``struct<x, y, yaw>`` of any form of a pose: a struct with ``position`` and ``orientation``, one with ``x, y,
    yaw``, or a dict of these three numbers. TypeError for anything else."""
    if isinstance(pose, dict):
        if not {"x", "y", "yaw"} <= set(pose):
            raise TypeError(f"a pose needs x, y and yaw, not {sorted(pose)}")
        return F.struct(*[F.lit(float(pose[n])).alias(n) for n in ("x", "y", "yaw")])
    p = col(pose)
    kind = df.select(p).schema[0].dataType
    names = set(kind.names) if isinstance(kind, T.StructType) else set()
    if {"position", "orientation"} <= names:
        return pose_to_xyyaw(p)
    if {"x", "y", "yaw"} <= names:
        return p
    raise TypeError(f"{kind.simpleString()} is no pose: it needs position and orientation, or x, y and yaw")


def with_pose_error(df: DataFrame, actual: ColumnLike | dict, reference: ColumnLike | dict, frame: str, by: Columns = (), order: Columns = (), out: str = "pose_error", bounds: Bounds = None) -> DataFrame:
    """``struct<along, cross, yaw>`` of two poses, in any form that :func:`xyyaw` takes.

    Frames: ``xy`` (axes as they are), ``ref_heading`` (turned by the reference's yaw), ``ref_path`` (turned by
    the tangent of the reference's path; needs ``by`` and ``order``).
    """
    (ax, ay, ayaw), (rx, ry, ryaw) = (parts(xyyaw(df, p), "x", "y", "yaw") for p in (actual, reference))
    dx, dy, extra = ax - rx, ay - ry, []
    if frame == "xy":
        along, cross = dx, dy
    elif frame == "ref_heading":
        along, cross = along_cross(dx, dy, ryaw)
    elif frame == "ref_path":
        df, was, then, extra = neighbouring(df, by, order, bounds, after=True, x=rx, y=ry)
        along, cross = along_cross(dx, dy, F.atan2(gradient(ry, was["y"], then["y"]), gradient(rx, was["x"], then["x"])))
    else:
        raise ValueError(f"Unknown frame: {frame!r} (xy, ref_heading or ref_path)")
    return df.withColumn(out, F.struct(along.alias("along"), cross.alias("cross"), angle_diff(ayaw, ryaw).alias("yaw"))).drop(*extra)


def finite_or_nan(x: Column) -> Column:
    """Null as NaN, for users who want numpy's first element."""
    return F.coalesce(x, F.lit(NAN))
