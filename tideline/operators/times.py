"""Timestamps: stamps and receive times in seconds, origins, slices, first occurrences.

Times are int64 nanoseconds as long as they are absolute; what is relative is subtracted before it becomes a
double, so nothing is lost at epoch size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import ColumnLike, col, dbl, sequence, whole, with_aggregates

Columns = Sequence[ColumnLike]
NS = 1_000_000_000


def stamp_ns(stamp: ColumnLike = "header.stamp") -> Column:
    """int64 nanoseconds of ``struct<sec, nanosec>``."""
    s = col(stamp)
    return s["sec"].cast("long") * F.lit(NS).cast("long") + s["nanosec"].cast("long")


def _seconds(ns: Column, by: Columns | None, order: Columns | None) -> Column:
    if order is None:
        return ns * F.lit(1e-9)
    first = F.first(ns).over(whole(by or (), order))
    return (ns - first) * F.lit(1e-9)


def stamp_to_sec(stamp: ColumnLike = "header.stamp", by: Columns | None = None, order: Columns | None = None) -> Column:
    """Seconds of a message stamp; with ``order``, since the first row of its sequence."""
    if order is None:
        s = col(stamp)
        return s["sec"].cast("double") + s["nanosec"].cast("double") * F.lit(1e-9)
    return _seconds(stamp_ns(stamp), by, order)


def recv_time_to_sec(recv: ColumnLike = "recv_time_ns", by: Columns | None = None, order: Columns | None = None) -> Column:
    """Seconds of the receive time; with ``order``, since the first row of its sequence."""
    return _seconds(col(recv).cast("long"), by, order)


def reindex_by_stamp(df: DataFrame, stamp: ColumnLike = "header.stamp", out: str = "time_ns") -> DataFrame:
    """Adds the publish time in nanoseconds as the time column."""
    return df.withColumn(out, stamp_ns(stamp))


def align_origin(df: DataFrame, t: ColumnLike, series: Columns, order: Columns, by: Columns = (), out: str = "aligned") -> DataFrame:
    """Times less the least *first* time of all series of a group, for one origin over several topics."""
    if not series:
        raise ValueError("align_origin needs at least one series")
    t = dbl(t)
    by_series = [col(c).alias(f"_s{i}") for i, c in enumerate([*by, *series])]
    first = F.min(F.struct(*[col(o) for o in order], t.alias("_t")))["_t"]
    firsts = df.groupBy(*by_series).agg(first.alias("_first"))
    keys = [f"_s{i}" for i in range(len(by))]
    origin = firsts.groupBy(*keys).agg(F.min("_first").alias("_first"))
    if by:
        same = reduce(lambda x, y: x & y, [col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys, strict=True)])
        df = df.join(origin, same).drop(*keys)
    else:
        df = df.crossJoin(F.broadcast(origin))  # one row
    return df.withColumn(out, t - F.col("_first")).drop("_first")


def time_slice(df: DataFrame, t_start: float, t_end: float, t: ColumnLike = "recv_time_ns", by: Columns = ()) -> DataFrame:
    """Rows from ``t_start`` to ``t_end`` seconds after the first of their sequence, both ends included."""
    low, high = round(t_start * NS), round(t_end * NS)
    ns = col(t).cast("long")
    return with_aggregates(df, by, _first=F.min(ns)).where((ns - F.col("_first")).between(low, high)).drop("_first")


def find_time(df: DataFrame, x: ColumnLike, condition: Callable[[Column], Column], t: ColumnLike = "recv_time_ns", by: Columns = ()) -> DataFrame:
    """Seconds from the first row of each sequence to the first at which ``condition`` holds (``t_found``; null if none)."""
    ns = col(t).cast("long")
    found = (F.min(F.when(condition(col(x)), ns)) - F.min(ns)) * F.lit(1e-9)
    return df.groupBy(*map(col, by)).agg(found.alias("t_found"))


def find_time_or_raise(df: DataFrame, x: ColumnLike, condition: Callable[[Column], Column], t: ColumnLike = "recv_time_ns") -> float:
    """The one number, for a single sequence; ValueError if the condition never holds."""
    found = find_time(df, x, condition, t).first()["t_found"]
    if found is None:
        raise ValueError("the condition never holds")
    return found


def first_value(x: ColumnLike, by: Columns, order: Columns) -> Column:
    return F.first(col(x)).over(whole(by, order))


def last_value(x: ColumnLike, by: Columns, order: Columns) -> Column:
    return F.last(col(x)).over(whole(by, order))


def nth(by: Columns, order: Columns) -> Column:
    """Position in the sequence, from 0."""
    return F.row_number().over(sequence(by, order)) - 1
