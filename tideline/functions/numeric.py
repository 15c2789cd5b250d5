"""Column helpers that give numpy's answers where Spark's differ: division by zero, NaN, ordered windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: A name, a column, or a path into a schema (``operators.fields.Fields``).
ColumnLike = str | Column | Any
NAN, INF = float("nan"), float("inf")


def col(c: ColumnLike) -> Column:
    """A column by (dotted) name, as given, or of a path into a schema; TypeError for anything else."""
    if isinstance(c, str):
        return F.col(c)
    if not isinstance(c, Column) and isinstance(getattr(type(c), "col", None), property):
        c = c.col
    if not isinstance(c, Column):
        raise TypeError(f"expected a name, a column or fields, not {type(c).__name__}")
    return c


def dbl(c: ColumnLike) -> Column:
    return col(c).cast("double")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def safe_div(a: Column, b: Column) -> Column:
    """a / b by IEEE rules: x/0 is an infinity of x's sign, 0/0 and NaN/0 are NaN. Null if either is null."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, zero).otherwise(a / b)


def nan_or(x: Column, value: Column) -> Column:
    """An aggregate ``value`` of x that is NaN if any x is."""
    return F.when(F.max(F.isnan(x).cast("int")) == 1, F.lit(NAN)).otherwise(value)


def nan_min(x: Column) -> Column:
    """Minimum that is NaN if any value is, as numpy's."""
    return nan_or(x, F.min(x))


def nan_percentile(x: Column, p: float) -> Column:
    """Exact percentile, linear between ranks, NaN if any value is."""
    return nan_or(x, F.percentile(x, F.lit(float(p))))


def with_aggregates(df: DataFrame, by: Sequence[ColumnLike], **aggregates: Column) -> DataFrame:
    """``df`` with aggregates of each row's sequence: grouped, so summed up before the shuffle, and joined back. A window
    over whole sequences would give the same, but sort each of them in one task."""
    keys = [col(b).alias(f"_k{i}") for i, b in enumerate(by)]
    ends = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    if not by:
        return df.crossJoin(F.broadcast(ends))  # one row
    same = reduce(lambda x, y: x & y, [col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)])
    return df.join(ends, same).drop(*[f"_k{i}" for i in range(len(by))])


def sequence(by: Sequence[ColumnLike], order: Sequence[ColumnLike]) -> WindowSpec:
    """The rows of one sequence in order. ``order`` should end in a unique column."""
    return Window.partitionBy(*map(col, by)).orderBy(*map(col, order))


def running(by: Sequence[ColumnLike], order: Sequence[ColumnLike]) -> WindowSpec:
    return sequence(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(by: Sequence[ColumnLike], order: Sequence[ColumnLike]) -> WindowSpec:
    return sequence(by, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
