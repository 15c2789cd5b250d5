"""Aggregates of a sequence: statistics, tracking and step analysis, rates, gaps, delays, latencies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numeric import NAN, ColumnLike, col, dbl, nan_min, sequence
from tideline.operators.ordered import Bounds, neighbouring
from tideline.operators.segments import percentiles

Columns = Sequence[ColumnLike]


def rms(x: ColumnLike) -> Column:
    """Root of the mean square, an aggregate."""
    return F.sqrt(F.avg(dbl(x) * dbl(x)))


def describe(df: DataFrame, x: ColumnLike, by: Columns = ()) -> DataFrame:
    """``mean, std, min, max, median, p5, p95, rms``: population deviation, exact linear percentiles, NaN if any is."""
    x = dbl(x)
    plain = {"mean": F.avg(x), "std": F.stddev_pop(x), "min": nan_min(x), "max": F.max(x), "rms": rms(x)}
    return _with_percentiles(df, x, {"median": 0.5, "p5": 0.05, "p95": 0.95}, plain, by, ("mean", "std", "min", "max", "median", "p5", "p95", "rms"))


def _with_percentiles(df: DataFrame, x: Column, shares: dict[str, float], plain: dict[str, Column], by: Columns, names: Sequence[str]) -> DataFrame:
    """The plain aggregates and exact percentiles of each sequence; a percentile is NaN if any value is."""
    keys = [c if isinstance(c, str) else f"_b{i}" for i, c in enumerate(by)]
    bad = F.max(F.isnan(x).cast("int")) == 1
    left = df.groupBy(*[col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(*[c.alias(n) for n, c in plain.items()], bad.alias("_bad"))
    right = percentiles(df, x, list(shares.values()), [col(c) for c in by])
    if by:
        same = reduce(lambda p, q: p & q, [left[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(keys)])
        both = left.join(right, same, "left")
    else:
        both = left.join(F.broadcast(right), F.lit(True), "left")  # a row each
    exact = {n: F.when(F.col("_bad"), F.lit(NAN)).otherwise(F.col(f"_p{i}")) for i, n in enumerate(shares)}
    return both.select(*keys, *[exact.get(n, F.col(n)).alias(n) for n in names])


def tracking_error(df: DataFrame, actual: ColumnLike, reference: ColumnLike, by: Columns = ()) -> DataFrame:
    """``mean`` (signed), ``max`` (of absolute values), ``rms``, ``std`` of actual - reference."""
    e = dbl(actual) - dbl(reference)
    return df.groupBy(*map(col, by)).agg(F.avg(e).alias("mean"), F.max(F.abs(e)).alias("max"), rms(e).alias("rms"), F.stddev_pop(e).alias("std"))


def stepinfo(df: DataFrame, actual: ColumnLike, target: ColumnLike, t: ColumnLike, by: Columns, order: Columns) -> DataFrame:
    """``rise_time, settling_time, overshoot, steady_state_error`` of a step response, one row a sequence.

    The target is its last value; rise is from 10 % to 90 % of the step at sample times; settling is the time,
    on the clock of ``t``, of the first sample after the last one outside 2 % of the step. NaN where a level is
    never reached, the last sample is outside, or there is no step.
    """
    keys = [c if isinstance(c, str) else f"_k{i}" for i, c in enumerate(by)]
    w = sequence(by, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    y, goal, t = dbl(actual), dbl(target), dbl(t)
    rows = df.select(
        *[col(c).alias(k) for c, k in zip(by, keys, strict=True)],
        y.alias("y"), t.alias("t"), F.row_number().over(w).alias("n"), F.lead(t).over(w).alias("after"),
        F.first(y).over(whole).alias("y0"), F.last(y).over(whole).alias("y1"), F.last(goal).over(whole).alias("yf"),
    )
    rows = rows.withColumn("dy", F.col("yf") - F.col("y0"))
    up, step = F.col("dy") > 0, F.abs("dy") >= 1e-12
    past = lambda share: F.when(up, F.col("y") >= F.col("y0") + share * F.col("dy")).otherwise(F.col("y") <= F.col("y0") + share * F.col("dy"))
    outside = F.abs(F.col("y") - F.col("yf")) > 0.02 * F.abs("dy")
    each = rows.groupBy(*keys).agg(
        F.first("dy").alias("dy"), F.first("yf").alias("yf"), F.first("y1").alias("y1"), F.max("y").alias("hi"), F.min("y").alias("lo"),
        F.min_by("t", F.when(past(0.1), F.col("n"))).alias("t10"), F.min_by("t", F.when(past(0.9), F.col("n"))).alias("t90"),
        F.min_by("t", "n").alias("t0"), F.max(F.when(outside, F.struct("n", "after"))).alias("last"),
    )
    over = F.greatest(F.when(up, F.col("hi") - F.col("yf")).otherwise(F.col("yf") - F.col("lo")) / F.abs("dy") * 100.0, F.lit(0.0))
    settled = F.when(F.col("last").isNull(), F.col("t0")).otherwise(F.coalesce("last.after", F.lit(NAN)))
    return each.select(
        *keys,
        F.when(step, F.coalesce(F.col("t90") - F.col("t10"), F.lit(NAN))).otherwise(F.lit(NAN)).alias("rise_time"),
        F.when(step, settled).otherwise(F.lit(NAN)).alias("settling_time"),
        F.when(step, over).otherwise(F.lit(0.0)).alias("overshoot"),
        F.abs(F.col("y1") - F.col("yf")).alias("steady_state_error"),
    )


def _steps(df: DataFrame, t: ColumnLike, by: Columns, order: Columns, bounds: Bounds) -> tuple[DataFrame, list[str]]:
    keys = [c if isinstance(c, str) else f"_k{i}" for i, c in enumerate(by)]
    places = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*[col(c).alias(k) for c, k in zip(by, keys, strict=True)], dbl(t).alias("t"), *[col(o).alias(p) for o, p in zip(order, places, strict=True)])
    rows, was, _, _ = neighbouring(rows, keys, places, bounds, t=F.col("t"))
    return rows.select(*keys, "t", F.struct(*places).alias("n"), was["t"].alias("before"), (F.col("t") - was["t"]).alias("dt")), keys


def _rate(count: Column) -> dict[str, Column]:
    zero = lambda x: F.when(count < 2, F.lit(0.0)).otherwise(x)
    mean, std = F.avg("dt"), F.stddev_pop("dt")
    hz = F.when(mean > 0, 1.0 / F.when(mean > 0, mean)).otherwise(F.lit(0.0))
    std_hz = F.when(mean > 0, std / F.when(mean > 0, mean * mean)).otherwise(F.lit(0.0))
    return {"mean_hz": zero(hz), "std_hz": zero(std_hz), "mean_dt": zero(mean), "std_dt": zero(std), "min_dt": zero(F.min("dt")), "max_dt": zero(F.max("dt")), "duration": zero(F.max_by("t", "n") - F.min_by("t", "n"))}


def topic_rate(df: DataFrame, t: ColumnLike, by: Columns, order: Columns, bounds: Bounds = None) -> DataFrame:
    """``count, mean_hz, std_hz, min_dt, max_dt, duration``; zeros for fewer than two rows. std_hz is
    std(dt) / mean(dt) ** 2."""
    rows, keys = _steps(df, t, by, order, bounds)
    r = _rate(F.count("*"))
    return rows.groupBy(*keys).agg(F.count("*").alias("count"), *[r[k].alias(k) for k in ("mean_hz", "std_hz", "min_dt", "max_dt", "duration")])


def latency_chain(df: DataFrame, t: ColumnLike, by: Columns, order: Columns, bounds: Bounds = None) -> DataFrame:
    """``mean_hz, mean_dt, std_dt, min_dt, max_dt`` of each topic, in order of the topics' names."""
    rows, keys = _steps(df, t, by, order, bounds)
    r = _rate(F.count("*"))
    return rows.groupBy(*keys).agg(*[r[k].alias(k) for k in ("mean_hz", "mean_dt", "std_dt", "min_dt", "max_dt")]).orderBy(*keys)


def message_gaps(df: DataFrame, expected_rate: float, t: ColumnLike, by: Columns, order: Columns, bounds: Bounds = None) -> DataFrame:
    """``start, end, duration, expected_count`` of each step longer than 1.5 periods; counts round half to even."""
    if not expected_rate > 0:
        raise ValueError("expected_rate must be positive")
    rows, keys = _steps(df, t, by, order, bounds)
    gaps = rows.where(F.col("dt") > 1.5 / expected_rate)
    count = F.rint(F.col("dt") * F.lit(float(expected_rate))).cast("long")
    return gaps.select(*keys, F.col("before").alias("start"), F.col("t").alias("end"), F.col("dt").alias("duration"), count.alias("expected_count"))


def with_delay(df: DataFrame, published: ColumnLike, received: ColumnLike, out: str = "delay") -> DataFrame:
    return df.withColumn(out, dbl(received) - dbl(published))


def topic_delay(df: DataFrame, published: ColumnLike, received: ColumnLike, by: Columns = ()) -> DataFrame:
    """``mean, max`` (signed), ``std, median`` of received - published. The series itself: :func:`with_delay`."""
    d = dbl(received) - dbl(published)
    plain = {"mean": F.avg(d), "max": F.max(d), "std": F.stddev_pop(d)}
    return _with_percentiles(df, d, {"median": 0.5}, plain, by, ("mean", "max", "std", "median"))
