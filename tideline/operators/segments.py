"""Neighbours and running sums along a sequence in segments of time, so that no sequence is one task's work.

A sequence is cut into SEGMENTS equal spans of its order's first column. Windows run within a segment, and a row a
segment (its first and last known values, its sums) carries over what lies in other ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numeric import with_aggregates

Names = Sequence[str]
SEGMENTS = 1024


def span(*times: DataFrame) -> tuple[float, float]:
    """The least and greatest finite time of frames of one column each: one pass over that column."""
    t = reduce(DataFrame.union, [df.select(F.col(df.columns[0]).cast("double").alias("t")) for df in times])
    row = t.where(F.abs("t") < float("inf")).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    return (0.0, 0.0) if row["lo"] is None else (row["lo"], row["hi"])


def segment(t: Column, lo: float, hi: float) -> Column:
    """The number of the segment, rising with ``t`` in Spark's order: -1 for null, SEGMENTS for NaN."""
    at = F.least(F.greatest(F.floor((t - lo) / F.lit((hi - lo) or 1.0) * SEGMENTS), F.lit(0)), F.lit(SEGMENTS - 1))
    return F.when(t.isNull(), -1).when(F.isnan(t), SEGMENTS).otherwise(at).cast("int")


def _joined(d: DataFrame, edges: DataFrame, by: Names, columns: list[str]) -> DataFrame:
    """``d`` with the columns of its segment's row; null keys are keys as in windows."""
    keys = [*by, "_seg"]
    right = edges.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *columns)
    same = reduce(lambda x, y: x & y, [d[k].eqNullSafe(right[f"_k_{k}"]) for k in by], d["_seg"] == right["_k__seg"])
    return d.join(right, same, "left").drop(*[f"_k_{k}" for k in keys])


def _across(edges: DataFrame, by: Names) -> tuple[DataFrame, Column, Column]:
    """Windows over the rows of segments before and after one, of one sequence: SEGMENTS + 2 rows at most."""
    edges = edges.withColumn("_all", F.floor((F.col("_seg") + 1) / (2 * SEGMENTS)))  # 0; a key also where ``by`` is empty
    w, frame = Window.partitionBy(*by, "_all"), (Window.unboundedPreceding, -1)
    return edges, w.orderBy("_seg").rowsBetween(*frame), w.orderBy(F.desc("_seg")).rowsBetween(*frame)


def around(df: DataFrame, values: dict[str, Column], by: Names, order: Names, bounds: tuple[float, float], strict: bool = False, after: bool = True) -> DataFrame:
    """``df`` and, for each value, ``<name>_before`` and, if ``after``, ``<name>_after``: the last one that isn't null at or before a row
    and the first at or after it (``strict``: without the row itself), in the order of ``order``, a time and what makes
    the order total. ``bounds`` are those of the time (:func:`span`)."""
    d = df.withColumns({"_seg": segment(F.col(order[0]).cast("double"), *bounds), **{f"_v_{n}": v for n, v in values.items()}})
    place = F.struct(*order)
    ends = []
    for n in values:
        known = F.when(F.col(f"_v_{n}").isNotNull(), place)
        ends += [F.max_by(f"_v_{n}", known).alias(f"_l_{n}"), F.min_by(f"_v_{n}", known).alias(f"_f_{n}")]
    edges, earlier, later = _across(d.groupBy(*by, "_seg").agg(*ends), by)
    carried = [F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_p_{n}") for n in values]
    carried += [F.last(f"_f_{n}", ignorenulls=True).over(later).alias(f"_n_{n}") for n in values]
    edges = edges.select(*by, "_seg", *carried)

    w, frame = Window.partitionBy(*by, "_seg"), (Window.unboundedPreceding, -1 if strict else Window.currentRow)
    up = w.orderBy(*order).rowsBetween(*frame)
    down = w.orderBy(*[F.desc(c) for c in order]).rowsBetween(*frame)  # a frame that ends at the last row would be read anew for every row
    sides = [("before", up, "p"), ("after", down, "n")][: 1 + after]
    local = {f"{n}_{side}": F.last(f"_v_{n}", ignorenulls=True).over(w_) for n in values for side, w_, _ in sides}
    d = _joined(d.withColumns(local), edges, by, [f"_{x}_{n}" for n in values for x in "pn"])
    full = {f"{n}_{side}": F.coalesce(f"{n}_{side}", f"_{x}_{n}") for n in values for side, _, x in sides}
    return d.withColumns(full).drop("_seg", *[f"_{x}_{n}" for n in values for x in "vpn"])


def running_sums(df: DataFrame, values: dict[str, Column], by: Names, order: Names, bounds: tuple[float, float]) -> DataFrame:
    """``df`` and, under each name, the sum of the values up to and with a row."""
    d = df.withColumns({"_seg": segment(F.col(order[0]).cast("double"), *bounds), **{f"_v_{n}": v for n, v in values.items()}})
    edges, earlier, _ = _across(d.groupBy(*by, "_seg").agg(*[F.sum(f"_v_{n}").alias(f"_l_{n}") for n in values]), by)
    edges = edges.select(*by, "_seg", *[F.sum(f"_l_{n}").over(earlier).alias(f"_p_{n}") for n in values])
    up = Window.partitionBy(*by, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = _joined(d.withColumns({n: F.sum(f"_v_{n}").over(up) for n in values}), edges, by, [f"_p_{n}" for n in values])
    total = {n: F.when(F.col(f"_p_{n}").isNull(), F.col(n)).when(F.col(n).isNull(), F.col(f"_p_{n}")).otherwise(F.col(n) + F.col(f"_p_{n}")) for n in values}
    return d.withColumns(total).drop("_seg", *[f"_{x}_{n}" for n in values for x in "vp"])


def chunks(df: DataFrame, by: Names, order: Names, bounds: tuple[float, float], chunk: int, beside: int) -> DataFrame:
    """``df`` in chunks of ``chunk`` rows of a sequence, each with ``beside`` rows (fewer than a chunk) of its neighbours:
    ``_chunk``, and ``_own``, which is false for the neighbours' rows."""
    rows = running_sums(df, {"_i": F.lit(1).cast("long")}, by, order, bounds).withColumn("_i", F.col("_i") - 1)
    first, last = (F.floor((F.col("_i") + F.lit(d)) / chunk) for d in (-beside, beside))
    rows = rows.withColumn("_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    rows = rows.withColumn("_own", F.col("_chunk") == F.floor(F.col("_i") / chunk)).drop("_i")
    # A chunk that lies wholly behind the end holds a neighbour's rows only.
    return with_aggregates(rows, [*by, "_chunk"], _any=F.max("_own")).where("_any").drop("_any")


def accumulated(df: DataFrame, state: Column, step: Callable[[Column, Column], Column], by: Names, order: Names, bounds: tuple[float, float], out: str) -> DataFrame:
    """``df`` and, under ``out``, the sum of ``step(state before, state)`` over the rows so far: 0 at the first. Steps that
    are null count 0. ``state`` is a struct, so that the row before is told from none."""
    d = df.withColumns({"_seg": segment(F.col(order[0]).cast("double"), *bounds), "_state": state})
    w = Window.partitionBy(*by, "_seg").orderBy(*order)
    d = d.withColumn("_before", F.lag("_state").over(w))
    d = d.withColumn("_step", F.when(F.col("_before").isNotNull(), F.coalesce(step(F.col("_before"), F.col("_state")), F.lit(0.0))).otherwise(F.lit(0.0)))
    place = F.struct(*order)
    edges = d.groupBy(*by, "_seg").agg(F.sum("_step").alias("_sum"), F.min_by("_state", place).alias("_first"), F.max_by("_state", place).alias("_last"))
    edges, earlier, _ = _across(edges, by)
    edges = edges.withColumns({"_gone": F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)), "_left": F.last("_last").over(earlier)})
    edges = edges.withColumn("_join", F.when(F.col("_left").isNotNull(), F.coalesce(step(F.col("_left"), F.col("_first")), F.lit(0.0))).otherwise(F.lit(0.0)))
    joins = F.sum("_join").over(Window.partitionBy(*by, "_all").orderBy("_seg").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edges = edges.select(*by, "_seg", (F.col("_gone") + joins).alias("_offset"))
    local = F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = _joined(d.withColumn(out, local), edges, by, ["_offset"])
    return d.withColumn(out, F.col(out) + F.col("_offset")).drop("_seg", "_state", "_before", "_step", "_offset")


def percentiles(df: DataFrame, x: Column, shares: Sequence[float], by: Sequence) -> DataFrame:
    """``_k0, ..., _n, _p0, ...``: the keys ``by``, the number of values, and the exact percentiles, linear between ranks.

    Equal values are counted together, then ranked by running sums over segments of the values, so no task holds all
    values of a sequence. Nulls and NaN don't count.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[b.alias(k) for b, k in zip(by, keys, strict=True)], x.alias("_x")).where(x.isNotNull() & ~F.isnan(x))
    counts = rows.groupBy(*keys, "_x").agg(F.count("*").alias("_c"))
    counts = running_sums(counts, {"_upto": F.col("_c")}, keys, ["_x"], span(rows.select("_x")))
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    if keys:
        right = total.select(*[F.col(k).alias(f"_r{k}") for k in keys], "_n")
        same = reduce(lambda p, q: p & q, [counts[k].eqNullSafe(right[f"_r{k}"]) for k in keys])
        counts = counts.join(right, same).drop(*[f"_r{k}" for k in keys])
    else:
        counts = counts.crossJoin(F.broadcast(total))  # one row
    out = []
    for i, p in enumerate(shares):
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = (F.min(F.when(F.col("_upto") > f(rank), F.col("_x"))) for f in (F.floor, F.ceil))
        part = F.max(rank - F.floor(rank))
        out.append(F.when((part == 0) | (low == high), low).otherwise(low + (high - low) * part).alias(f"_p{i}"))
    return counts.groupBy(*keys).agg(F.max("_n").alias("_n"), *out)
