"""Time alignment: nearest match, common time base, resampling, pose interpolation.

Rows of both sides stand in one order of time, and the neighbours of a row are the last and first known struct
before and after it, found in segments of time (:mod:`tideline.operators.segments`). No range join, no collect, and no
sequence, nor a whole table without ``by``, is one task's work. Column names that begin with ``_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.geometry import slerp
from tideline.functions.numeric import dbl
from tideline.operators.segments import around, running_sums, span

Names = Sequence[str]
#: Points of a grid that one row is spread into at a time.
STRETCH = 1 << 16


def match_by_time(queries: DataFrame, source: DataFrame, t: str, source_t: str, by: Names = (), source_order: Names = (), suffix: str = "_source") -> DataFrame:
    """Each query row with the source row nearest in time (``matched`` struct, ``matched_index`` from 0).

    A tie goes to the earlier row; outside the source's range its first or last row matches. Of rows with the
    query's own time the last in ``source_order`` matches, of later ones with one time the first. Nulls if the
    group has no source rows. Queries keep all their rows, in any order.
    """
    bounds = span(queries.select(dbl(t)), source.select(dbl(source_t)))
    s = source.select(*by, dbl(source_t).alias("_t"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(source_order)], F.struct(*[F.col(c) for c in source.columns]).alias("_row"))
    s = running_sums(s, {"_i": F.lit(1).cast("long")}, by, ["_t", *[f"_o{i}" for i in range(len(source_order))]], bounds)
    s = s.withColumn("_i", (F.col("_i") - 1).cast("int"))
    s = s.select(*by, "_t", F.lit(0).alias("_side"), "_i", F.struct("_t", "_i", "_row").alias("_hit"))
    q = queries.select(*by, dbl(t).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("int").alias("_i"), F.struct(*[F.col(c) for c in queries.columns]).alias("_q"))
    both = s.withColumn("_q", F.lit(None).cast(q.schema["_q"].dataType)).unionByName(q.withColumn("_hit", F.lit(None).cast(s.schema["_hit"].dataType)))
    both = around(both, {"_m": F.col("_hit")}, by, ["_t", "_side", "_i"], bounds).where("_side = 1")
    before, after = F.col("_m_before"), F.col("_m_after")
    left = after.isNull() | (before.isNotNull() & ((F.col("_t") - before["_t"]) <= (after["_t"] - F.col("_t"))))
    hit = F.when(left, before).otherwise(after)
    return both.select("_q.*", hit["_i"].alias("matched_index"), hit["_row"].alias(f"matched{suffix}"))


def _numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def _known(df: DataFrame, c: str) -> Column:
    """``struct<_t, v>`` of a value that is neither null nor NaN; numbers as double."""
    v = F.col(c).cast("double") if _numeric(df, c) else F.col(c)
    return F.when(v.isNotNull() & (~F.isnan(v) if _numeric(df, c) else F.lit(True)), F.struct(F.col("_t"), v.alias("v")))


def _at(numeric: bool, left: Column, right: Column) -> Column:
    """A number on the straight line from ``left`` to ``right`` (structs ``_t, v``), held where there is no right one;
    others carried forward."""
    if not numeric:
        return left["v"]
    t = F.col("_t")
    line = left["v"] + (right["v"] - left["v"]) * (t - left["_t"]) / (right["_t"] - left["_t"])
    return F.when(left.isNull(), F.lit(None).cast("double")).when(right.isNull() | (left["_t"] == t) | (right["_t"] == left["_t"]), left["v"]).otherwise(line)


def align_time(a: DataFrame, b: DataFrame, t: str, by: Names = (), suffixes: tuple[str, str] = ("_a", "_b"), strict: bool = True, order: Names = ()) -> DataFrame:
    """Both frames on the union of their times within their common span, one row a time.

    Numbers are interpolated in time, other columns carried forward; gaps (null or NaN) inside are bridged. Times that
    a sequence repeats are a ValueError; ``strict=False`` saves the pass that looks for them. Of the rows of such a time
    the last in ``order``, columns of both frames, then counts at that time and after it, the first before it.
    """
    if strict:
        sides = [df.select(*by, F.col(t), F.lit(n).alias("_side")) for n, df in enumerate((a, b))]
        if not repeated_times(sides[0].unionByName(sides[1]), t, [*by, "_side"]).isEmpty():
            raise ValueError("align_time: a sequence repeats a time")
    bounds = span(a.select(dbl(t)), b.select(dbl(t)))
    rows, values, out, places = [], {}, {}, [f"_o{i}" for i in range(len(order))]
    for side, (df, suffix) in enumerate(zip((a, b), suffixes, strict=True)):
        columns = [c for c in df.columns if c != t and c not in by]
        seen = df.withColumn("_t", dbl(t))
        there = F.struct(F.col("_t"), F.lit(True).alias("v")).alias(f"_is{side}")
        rows.append(seen.select(*by, "_t", F.lit(side).alias("_side"), *[F.col(c).alias(n) for n, c in zip(places, order, strict=True)], there, *[_known(df, c).alias(f"_{side}_{c}") for c in columns]))
        values |= {f"_is{side}": F.col(f"_is{side}")} | {f"_{side}_{c}": F.col(f"_{side}_{c}") for c in columns}
        out |= {f"{c}{suffix}": (f"_{side}_{c}", _numeric(df, c)) for c in columns}
    both = rows[0].unionByName(rows[1], allowMissingColumns=True)
    both = around(both, values, by, ["_t", "_side", *places], bounds)
    # Of the two rows of a time the second sees both sides.
    both = both.where((F.col("_side") == 1) | F.col("_is1_after").isNull() | (F.col("_is1_after")["_t"] != F.col("_t")))
    for side in (0, 1):
        before, after = F.col(f"_is{side}_before"), F.col(f"_is{side}_after")
        both = both.where(before.isNotNull() & (after.isNotNull() | (before["_t"] == F.col("_t"))))
    result = [F.col("_t").alias(t), *[_at(numeric, F.col(f"{n}_before"), F.col(f"{n}_after")).alias(c) for c, (n, numeric) in out.items()]]
    if strict:
        return both.select(*by, *result)
    # The last row of a time has seen all of it.
    return both.groupBy(*by, "_t").agg(F.max_by(F.struct(*result), F.struct("_side", *places)).alias("_row")).select(*by, "_row.*")


def repeated_times(df: DataFrame, t: str, by: Names = ()) -> DataFrame:
    """Times that occur more than once in a sequence, with their counts."""
    return df.groupBy(*by, t).count().where("count > 1")


def resample(df: DataFrame, dt: float, t: str, by: Names = ()) -> DataFrame:
    """Each sequence on its grid t0 + k * dt, the end excluded, filled as in :func:`align_time`.

    A grid has as many rows as its span holds steps, so a ``dt`` far too small gives a frame far too long.
    """
    if not dt > 0:
        raise ValueError("dt must be positive")
    x = dbl(t)
    ends = (df.groupBy(*by) if by else df.groupBy()).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")).where("_lo < _hi")
    n = F.ceil((F.col("_hi") - F.col("_lo")) / F.lit(float(dt))).cast("long")
    # In two steps, so that no row holds a whole grid.
    grid = ends.select(*by, "_lo", n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / STRETCH))).alias("_s"))
    first = F.col("_s") * STRETCH
    grid = grid.select(*by, "_lo", F.explode(F.sequence(first, F.least(first + STRETCH, F.col("_n")) - 1)).alias("_k"))
    grid = grid.select(*by, (F.col("_lo") + F.col("_k") * F.lit(float(dt))).alias("_t"), F.lit(1).alias("_side"))
    columns = [c for c in df.columns if c != t and c not in by]
    rows = df.withColumn("_t", x).select(*by, "_t", F.lit(0).alias("_side"), *[_known(df, c).alias(f"_c_{c}") for c in columns])
    both = around(rows.unionByName(grid, allowMissingColumns=True), {f"_c_{c}": F.col(f"_c_{c}") for c in columns}, by, ["_t", "_side"], span(df.select(x)))
    return both.where("_side = 1").select(*by, F.col("_t").alias(t), *[_at(_numeric(df, c), F.col(f"_c_{c}_before"), F.col(f"_c_{c}_after")).alias(c) for c in columns])


def interp_pose(df: DataFrame, targets: DataFrame, t: str, position: str = "position", orientation: str = "orientation", target_t: str | None = None, by: Names = ()) -> DataFrame:
    """Poses at the times of ``targets``: x and y on straight lines, held outside the span; orientation by SLERP.

    Past the last row the orientation is the last one, with the sign that is nearer to the row before.
    """
    target_t = target_t or t
    p, q = F.col(position), F.col(orientation)
    bounds = span(df.select(dbl(t)), targets.select(dbl(target_t)))
    quat = F.struct(*[q[n].cast("double").alias(n) for n in "xyzw"])
    rows = df.select(*by, dbl(t).alias("_t"), p["x"].cast("double").alias("_x"), p["y"].cast("double").alias("_y"), quat.alias("_q"))
    rows = around(rows, {"_q": F.col("_q")}, by, ["_t"], bounds, strict=True).withColumnRenamed("_q_before", "_p")
    dot = sum((F.col(f"_q.{n}") * F.col(f"_p.{n}") for n in "yzw"), F.col("_q.x") * F.col("_p.x"))
    turned = F.struct(*[(F.when(dot < 0, -F.col(f"_q.{n}")).otherwise(F.col(f"_q.{n}"))).alias(n) for n in "xyzw"])
    s = rows.select(*by, "_t", F.lit(0).alias("_side"), F.struct("_t", "_x", "_y", "_q", turned.alias("_s")).alias("_hit"))
    g = targets.select(*by, dbl(target_t).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in targets.columns]).alias("_row"))
    both = s.withColumn("_row", F.lit(None).cast(g.schema["_row"].dataType)).unionByName(g.withColumn("_hit", F.lit(None).cast(s.schema["_hit"].dataType)))
    both = around(both, {"_m": F.col("_hit")}, by, ["_t", "_side"], bounds).where("_side = 1")
    lo, hi = F.col("_m_before"), F.col("_m_after")
    width = hi["_t"] - lo["_t"]
    alpha = F.when(width == 0, 1.0).otherwise((F.col("_t") - lo["_t"]) / F.when(width == 0, 1.0).otherwise(width))
    xy = [F.when(lo.isNull(), hi[c]).when(hi.isNull(), lo[c]).otherwise(lo[c] + (hi[c] - lo[c]) * alpha) for c in ("_x", "_y")]
    turn = F.when(lo.isNull(), hi["_q"]).when(hi.isNull(), lo["_s"]).otherwise(slerp(lo["_q"], hi["_q"], alpha))
    return both.select("_row.*", F.struct(xy[0].alias("x"), xy[1].alias("y")).alias(position), turn.alias(orientation))
