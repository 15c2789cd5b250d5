"""Navigation in nested messages, flat views, arrays to columns, and plot-ready frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.numeric import ColumnLike, col, dbl, sequence, with_aggregates


def leaves(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted paths of all leaf fields, in definition order; arrays are leaves."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += leaves(f.dataType, f"{path}.") if isinstance(f.dataType, T.StructType) else [path]
    return out


def flatten_fields(df: DataFrame, sep: str = ".") -> DataFrame:
    """One column a leaf, named by its path. With the separator "." names need backticks."""
    return df.select(*[F.col(p).alias(p.replace(".", sep)) for p in leaves(df.schema)])


class Fields:
    """A validated path into a frame's schema: ``msg(df).twist.linear.x.col``, ``msg(df)["twist"].df``."""

    def __init__(self, frame: DataFrame, path: str = "", kind: T.DataType | None = None):
        self._frame, self._path, self._kind = frame, path, kind if kind is not None else frame.schema

    def _child(self, name: str) -> Fields:
        if isinstance(self._kind, T.StructType) and name in self._kind.names:
            return Fields(self._frame, f"{self._path}.{name}" if self._path else name, self._kind[name].dataType)
        raise AttributeError(f"No fields matching {f'{self._path}.{name}' if self._path else name!r}")

    def __getattr__(self, name: str) -> Fields:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._child(name)

    def __getitem__(self, name: str) -> Fields:
        return self._child(name)

    @property
    def col(self) -> Column:
        return F.col(self._path)

    @property
    def df(self) -> DataFrame:
        """The columns below this path with the path stripped; a leaf gives one column."""
        if not self._path:
            return self._frame
        return self._frame.select(f"{self._path}.*" if isinstance(self._kind, T.StructType) else self._path)

    def __repr__(self) -> str:
        return f"Fields({self._path or '*'}: {self._kind.simpleString()})"


def msg(df: DataFrame) -> Fields:
    return Fields(df)


def explode_array(df: DataFrame, array: ColumnLike, names: Sequence[str] | None = None, keep: Sequence[ColumnLike] = (), check: bool = True) -> DataFrame:
    """One column an element (named 0, 1, ... by default); short rows give null.

    The width is the longest row's, found by one aggregate; names must be as many. ``check=False`` saves that pass where
    names are given: a row that is longer then fails when it is read.
    """
    a = col(array)
    if names is not None and not check:
        long = F.when(F.size(a) > len(names), F.raise_error(F.lit(f"names has {len(names)} entries for a longer row")).cast("array<int>"))
        return df.where(long.isNull()).select(*map(col, keep), *[F.get(a, i).alias(n) for i, n in enumerate(names)])
    width = df.agg(F.max(F.size(a)).alias("n")).first()["n"] or 0
    if names is None:
        names = [str(i) for i in range(width)]
    elif width and len(names) != width:
        raise ValueError(f"names has {len(names)} entries for {width} elements")
    return df.select(*map(col, keep), *[F.get(a, i).alias(n) for i, n in enumerate(names)])


def element_fields(array: ColumnLike, path: str) -> Column:
    """The array of one (dotted) field of each message in a message array."""

    def step(x: Column) -> Column:
        for name in path.split("."):
            x = x[name]
        return x

    return F.transform(col(array), step)


def zip_by_position(a: DataFrame, b: DataFrame, order_a: Sequence[ColumnLike], order_b: Sequence[ColumnLike], by: Sequence[str] = ()) -> DataFrame:
    """Rows of two frames paired by position within each sequence, for comparisons with positional tools only."""
    x = a.withColumn("_n", F.row_number().over(sequence(by, order_a)))
    y = b.withColumn("_n", F.row_number().over(sequence(by, order_b)))
    return x.join(y, [*by, "_n"]).drop("_n")


# Plot-ready frames: what a chart draws, computed where the data are.


def plot_timeseries(df: DataFrame, t: ColumnLike, series: dict[str, ColumnLike], by: Sequence[ColumnLike] = (), points: int | None = None) -> DataFrame:
    """``by..., t, label, value``; with ``points``, the extremes of each of so many equal spans of time."""
    each = F.array(*[F.struct(F.lit(n).alias("label"), dbl(c).alias("value")) for n, c in series.items()])
    rows = df.select(*map(col, by), dbl(t).alias("t"), F.explode(each).alias("_s")).select(*[c for c in by], "t", "_s.label", "_s.value")
    if points is None:
        return rows
    w = Window.partitionBy(*by, "label")
    low, span = F.min("t").over(w), F.max("t").over(w) - F.min("t").over(w)
    bucket = F.when(span > 0, F.least(F.floor((F.col("t") - low) / F.when(span > 0, span) * points), F.lit(points - 1))).otherwise(F.lit(0))
    cut = rows.withColumn("_b", bucket).groupBy(*by, "label", "_b").agg(F.array(F.min(F.struct("value", "t")), F.max(F.struct("value", "t"))).alias("e"))
    return cut.select(*by, "label", F.explode(F.array_distinct("e")).alias("p")).select(*by, "p.t", "label", "p.value")


def plot_xy_trajectory(df: DataFrame, x: ColumnLike, y: ColumnLike, by: Sequence[ColumnLike], order: Sequence[ColumnLike], reference: tuple[ColumnLike, ColumnLike] | None = None) -> DataFrame:
    """``by..., path, seq, x, y, is_start, is_end`` of the path and of the reference path."""
    w = sequence(by, order)
    paths = [F.struct(F.lit("path").alias("path"), dbl(x).alias("x"), dbl(y).alias("y"))]
    if reference:
        paths.append(F.struct(F.lit("reference").alias("path"), dbl(reference[0]).alias("x"), dbl(reference[1]).alias("y")))
    rows = df.select(*map(col, by), (F.row_number().over(w) - 1).alias("seq"), F.lead(F.lit(1)).over(w).isNull().alias("is_end"), F.array(*paths).alias("_all"))
    rows = rows.select(*by, "seq", "is_end", F.explode("_all").alias("_p"))  # apart: in one select the rows would be numbered after the explode
    return rows.select(*by, "_p.path", "seq", "_p.x", "_p.y", (F.col("seq") == 0).alias("is_start"), "is_end")


def plot_step_response(df: DataFrame, t: ColumnLike, actual: ColumnLike, target: ColumnLike, by: Sequence[ColumnLike] = ()) -> DataFrame:
    """``by..., t, actual, target, band_lo, band_hi``: the band is 2 % of the target's size."""
    goal = dbl(target)
    return df.select(*map(col, by), dbl(t).alias("t"), dbl(actual).alias("actual"), goal.alias("target"), (goal - 0.02 * F.abs(goal)).alias("band_lo"), (goal + 0.02 * F.abs(goal)).alias("band_hi"))


def plot_error_band(df: DataFrame, t: ColumnLike, error: ColumnLike, by: Sequence[ColumnLike] = (), sigma: float | None = None) -> DataFrame:
    """``by..., t, error, lower, upper``: a band of one population deviation, or of ``sigma``."""
    e = dbl(error)
    if sigma is None:
        df = with_aggregates(df, by, _sigma=F.stddev_pop(e))
    s = F.lit(float(sigma)) if sigma is not None else F.col("_sigma")
    return df.select(*map(col, by), dbl(t).alias("t"), e.alias("error"), (-s).alias("lower"), s.alias("upper"))


def render(frame: DataFrame, kind: str = "line"):
    """Axes of a plot-ready frame, where matplotlib is installed (ImportError otherwise). Collects the frame."""
    import matplotlib.pyplot as plt

    pdf, (_, ax) = frame.toPandas(), plt.subplots()
    if "label" in pdf:
        for name, g in pdf.groupby("label"):
            ax.plot(g["t"], g["value"], label=name)
        ax.legend()
    elif "path" in pdf:
        for name, g in pdf.sort_values("seq").groupby("path"):
            ax.plot(g["x"], g["y"], label=name)
        ax.set_aspect("equal")
    else:
        for c in pdf.columns.difference(["t"]):
            ax.plot(pdf["t"], pdf[c], label=c)
        ax.legend()
    return ax
