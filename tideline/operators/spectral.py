"""Operators with no relational form: spectra, zero-phase filters, cross-correlation. Grouped numpy kernels.

One sequence is one task in ``fft`` and ``delay_estimate``, for the transform needs all of it: 16 and 24 bytes a row, so
sequences should stay under some 100 million rows. ``lowpass`` cuts long ones into chunks. ``dft`` is the relational
form of ``fft`` for short sequences.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.numeric import sequence
from tideline.operators.segments import chunks

Names = Sequence[str]
#: Samples that a filter takes in one matrix product, and rows of a sequence that are filtered in one task.
BLOCK, CHUNK = 256, 1 << 18


def _keyed(df: DataFrame, by: Names, order: Names, **values: str) -> DataFrame:
    return df.select(*by, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c).cast("double").alias(n) for n, c in values.items()])


def _sorted(pdf: pd.DataFrame, order: Names) -> pd.DataFrame:
    return pdf.sort_values([f"_o{i}" for i in range(len(order))], kind="stable")


def _schema(df: DataFrame, by: Names, **fields: T.DataType) -> T.StructType:
    return T.StructType([df.schema[b] for b in by] + [T.StructField(n, t) for n, t in fields.items()])


def _key_columns(pdf: pd.DataFrame, by: Names, n: int) -> dict[str, list]:
    return {b: [pdf[b].iloc[0]] * n for b in by}


def amplitude_spectrum(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and amplitudes of the real transform: 2/n, but 1/n at zero frequency (not at half of fs)."""
    n = len(x)
    a = np.abs(np.fft.rfft(x)) * 2 / n
    a[0] /= 2
    return np.arange(len(a)) * fs / n, a


def fft(df: DataFrame, x: str, fs: float, by: Names, order: Names) -> DataFrame:
    """``by..., frequency, amplitude`` of each sequence."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        f, a = amplitude_spectrum(_sorted(pdf, order)["x"].to_numpy(), fs)
        return pd.DataFrame({**_key_columns(pdf, by, len(f)), "frequency": f, "amplitude": a})

    d = T.DoubleType()
    return _keyed(df, by, order, x=x).groupBy(*by).applyInPandas(kernel, _schema(df, by, frequency=d, amplitude=d))


def dft(df: DataFrame, x: str, fs: float, by: Names, order: Names, max_rows: int = 4096) -> DataFrame:
    """The same as :func:`fft` in DataFrame operations, with work that grows with the square of a sequence.

    Raises for sequences of over ``max_rows`` rows.
    """
    w = sequence(by, order)
    rows = df.select(*by, F.col(x).cast("double").alias("_x"), (F.row_number().over(w) - 1).alias("_i"))
    packed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_v"))
    n = F.when(F.size("_v") > max_rows, F.raise_error(F.lit("dft: sequence too long; use fft"))).otherwise(F.size("_v"))
    packed = packed.withColumn("_n", n)
    bins = packed.select(*by, "_v", "_n", F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / 2).cast("int"))).alias("_k"))
    angle = lambda s: 2.0 * np.pi * ((F.col("_k") * s["_i"]) % F.col("_n")) / F.col("_n")
    re = F.aggregate("_v", F.lit(0.0), lambda a, s: a + s["_x"] * F.cos(angle(s)))
    im = F.aggregate("_v", F.lit(0.0), lambda a, s: a - s["_x"] * F.sin(angle(s)))
    scale = F.when(F.col("_k") == 0, 1.0).otherwise(2.0) / F.col("_n")
    return bins.select(*by, (F.col("_k") * float(fs) / F.col("_n")).alias("frequency"), (F.hypot(re, im) * scale).alias("amplitude"))


def butterworth(order: int, cutoff: float, fs: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a digital low-pass: analog prototype, prewarped, bilinear; unit gain at 0."""
    if not 0 < cutoff < fs / 2:
        raise ValueError("cutoff must lie between 0 and fs / 2")
    if order < 1:
        raise ValueError("order must be at least 1")
    warped = 2 * np.tan(np.pi * cutoff / fs)
    sections = []
    for k in range(order // 2):
        p = warped * np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
        z = (2 + p) / (2 - p)
        a = np.array([1.0, -2 * z.real, abs(z) ** 2])
        sections.append((np.array([1.0, 2.0, 1.0]) * a.sum() / 4, a))
    if order % 2:
        z = (2 - warped) / (2 + warped)
        sections.append((np.array([1.0, 1.0, 0.0]) * (1 - z) / 2, np.array([1.0, -z, 0.0])))
    return sections


class _Section:
    """A second-order section as matrices over a block of BLOCK samples: the block's output from its input and from the
    state before it, and the state behind it."""

    def __init__(self, b: np.ndarray, a: np.ndarray):
        step, inward = np.array([[-a[1], 1.0], [-a[2], 0.0]]), b[1:] - a[1:] * b[0]
        powers = [np.eye(2)]
        for _ in range(BLOCK):
            powers.append(step @ powers[-1])
        answer = np.array([b[0], *[(p @ inward)[0] for p in powers[: BLOCK - 1]]])
        at = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
        self.own = np.where(at >= 0, answer[np.maximum(at, 0)], 0.0).T
        self.from_state = np.array([p[0] for p in powers[:BLOCK]]).T
        self.to_state = np.array([p @ inward for p in powers[BLOCK - 1 :: -1]])
        self.behind = powers[BLOCK].T
        self.steady = np.array([1 - b[0], b[2] - a[2]])

    def run(self, x: np.ndarray) -> np.ndarray:
        """The section's output, started in the steady state of the first sample."""
        blocks = np.pad(x, (0, -len(x) % BLOCK)).reshape(-1, BLOCK)
        adds, states = blocks @ self.to_state, np.empty((len(blocks), 2))
        state = self.steady * x[0]
        for i, add in enumerate(adds):
            states[i] = state
            state = state @ self.behind + add
        return (blocks @ self.own + states @ self.from_state).ravel()[: len(x)]


def _padding(sections: list[tuple[np.ndarray, np.ndarray]]) -> int:
    return 3 * (2 * len(sections) + 1 - min(sum(b[2] == 0 for b, _ in sections), sum(a[2] == 0 for _, a in sections)))


def zero_phase(x: np.ndarray, cutoff: float, fs: float, order: int = 4) -> np.ndarray:
    """Forward and backward low-pass of ``x``, its ends extended by odd reflection."""
    sections = butterworth(order, cutoff, fs)
    pad = _padding(sections)
    if len(x) <= pad:
        raise ValueError(f"lowpass needs more than {pad} samples, got {len(x)}")
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    compiled = [_Section(b, a) for b, a in sections]
    for _ in range(2):
        for section in compiled:
            y = section.run(y)
        y = y[::-1]
    return y[pad:-pad]


def settling(cutoff: float, fs: float, order: int = 4) -> int:
    """Samples after which a low-pass has forgotten its start but for a part in 10^13."""
    sections = butterworth(order, cutoff, fs)
    slowest = max(np.abs(np.roots(a[:2] if a[2] == 0 else a)).max() for _, a in sections)
    return max(_padding(sections), int(np.ceil(np.log(1e-15) / np.log(slowest))))


def lowpass(df: DataFrame, x: str, cutoff: float, fs: float, by: Names, order: Names, degree: int = 4, out: str = "lowpass", bounds: tuple[float, float] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Zero-phase Butterworth low-pass of each sequence: ``by..., order..., out``.

    With ``bounds`` (``segments.span`` of the first of ``order``, a number) a sequence of over ``chunk`` rows is cut
    into chunks that are filtered apart, each with as many rows of its neighbours as the filter remembers
    (:func:`settling`). Without, a sequence is one task.
    """
    butterworth(degree, cutoff, fs)
    keyed = _keyed(df, by, order, x=x)
    schema = T.StructType([df.schema[b] for b in by] + [df.schema[o] for o in order] + [T.StructField(out, T.DoubleType())])

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf, order)
        y = zero_phase(pdf["x"].to_numpy(), cutoff, fs, degree)
        if "_own" in pdf:
            own = pdf["_own"].to_numpy()
            pdf, y = pdf[own], y[own]
        return pd.DataFrame({b: pdf[b] for b in by} | {o: pdf[f"_o{i}"] for i, o in enumerate(order)} | {out: y})

    if bounds is None:
        return keyed.groupBy(*by).applyInPandas(kernel, schema)
    beside = settling(cutoff, fs, degree)
    chunk = max(chunk, 2 * beside)
    rows = chunks(keyed, by, [f"_o{i}" for i in range(len(order))], bounds, chunk, beside)
    return rows.groupBy(*by, "_chunk").applyInPandas(kernel, schema)


def best_lag(command: np.ndarray, response: np.ndarray) -> int:
    """The lag of the response that maximises the full cross-correlation, the first of equals; by FFT."""
    n = len(command)
    size = 1 << int(np.ceil(np.log2(max(2, 2 * n - 1))))
    c = np.fft.irfft(np.fft.rfft(response, size) * np.conj(np.fft.rfft(command, size)), size)
    full = np.concatenate([c[-(n - 1) :] if n > 1 else c[:0], c[:n]])
    close = full >= full.max() - 1e-9 * max(1.0, np.abs(full).max())
    return int(np.flatnonzero(close)[0]) - (n - 1)


def delay_estimate(df: DataFrame, command: str, response: str, t: str, by: Names, order: Names) -> DataFrame:
    """``by..., delay``: lag of the response behind the command, in units of ``t`` (mean step times lag)."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf, order)
        dt = float(np.diff(pdf["t"]).mean()) if len(pdf) > 1 else float("nan")
        return pd.DataFrame({**_key_columns(pdf, by, 1), "delay": [best_lag(pdf["c"].to_numpy(), pdf["r"].to_numpy()) * dt]})

    return _keyed(df, by, order, c=command, r=response, t=t).groupBy(*by).applyInPandas(kernel, _schema(df, by, delay=T.DoubleType()))
