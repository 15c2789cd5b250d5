"""Rates over live topics, an extension: windowed with a watermark, or kept up over the whole stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_rate(stream: DataFrame, ts: str, by: list[str], window: str, late: str, slide: str | None = None) -> DataFrame:
    """``window, by..., count, mean_hz`` of each window, closed once the watermark has passed it."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    counts = stream.withWatermark(ts, late).groupBy(w.alias("window"), *by).agg(F.count(F.lit(1)).alias("count"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    span = (F.unix_micros("_hi") - F.unix_micros("_lo")) / F.lit(1e6)
    return counts.select("window", *by, "count", F.when(span > 0, (F.col("count") - 1) / F.when(span > 0, span)).otherwise(F.lit(0.0)).alias("mean_hz"))


def running_rate(stream: DataFrame, topic: str, t: str) -> DataFrame:
    """``topic, count, mean_hz, std_hz, min_dt, max_dt, duration`` so far of each topic that got rows.

    State: first and last time, count, sums of dt and dt squared, extremes. Within a batch rows are put in order
    of time; a row older than the topic's last one is dropped.
    """
    state = "first double, last double, n long, s double, q double, lo double, hi double"
    out = f"{topic} string, count long, mean_hz double, std_hz double, min_dt double, max_dt double, duration double"

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n, s, q, lo, hi = held.get if held.exists else (None, None, 0, 0.0, 0.0, float("inf"), 0.0)
        for x in sorted(v for f in frames for v in f["t"]):
            if last is not None and x < last:
                continue
            if last is not None:
                dt = x - last
                s, q, lo, hi = s + dt, q + dt * dt, min(lo, dt), max(hi, dt)
            first, last, n = x if first is None else first, x, n + 1
        held.update((first, last, n, s, q, lo, hi))
        k = n - 1
        mean = s / k if k > 0 else 0.0
        std = max(q / k - mean * mean, 0.0) ** 0.5 if k > 0 else 0.0
        row = [1 / mean, std / mean**2, lo, hi, last - first] if mean > 0 else [0.0, 0.0, 0.0, 0.0, 0.0]
        yield pd.DataFrame([[key[0], n, *row]], columns=[topic, "count", "mean_hz", "std_hz", "min_dt", "max_dt", "duration"])

    rows = stream.select(topic, F.col(t).cast("double").alias("t"))
    return rows.groupBy(topic).applyInPandasWithState(update, out, state, "update", GroupStateTimeout.NoTimeout)
