"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics of the whole text. Each partition
sums its share of the normal equations; Spark adds the shares cell by cell, and only the final matrix reaches
the driver. A part of the sample that the regression doesn't see calibrates its output (pool adjacent
violators), so scores are shares of good documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import fold, forget, labelled_sample, released, save, small_batches, table

#: Documented bound of the labelled sample: documents, whole texts.
TRAIN_ROWS = 20_000
N_FEATURES = 160
RIDGE = 1e-2
#: One of so many sample rows calibrates instead of fitting.
CALIBRATE = 4
THRESHOLD = 0.7

STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digits", "symbols", "bars", "marks", "white", "distinct_words",
    "top_word", "same_as_last", "line_words", "repeated_lines", "short_words", "long_words", "ends_in_symbol",
)
_SYMBOL = re.compile(r"[#*$%&<>{}\[\]^~=\\/@]")
_SYMBOL_END = re.compile(r"[#*$%&!|](?:\s|$)")


def statistics(text: str | None) -> list[float]:
    """The statistics named above, of the whole text; all zero if it is null or empty."""
    if not text:
        return [0.0] * len(STATISTICS)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, k = len(text), max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    freq = np.bincount(raw, minlength=128)
    return [
        np.log1p(n), np.log1p(len(words)), float(lengths.mean()), freq[65:91].sum() / n, freq[48:58].sum() / n, len(_SYMBOL.findall(text)) / k,
        freq[124] / k, freq[33] / k, 1 - lengths.sum() / n, len(counts) / k, max(counts.values(), default=0) / k,
        sum(map(str.__eq__, words, words[1:])) / k, k / max(1, len(lines)) / 100, 1 - len(set(lines)) / max(1, len(lines)),
        float((lengths <= 3).mean()), float((lengths >= 12).mean()), len(_SYMBOL_END.findall(text)) / k,
    ]


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), len(STATISTICS))


@dataclass
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def mapped(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of raw statistics, and a constant."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        phi = np.sqrt(2.0 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.hstack([phi, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.knots).clip(0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and means of the blocks, both rising."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def normal_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Sums of phi phi' and phi y over ``rows`` (``stats, label``), by partition and then by cell."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                phi = model.mapped(np.stack(f["stats"].to_numpy()))
                own = np.hstack([phi.T @ phi, (phi.T @ f["label"].to_numpy(float))[:, None]])
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"cell": np.arange(total.size), "v": total.ravel()})

    d = N_FEATURES + 1
    cells = rows.mapInPandas(part, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    full = np.zeros(d * (d + 1))
    full[cells["cell"]] = cells["v"]
    full = full.reshape(d, d + 1)
    return full[:, :d], full[:, d]


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, seed: int = 7) -> QualityModel:
    """Fit on a bounded labelled sample outside fold 2. Without labels every score is 1 (nothing is rejected)."""

    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(pd.Series(list(_matrix(texts))) for texts in batches)

    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", limit)
    part = F.conv(F.substring(F.md5(F.concat(F.lit("c"), F.col("doc_id").cast("string")).cast("binary")), 1, 4), 16, 10).cast("int") % CALIBRATE
    rows = save(sample.select("doc_id", stats("text").alias("stats"), F.col("label").cast("double").alias("label"), part.alias("part")), "quality-sample")
    width = len(STATISTICS)
    moments = rows.select([F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(width)] + [F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(width)] + [F.count("*").alias("n")]).first()
    rng = np.random.default_rng(seed)
    frequencies, phases = rng.normal(0, 0.35, (width, N_FEATURES)), rng.uniform(0, 2 * np.pi, N_FEATURES)
    one = np.zeros(N_FEATURES + 1)
    if not moments["n"]:
        forget(rows)
        return QualityModel(np.zeros(width), np.ones(width), frequencies, phases, one, (np.array([0.0]), np.array([1.0])))
    centre = np.array([moments[f"m{i}"] for i in range(width)])
    scale = np.array([moments[f"s{i}"] for i in range(width)])
    model = QualityModel(centre, np.where(scale > 1e-9, scale, 1.0), frequencies, phases, one, (np.array([0.0]), np.array([1.0])))
    a, b = normal_equations(rows.where("part > 0"), model)
    model.weights = np.linalg.solve(a + RIDGE * np.eye(len(a)), b)
    held = rows.where("part = 0").toPandas().sort_values("doc_id")
    forget(rows)
    if len(held):
        model.knots = isotonic(model.raw(np.stack(held["stats"].to_numpy())), held["label"].to_numpy(float))
    else:
        model.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def quality_score(text: Column, model: QualityModel) -> Column:
    """``double`` in 0..1, six digits; null and empty texts get the score of a text without words."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(pd.Series(model.score(_matrix(texts)).round(6), dtype=float) for texts in batches)

    return score(text)


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with their own columns only, whose score reaches ``threshold``."""
    return docs.where(quality_score(F.col("text"), model) >= threshold)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold("doc_id") == 2).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
