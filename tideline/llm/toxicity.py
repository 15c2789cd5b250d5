"""Toxicity by cumulative-link ordinal regression on sparse text features.

Labels say only toxic or not, so grades of severity are made from them: 0 for a clean document, 1 to 3 for a
toxic one by how many distinct marker features it holds, a marker being a feature that toxic training
documents have far more often than clean ones. One weight vector serves all thresholds:
P(grade >= k) = sigmoid(w x - theta_k). Weights are fitted with an L1 penalty by accelerated proximal
gradient steps, so features that say nothing weigh exactly nothing and long clean texts gather no score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import forget, labelled_sample, released, save, small_batches, table

#: Documented bound of the training sample: labelled documents, whole texts.
TRAIN_ROWS = 12_000
GRADES = 4
#: A feature in fewer training documents than MIN_DOCS, or in more than this share of the distinct clean ones, has
#: no weight. Equal texts count MIN_DOCS times at most, so copies have weights of their own but don't crowd out others.
MIN_DOCS = 4
MAX_SHARE = 0.08
PREFIX = 6

_NOT_WORD = re.compile(r"[\W_]+")


def features(text: str | None) -> set[str]:
    """The distinct lower-case words of the whole text, and the first letters of longer ones as ``prefix~``.

    Null and empty texts have none.
    """
    if not text:
        return set()
    found = set(_NOT_WORD.split(text.lower()))
    found.discard("")
    return found | {w[:PREFIX] + "~" for w in found if len(w) > PREFIX}


def hashed(names: list[str]) -> np.ndarray:
    """64-bit hashes that stand for features in the training sample."""
    return pd.util.hash_array(np.array(names, dtype=object), categorize=False)


def _hashes(text: str) -> Column:
    """The sorted hashes of the text's features as bytes, so that the driver holds neither texts nor words."""

    @F.pandas_udf("binary")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(pd.Series([np.sort(hashed(list(features(t)))).tobytes() for t in texts], dtype=object) for texts in batches)

    return found(F.col(text))


def _named(text: str, hashes: np.ndarray) -> Column:
    """The text's features whose hashes are in ``hashes``."""

    @F.pandas_udf("array<string>")
    def names(texts: pd.Series) -> pd.Series:
        each = [np.array(list(features(t)), dtype=object) for t in texts]
        return pd.Series([list(x[np.isin(hashed(x), hashes)]) for x in each], dtype=object)

    return names(F.col(text))


@dataclass
class OrdinalModel:
    """Weights by feature and the rising thresholds of grades 1, 2, ..."""

    weights: dict[str, float]
    thetas: np.ndarray

    def score(self, text: str | None) -> float:
        get = self.weights.get
        return sum(filter(None, map(get, features(text)))) if self.weights else 0.0

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) by row, for k = 1 and up."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thetas[None, :] - scores[:, None], -50, 50)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, penalty: float = 5e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and thresholds of the cumulative logit model; ``rows`` hold the feature numbers of each
    document. Minimises the mean of the binary losses of all thresholds plus ``penalty`` * |w|."""
    k = int(grades.max()) if len(grades) else 1
    at = np.concatenate(rows) if rows else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    reached = (grades[:, None] >= np.arange(1, k + 1)).astype(float)
    share = np.clip(reached.mean(0), 1e-3, 1 - 1e-3)
    w, theta = np.zeros(n_features), np.log((1 - share) / share)
    wz, tz, momentum = w.copy(), theta.copy(), 1.0
    # Each loss has a curvature of at most 1/4 along the row's features and its threshold.
    norm, v = 1.0, np.ones(n_features) / np.sqrt(max(n_features, 1))
    for _ in range(20):
        u = np.bincount(at, np.bincount(row, v[at], len(rows))[row], n_features)
        norm = np.linalg.norm(u)
        v = u / max(norm, 1e-12)
    step = len(rows) / (0.25 * k * (norm * 1.05 + len(rows)))
    for _ in range(steps):
        x = np.bincount(row, wz[at], len(rows))
        error = 1.0 / (1.0 + np.exp(np.clip(tz[None, :] - x[:, None], -50, 50))) - reached
        grad = np.bincount(at, error.sum(1)[row], n_features) / len(rows)
        w_new = wz - step * grad
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - step * penalty, 0)
        t_new = np.sort(tz + step * error.mean(0))
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        wz = w_new + (momentum - 1) / following * (w_new - w)
        tz = t_new + (momentum - 1) / following * (t_new - theta)
        w, theta, momentum = w_new, t_new, following
    return w, theta


def severity(rows: list[np.ndarray], toxic: np.ndarray, n_features: int) -> np.ndarray:
    """Grades 0 to 3 from the labels: toxic documents by their number of distinct markers (0-1, 2-3, more)."""
    share = []
    for bad in (1, 0):
        mine = [r for r, t in zip(rows, toxic, strict=True) if t == bad]
        share.append(np.bincount(np.concatenate(mine) if mine else np.empty(0, np.int64), minlength=n_features) + 0.5 * (1 - bad))
        share[-1] = share[-1] / max(1, len(mine))
    marker = (share[0] > 20 * share[1]) & (share[0] * max(1, toxic.sum()) >= MIN_DOCS)
    hits = np.array([int(marker[r].sum()) for r in rows])
    return np.where(toxic > 0, 1 + (hits >= 2) + (hits >= 4), 0)


def _counted(sample: DataFrame) -> DataFrame:
    """``hash, n, clean``: rows of the sample that hold a feature, equal texts MIN_DOCS times at most, and distinct clean
    texts among them. Summed up within batches before the shuffle."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sizes = f["found"].str.len().to_numpy() // 8
            number, at = np.unique(np.frombuffer(b"".join(f["found"]), np.int64), return_inverse=True)
            n, clean = (np.bincount(at, np.repeat(x.to_numpy(), sizes), len(number)).astype(np.int64) for x in (f["times"], 1 - f["toxic"]))
            yield pd.DataFrame({"hash": number, "n": n, "clean": clean})

    rows = sample.select("found", "times", "toxic").mapInPandas(lambda f: released(each(f)), "hash long, n long, clean long")
    return rows.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"))


def _numbered(used: np.ndarray) -> Column:
    """The places in ``used`` (sorted) of the features that stand there, as int32 bytes."""

    def of(packed: bytes) -> bytes:
        x = np.sort(np.frombuffer(packed, np.int64))
        at = np.searchsorted(used, x)
        return at[(at < len(used)) & (used[np.minimum(at, len(used) - 1)] == x)].astype("<i4").tobytes() if len(used) else b""

    @F.pandas_udf("binary")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(pd.Series([of(x) for x in found], dtype=object) for found in batches)

    return places("found")


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on a bounded labelled sample. Without both toxic and clean labels nothing is ever toxic.

    Features are counted in tasks; the driver gets those that enough texts hold, and their numbers by text.
    """
    small_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, "toxic", limit).groupBy("text").agg(F.avg((F.col("label") > 0).cast("int")).alias("share"), F.count("*").alias("times"))
    toxic = (F.col("share") >= 0.5).cast("int").alias("toxic")  # the label of most copies
    sample = save(rows.select("text", F.md5(F.col("text").cast("binary")).alias("key"), toxic, F.least("times", F.lit(MIN_DOCS)).alias("times"), _hashes("text").alias("found")), "toxic")
    seen = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not seen["n"] or seen["toxic"] in (0, seen["n"]):
        forget(sample)
        return OrdinalModel({}, np.full(GRADES - 1, 50.0))
    common = max(MIN_DOCS, MAX_SHARE * (seen["n"] - seen["toxic"]))
    used = np.sort(_counted(sample).where((F.col("n") >= MIN_DOCS) & (F.col("clean") <= common)).select("hash").toPandas()["hash"].to_numpy(np.int64))
    rows = sample.select("key", "toxic", "times", _numbered(used).alias("at")).toPandas().sort_values("key")
    times = rows["times"].to_numpy()
    found = [np.frombuffer(x, "<i4") for x, n in zip(rows["at"], times, strict=True) for _ in range(n)]
    toxic = np.repeat(rows["toxic"].to_numpy(), times)
    w, theta = fit_ordinal(found, severity(found, toxic, len(used)), len(used))
    weight = {int(used.view(np.uint64)[i]): float(w[i]) for i in np.flatnonzero(w)}
    named = sample.select(F.explode(_named("text", np.array(list(weight), np.uint64))).alias("name")).distinct().toPandas()["name"].tolist()
    forget(sample)
    return OrdinalModel({x: weight[int(h)] for x, h in sorted(zip(named, hashed(named), strict=True))}, theta)


def graded(text: Column, model: OrdinalModel) -> Column:
    """``struct<severity: double, p_toxic: double, grade: int>``: expected grade, P(grade >= 1), likeliest grade."""

    def of(texts: pd.Series) -> pd.DataFrame:
        p = model.at_least(np.array([model.score(t) for t in texts], dtype=float))
        each = -np.diff(np.hstack([np.ones((len(p), 1)), p, np.zeros((len(p), 1))]), axis=1)
        return pd.DataFrame({"severity": p.sum(1).round(6), "p_toxic": p[:, 0].round(6), "grade": each.argmax(1).astype("int32")})

    @F.pandas_udf("severity double, p_toxic double, grade int")
    def grade(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from released(map(of, batches))

    return grade(text)


def drop_toxic(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """The documents, with their own columns only, whose P(grade >= 1) lies under ``threshold``. Null texts stay."""
    return docs.where(graded(F.col("text"), model)["p_toxic"] < threshold)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, severity, p_toxic, grade, toxic`` of every document; toxic where P(grade >= 1) >= 0.5."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", graded(F.col("text"), model).alias("_g")).select("doc_id", "_g.*", (F.col("_g.p_toxic") >= 0.5).alias("toxic"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
