"""Language identification by error-correcting output codes over character n-grams.

Each language has a codeword; a logistic classifier on hashed 1- to 3-grams predicts each bit. Decoding sums
a loss over the bits, weighted by how well the bit's classifier does on the sample, and takes the language
whose codeword loses least; where the runner-up is close the answer is marked ambiguous.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import fold, released, small_batches, table

#: Documented bound of the training sample: documents, whole texts.
TRAIN_ROWS = 4000
BINS = 1 << 13
#: Share of the total below which the two best languages are too close to call.
MARGIN = 0.1
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_MUL = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def ngrams(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed 1-, 2- and 3-grams of the whole lower-case text (length BINS)."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    if not len(c):
        return np.zeros(BINS, np.float32)
    h1 = c * _MUL[0]
    h2 = (h1[:-1] ^ (c[1:] + _MUL[3])) * _MUL[1]
    h3 = (h2[:-1] ^ (c[2:] + _MUL[3])) * _MUL[2]
    counts = np.zeros(BINS)
    for h in (h1, h2, h3):
        counts += np.bincount(h >> np.uint32(19), minlength=BINS) / max(1, len(h))
    return np.sqrt(counts).astype(np.float32)


def _sparse(x: np.ndarray) -> bytes:
    """Places and values of what isn't zero."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


def _dense(packed: bytes) -> np.ndarray:
    n, x = len(packed) // 6, np.zeros(BINS, np.float32)
    x[np.frombuffer(packed, "<u2", n)] = np.frombuffer(packed, "<f4", n, 2 * n)
    return x


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """A row of +1/-1 for each language: the exhaustive code up to 6, else random columns of the best of 50 draws
    by the least distance between two rows."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        columns = [c for c in itertools.product([1, -1], repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    draws = [rng.choice([-1.0, 1.0], (n, bits)) for _ in range(50)]
    return max(draws, key=lambda m: min(int((m[i] != m[j]).sum()) for i, j in itertools.combinations(range(n), 2)))


@dataclass
class CodeModel:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bit_weight: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of each language's codeword, by row."""
        margin = np.clip(np.hstack([x, np.ones((len(x), 1), np.float32)]) @ self.weights, -30, 30)
        return np.stack([np.log1p(np.exp(-margin * code)) @ self.bit_weight for code in self.codes], 1)

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        names, scores, close = [], [], []
        for text in texts:  # one row of features at a time
            if not text or not self.languages or not _LETTER.search(text):
                names.append(UNKNOWN), scores.append(0.0), close.append(True)
                continue
            loss = self.losses(ngrams(text)[None, :])[0]
            p = np.exp(loss.min() - loss)
            p /= p.sum()
            best = np.sort(p)[::-1]
            names.append(self.languages[int(loss.argmin())])
            scores.append(round(float(best[0]), 6))
            close.append(bool(len(best) > 1 and best[0] - best[1] < MARGIN))
        return pd.DataFrame({"lang_pred": names, "score": scores, "ambiguous": close})


def train(docs: DataFrame, limit: int = TRAIN_ROWS, steps: int = 120) -> CodeModel:
    """Learn from text and non-null lang of a bounded sample outside fold 2: the first ``limit`` distinct rows by hash.

    Texts are read whole, and in the tasks: the driver gets the n-grams of ``limit`` rows at most. Texts without a
    letter teach nothing.
    """

    @F.pandas_udf("binary")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(pd.Series([_sparse(ngrams(t)) if _LETTER.search(t) else None for t in texts], dtype=object) for texts in batches)

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id") != 2))
    rows = rows.withColumn("_k", F.xxhash64("doc_id", "text", "lang"))
    few = rows.select("_k").distinct().orderBy("_k").limit(limit)
    rows = rows.join(F.broadcast(few), "_k").dropDuplicates(["_k"])  # broadcast: at most `limit` hashes
    rows = rows.select("_k", "lang", counted("text").alias("x")).where(F.col("x").isNotNull()).toPandas()
    rows = rows.sort_values("_k")
    languages = sorted(set(rows["lang"]))
    codes = codewords(len(languages))
    if not languages:
        return CodeModel([], codes, np.zeros((BINS + 1, 1), np.float32), np.ones(1))
    x = np.ones((len(rows), BINS + 1), np.float32)
    for row, packed in zip(x, rows["x"], strict=True):
        row[:BINS] = _dense(packed)
    y = codes[[languages.index(v) for v in rows["lang"]]].astype(np.float32)
    # Rows of frequent languages weigh less, so each language weighs the same.
    counts = rows["lang"].value_counts()
    row_weight = np.array([len(rows) / len(languages) / counts[v] for v in rows["lang"]], np.float32)[:, None]
    w, z, momentum = np.zeros((BINS + 1, codes.shape[1]), np.float32), np.zeros((BINS + 1, codes.shape[1]), np.float32), 1.0
    step = 4.0 / float((row_weight[:, 0] * (x**2).sum(1)).mean())
    for _ in range(steps):
        grad = -(x.T @ (row_weight * y / (1 + np.exp(np.clip(y * (x @ z), -30, 30))))) / len(x) + 1e-6 * z
        new = z - step * grad
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z, w, momentum = new + np.float32((momentum - 1) / following) * (new - w), new, following
    right = ((x @ w) * y > 0).mean(0).clip(0.5, 0.999)
    bit_weight = np.log(right / (1 - right))
    return CodeModel(languages, codes, w, bit_weight / max(bit_weight.sum(), 1e-9) * codes.shape[1])


def identified(text: Column, model: CodeModel) -> Column:
    """``struct<lang_pred, score, ambiguous>``; null texts and texts without a letter: ``und``, 0, ambiguous."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from released(map(model.predict, batches))

    return identify(text)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    found = docs.select("doc_id", (fold("doc_id") == 2).alias("held_out"), identified(F.col("text"), model).alias("_l"))
    return found.select("doc_id", "held_out", "_l.*")


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}
