"""BPE encoding and decoding of whole texts with the tokenization automaton, and counts of tokens.

Null texts count as empty (no ids); repeated rows are encoded each; columns but the id and the text are
not read, so clashing names do no harm.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.automaton import Codec
from tideline.llm.common import give_back, released, small_batches, table

TOKENIZER = "byte_bpe_50k.json"


@functools.lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """The compiled automaton of a Python worker: tables of fixed size (about 40 MB), whatever it has read."""
    made = Codec(path)
    give_back()
    return made


def encoded(text: Column, path: str) -> Column:
    """``array<int>``: the ids of the whole text."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(pd.Series(codec(path).encode_all(texts.to_numpy()), dtype=object) for texts in batches)

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """``string``: what the arcs ``ids`` emit; null and empty give the empty text."""

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        c = codec(path)
        return rows.map(lambda ids: c.decode([] if ids is None else ids))

    return decode(ids)


def token_count(text: Column, path: str) -> Column:
    """``bigint``: the number of ids, without keeping them."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(pd.Series(codec(path).counts(texts.to_numpy())) for texts in batches)

    return count(text)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, encoded and decoded in one pass.

    The hashes take a long text run by run, so neither its ids nor what they emit is ever held whole.
    """

    def of(texts: pd.Series) -> pd.DataFrame:
        n = np.zeros(len(texts), np.int64)
        hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in range(len(texts))]
        for k, more, ids, emitted in codec(path).written(texts.to_numpy()):
            of_ids, of_text = hashes[k]
            of_ids.update(("," + ids if n[k] and ids else ids).encode())
            try:
                emitted.decode()
            except UnicodeDecodeError:
                emitted = emitted.decode("utf-8", "replace").encode()
            of_text.update(emitted)
            n[k] += more
        return pd.DataFrame({"n_tokens": n, "ids_sha256": [a.hexdigest() for a, _ in hashes], "decoded_sha256": [b.hexdigest() for _, b in hashes]})

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from released(map(of, batches))

    small_batches(docs.sparkSession)
    return docs.select("doc_id", digest("text").alias("_d")).select("doc_id", "_d.*")


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES = {"op3_bpe_roundtrip": op3_bpe_roundtrip}
ORACLES: dict[str, str] = {}
