"""The corpus pipeline: toxicity, quality, near-duplicates, mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``docs``, whatever further ones these are and however they are named.
An empty table gives an empty one at each stage. Texts are read whole, of any length; repeated rows are rows of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, mixing, neardup, quality, toxicity
from tideline.llm.common import forget, save, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model calls toxic (P(grade >= 1) of 0.5 or more) go. Null and empty texts, which have no
    features, stay; equal texts go or stay together; without labels nothing goes."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score lies under 0.7 go. Null and empty texts have the score of a text without words; equal
    texts go or stay together; without labels nothing goes."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: that of the least id, and
    of rows that share it the one whose JSON has the least md5. Rows with null ids all stay, as do texts without words."""
    return neardup.drop_near_duplicates(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each copy a row, in the order of the training positions.

    Copies are joined to texts by the md5 of the whole row, which is one for rows that are equal only. Documents without
    words are not taken; null ids and sources are ids and a source; rows of one id have copies of their own.
    """
    key = F.md5(F.to_json(F.struct(*docs.columns)).cast("binary")).alias("_row_key")
    plan = mixing.schedule(mixing.mix(docs.select("doc_id", "source", "text", key), carry=("_row_key",)))
    plan = plan.select("_row_key", "position", F.col("source").alias("_source"), "epoch", F.col("doc_id").alias("_doc"))
    rows = docs.select(key, F.struct(*docs.columns).alias("_row")).groupBy("_row_key").agg(F.first("_row").alias("_row"))
    return plan.join(rows, "_row_key").orderBy("position", "_source", "epoch", "_doc", "_row_key").select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row that the mix took; null texts count as empty."""
    return bpe.digests(docs, public_tokenizers.path(bpe.TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder; what the stage before wrote is then deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return docs


#: Classifiers and BPE have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
