"""Exact length histogram: documents by encoded length, and what its suffix sums answer.

One row a distinct length, so every answer is exact whatever the number of documents. Null texts have
length 0; repeated rows count each. An empty table gives an empty histogram.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.bpe import TOKENIZER, token_count
from tideline.llm.common import save, small_batches, table

#: Lengths of one stretch of the histogram; its suffix sums need one task a stretch.
STRETCH = 256


def length_histogram(docs: DataFrame, path: str) -> DataFrame:
    """``n_tokens, n_docs``, one row a distinct encoded length."""
    small_batches(docs.sparkSession)
    return docs.select(token_count(F.col("text"), path).alias("n_tokens")).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram, as a context limit:

    ``docs_at_least`` and ``tokens_at_least`` (documents of L tokens or more, and their tokens),
    ``docs_total``, ``tokens_total``, ``truncated_total`` (tokens left when every text is cut to L),
    ``whole_docs`` (texts that fit) and ``quantile`` (share of texts of at most L tokens).

    Sums run within stretches of lengths, then over the few sums of stretches, so no task sees all lengths.
    """
    h = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / STRETCH).alias("_s"), (F.col("n_tokens") * F.col("n_docs")).alias("_t"))
    by = h.groupBy("_s").agg(F.sum("n_docs").alias("_sd"), F.sum("_t").alias("_st"))
    later = W.orderBy(F.desc("_s")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    by = by.select(
        "_s",
        F.coalesce(F.sum("_sd").over(later), F.lit(0)).alias("_ld"), F.coalesce(F.sum("_st").over(later), F.lit(0)).alias("_lt"),
        F.sum("_sd").over(everything).alias("docs_total"), F.sum("_st").over(everything).alias("tokens_total"),
    )
    within = W.partitionBy("_s").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    h = h.withColumns({"_wd": F.sum("n_docs").over(within), "_wt": F.sum("_t").over(within)}).join(by, "_s")
    at_least, tokens = F.col("_wd") + F.col("_ld"), F.col("_wt") + F.col("_lt")
    return h.select(
        "n_tokens", "n_docs", at_least.alias("docs_at_least"), tokens.alias("tokens_at_least"), "docs_total", "tokens_total",
        (F.col("tokens_total") - tokens + at_least * F.col("n_tokens")).alias("truncated_total"),
        (F.col("docs_total") - at_least + F.col("n_docs")).alias("whole_docs"),
    ).withColumn("quantile", F.round(F.col("whole_docs") / F.col("docs_total"), 9))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row ``truncated_total``: tokens kept at any context limit, from the first length at or over it."""
    at = F.min(F.when(F.col("n_tokens") >= limit, F.struct("n_tokens", "docs_at_least", "tokens_at_least", "tokens_total"))).alias("f")
    return sums.agg(at, F.max("tokens_total").alias("all")).select(
        F.coalesce(F.col("f.tokens_total") - F.col("f.tokens_at_least") + F.col("f.docs_at_least") * limit, F.col("all"), F.lit(0)).alias("truncated_total")
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row ``n_tokens``: the least length that a share ``q`` of the documents doesn't exceed."""
    return sums.where(F.col("whole_docs") >= F.ceil(F.col("docs_total") * F.lit(float(q)))).agg(F.min("n_tokens").alias("n_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(save(length_histogram(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)), "lengths"))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
