"""Quality rules as a short-circuit cascade, in DataFrame operations only.

The cost of each rule, and which documents it rejects, are measured on a sample of those that pass the base, for the
cascade sees no others. Rules then stand in the order of rejections per second, each one's rejections counted among
the documents that the rules before it leave, and the first that rejects a document spares it the rest. The order
changes the cost, never the verdict. Null texts have no words; they, empty texts and texts of under 20 words fail the base. Repeated rows
are judged each; columns but id and text are not read.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import forget, let, save, table, words

SYMBOL = "[#*$%&|<>]"
WINDOW = 8
#: Documents that costs and selectivity are estimated on, about; each rule is timed on so many copies of them, several times.
SAMPLE_ROWS, COPIES, TIMES = 300, 16, 3


def n_repeat_words(w: Column) -> Column:
    """Words of the array ``w`` that lie in a window of 8 words found twice or more in it."""
    n = F.size(w)
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    windows = let(hashes, lambda h: F.transform(F.slice(h, 1, n - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])))

    def covered(v: Column) -> Column:
        # Windows in order of their hash stand beside their equals; then their places, in order, each cover 8 words.
        placed = F.array_sort(F.transform(v, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(placed, lambda s: F.transform(F.filter(F.transform(s, lambda x, j: F.when(
            (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])), lambda p: p.isNotNull()), lambda p: p))
        return F.aggregate(
            F.sort_array(again), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"],
        )

    some = let(windows, lambda v: F.when(F.size(F.array_distinct(v)) < F.size(v), covered(v)).otherwise(F.lit(0)))
    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(some).cast("long")


def with_base(docs: DataFrame) -> DataFrame:
    """``doc_id, text, _w`` (words), ``n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"), words(text).alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")).alias("_l"))
    d = d.select(
        "doc_id", "text", "_w", F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", SYMBOL, -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.size("_l").cast("long").alias("n_lines"),
        n_repeat_words(F.col("_w")).alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


#: name -> SQL condition under which a document is rejected, over the columns of :func:`with_base`.
RULES = {
    "word_length": "word_chars < 2 * n_words OR word_chars > 16 * n_words",
    "symbols": "n_symbols * 2 > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "few_letters": r"word_chars > 2 * length(regexp_replace(text, r'[\x00-@\[-`{-\x7f]+', ''))",
    "shouting": "2 * length(regexp_replace(text, '[^A-Z]+', '')) > word_chars",
    "few_words": "size(array_distinct(_w)) / greatest(n_words, 1) < 0.05D",
    "exclaims": "2 * length(regexp_replace(text, '[^!?]+', '')) > n_words",
}


def condition(rule: str | Column) -> Column:
    return F.expr(rule) if isinstance(rule, str) else rule


def order_rules(sample: DataFrame, rules: dict[str, str | Column]) -> list[tuple[str, float, float]]:
    """(name, share rejected of what earlier rules leave, seconds) of each rule on the sample, in the order of the
    cascade: always the rule with the most rejections per second among the documents that are left, then by name.

    A rule's seconds are the least of TIMES runs over COPIES of each row, less those of a rule that does nothing.
    """
    rows = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))

    def seconds(what: Column) -> float:
        took = []
        for _ in range(TIMES):
            begun = time.perf_counter()
            rows.agg(F.count(F.when(what, F.col("_copy")))).first()
            took.append(time.perf_counter() - begun)
        return min(took)

    names = sorted(rules)
    verdicts = [F.coalesce(condition(rules[n]), F.lit(False)) for n in names]
    # At most a row for each set of rules, or for each document of the sample.
    sets = sample.select(F.array(*verdicts).alias("v")).groupBy("v").count().collect() if names else []
    seconds(F.lit(False))
    base = seconds(F.lit(False))
    cost = [max(seconds(v) - base, 1e-4) for v in verdicts]
    found, left = [], set(range(len(names)))
    while left:
        total = sum(r["count"] for r in sets) or 1
        share = {i: sum(r["count"] for r in sets if r["v"][i]) / total for i in left}
        best = min(left, key=lambda i: (-share[i] / cost[i], names[i]))
        found.append((names[best], share[best], cost[best]))
        left.remove(best)
        sets = [r for r in sets if not r["v"][best]]
    return found


def cascade(rules: dict[str, str | Column], order: list[str]) -> Column:
    """The first rule of the order that rejects, or null; later rules are not evaluated then."""
    verdict = F
    for name in order:
        verdict = verdict.when(condition(rules[name]), F.lit(name))
    return verdict.otherwise(F.lit(None).cast("string")) if order else F.lit(None).cast("string")


def judge(docs: DataFrame, rules: dict[str, str | Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The columns of :func:`with_base` and ``kept``. The sample decides the order of the rules only."""
    rules = RULES if rules is None else rules
    based = with_base(docs)
    # By a share of the ids, so that about ``sample_rows`` pass without a limit that one task would have to apply.
    share = max(1, docs.count() // max(1, sample_rows))
    some = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    sample = save(with_base(some), "rule-sample")  # written first: a condition on the base would be pushed down to all rows
    order = [name for name, _, _ in order_rules(sample.where(~F.col("base_failed")), rules)]
    forget(sample)
    return based.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(rules, order).isNull()))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[ \x09-\x0D]+'), lambda w: w <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \x09-\x0D]')) AS l FROM t),
g AS (SELECT r, i, md5(array_to_string(w[i:i + 7], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
p AS (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS n FROM g),
q AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS b FROM p WHERE n > 1),
u AS (SELECT r, sum(CASE WHEN b IS NULL THEN 8 ELSE least(8, i - b) END)::BIGINT AS n FROM q GROUP BY r),
b AS (SELECT w.r, doc_id, text, w, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[ \x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines, coalesce(u.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN u ON w.r = u.r),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 16 * n_words OR n_symbols * 2 > n_words OR 100 * n_dup_lines > 30 * n_lines
            OR word_chars > 2 * length(regexp_replace(text, '[\x00-@\[-`{-\x7f]+', '', 'g'))
            OR 2 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > word_chars
            OR len(list_distinct(w)) / greatest(n_words, 1) < 0.05
            OR 2 * (length(text) - length(translate(text, '!?', ''))) > n_words) AS kept
FROM f
"""

QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {"op9_quality_rules": ORACLE}
