"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Each source has a weight schedule over training time 0..1. Its integral is the source's weight; the targets
are shares by weight, held at ``max_epochs`` times the source and shared anew until all fit. Within a source
documents stand in an order by hash; the copy that begins after ``m`` of ``target`` tokens gets the training
position at which the schedule's integral has reached ``m / target``, and the mix is range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import save, table, words

#: Integrated weight of the sources in the order of their names, repeating, and the slope of each schedule:
#: w(t) = weight * (1 + slope * (1 - 2 t)), so heavy sources lead early and light ones late.
WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (0.5, 0.0, -0.5)
#: Hash buckets of each source; one task sums a bucket, 1/4096 of a source.
DIGITS = 3


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """``source, source_size, weight, nth, target`` from ``source, source_size``, one row a source.

    Targets are level * weight, but at most ``max_epochs * source_size``: sources fill up in the order of
    cap / weight, so the level is what the open ones share when the next in that order no longer fills up.
    The windows run over one row a source. Null names come last.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(by_name) - 1
    t = sizes.select("source", "source_size", nth.alias("nth"))
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    fill = W.orderBy(F.col("cap") / F.col("weight"), "nth")
    before, everything = fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    t = t.withColumns({
        "_full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "_open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "_total": total,
    })
    # The level if all before this source are full and this and all later ones are open; it is the right one
    # at the first source that it leaves open, and later ones follow.
    t = t.withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open"))
    open_ = F.col("_level") * F.col("weight") < F.col("cap")
    level = F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("nth"), F.col("_level")))).over(everything)["_level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return t.withColumn("target", target).select("source", "source_size", "weight", "nth", "target")


def position(done: Column, slope: Column) -> Column:
    """The time at which a schedule 1 + slope * (1 - 2 t) has given the share ``done``: the root in 0..1 of
    slope * t^2 - (1 + slope) * t + done = 0."""
    root = ((1.0 + slope) - F.sqrt((1.0 + slope) * (1.0 + slope) - 4.0 * slope * done)) / (2.0 * F.when(slope == 0, 1.0).otherwise(slope))
    return F.when(slope == 0, done).otherwise(root)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, share: float = 1.5, max_epochs: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, weight, slope, copies, begins`` of every document, and the
    columns named in ``carry``.

    ``copies`` is how often the mix takes the whole document and ``begins`` the tokens of its source before it
    in the first epoch. A copy is taken if its middle lies below the target, so a source misses its target by
    half a document at most. Documents of a source with no words are not taken. Order within a source: md5 of
    the id, then the id, then the size. Repeated rows stand for themselves; null ids and sources are kept.

    Cumulative sizes are summed within ``16 ** DIGITS`` hash buckets of each source and then over the buckets'
    sums, so a source with a third of all rows isn't one task's work.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    d = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *carry).withColumn("_h", key)
    d = save(d.withColumn("_b", F.substring("_h", 1, DIGITS)), "sizes")  # else each use reads the texts
    sums = d.groupBy("source", "_b").agg(F.sum("size").alias("_size"))
    goal = targets(sums.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, max_epochs)
    goal = goal.withColumn("slope", F.element_at(F.array(*map(F.lit, slopes)), (F.col("nth") % len(slopes) + 1).cast("int")))
    ahead = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "_b", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead"))
    s, g = sums.alias("s"), goal.alias("g")
    known = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "_b", "_ahead", "source_size", "target", "weight", "slope")
    k = known.alias("k")
    d = d.alias("d").join(k, F.col("d.source").eqNullSafe(F.col("k.source")) & (F.col("d._b") == F.col("k._b")))
    d = d.select("doc_id", "d.source", "size", *carry, "d._b", "_h", "_ahead", "source_size", "target", "weight", "slope")
    within = W.partitionBy("source", "_b").orderBy("_h", "doc_id", "size", *carry).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("begins", F.col("_ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    middle = F.col("begins") + F.col("size") / 2.0
    taken = sum((F.when((F.col("size") > 0) & (middle + F.col("source_size") * float(e) < F.col("target")), 1).otherwise(0) for e in range(max_epochs)), F.lit(0))
    return d.select("doc_id", "source", "size", "source_size", "target", "weight", "slope", taken.cast("long").alias("copies"), "begins", *carry)


def schedule(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each copy taken (``epoch`` from 0) with its training ``position`` in 0..1,
    range-partitioned and sorted by position."""
    copies = mixed.where(F.col("copies") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    done = F.least(F.lit(1.0), (F.col("begins") + F.col("epoch") * F.col("source_size")) / F.col("target"))
    return copies.withColumn("position", position(done, F.col("slope"))).orderBy("position", "source", "epoch", "doc_id")


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, sorted by the position of its first copy (``first_position``; null if not taken)."""
    m = mix(table(spark, sf_dir, "documents"))
    first = F.when(F.col("copies") > 0, position(F.least(F.lit(1.0), F.col("begins") / F.col("target")), F.col("slope")))
    m = m.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"), F.round(first, 9).alias("first_position"))
    return m.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


#: The same mix written with whole windows over each source.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth, source_size * 2.0::DOUBLE AS cap FROM s),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[nth % 3 + 1] AS weight, ([0.5, 0.0, -0.5]::DOUBLE[])[nth % 3 + 1] AS slope FROM n),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
             sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unfilled,
             sum(source_size) OVER () * 1.5::DOUBLE AS total FROM w),
l AS (SELECT *, (total - filled) / unfilled AS lev FROM f),
g AS (SELECT (SELECT lev FROM l WHERE lev * weight < cap ORDER BY cap / weight, nth LIMIT 1) AS lev),
t AS (SELECT source, source_size, slope, CASE WHEN g.lev IS NULL THEN cap ELSE least(cap, g.lev * weight) END AS target FROM l, g),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN size > 0 AND begins + size / 2.0::DOUBLE < target THEN 1 ELSE 0 END
             + CASE WHEN size > 0 AND begins + size / 2.0::DOUBLE + source_size < target THEN 1 ELSE 0 END AS copies,
             least(1.0::DOUBLE, begins / target) AS done FROM c)
SELECT doc_id, size, source_size, round(target, 6) AS target, (copies * size)::BIGINT AS taken,
       CASE WHEN copies > 0 THEN round(CASE WHEN slope = 0 THEN done
            ELSE ((1 + slope) - sqrt((1 + slope) * (1 + slope) - 4 * slope * done)) / (2 * slope) END, 9) END AS first_position
FROM k
"""

QUERIES = {"op2_curriculum_mix": op2_curriculum_mix}
ORACLES = {"op2_curriculum_mix": ORACLE}
