"""Connected components in DataFrame operations: large-star and small-star rounds, written out each round.

Both stars are a group-wise minimum joined back, so a hub's neighbours are spread over tasks: the minimum is
pre-aggregated before the shuffle, and the join back is one that Spark can split by skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import forget, save


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Edges (a, b), a > b. Large-star links each larger neighbour of a node to the least of its closed
    neighbourhood; small-star does so for the smaller neighbours and the node itself."""
    if small:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        out = out.select("e.a", "e.b")
    else:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a > b").distinct()


def _mark(edges: DataFrame):
    """Number of edges and an order-free hash of them."""
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the least node of its component) of every node that has an edge.

    Repeated edges, both directions and loops are allowed; rows with a null end are ignored. Nodes can be of
    any ordered type. Nodes with loops only are not returned: they are components of their own.
    """
    ends = edges.select(F.greatest(F.col(a), F.col(b)).alias("a"), F.least(F.col(a), F.col(b)).alias("b"))
    ends = ends.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") > F.col("b")) & edges[a].isNotNull() & edges[b].isNotNull())
    now = save(ends.distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        then = save(_star(_star(now, small=False), small=True), "edges")
        found = _mark(then)
        forget(now)
        now = then
        if mark == found:
            break
        mark = found
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
