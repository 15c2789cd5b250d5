"""Approximate nearest neighbours by a permutation index, for the largest inner product.

Vectors get one more component that makes their norms equal (queries get 0), so the nearest by inner product
are the nearest by angle. Each vector is represented by the order in which it sees a fixed set of pivots, and
posted in the inverted files of the pivots nearest to it. A query reads the files of the pivots nearest to it,
ranks what it finds there by the footrule distance of the two permutations (of the first RANKED pivots), and computes
the inner product of the original vectors for the best of them.

The number of pivots grows with the square root of the number of vectors, so files hold an ever smaller share of
them, and a query reads as many more files as its root. Files are dealt into groups of bounded size, so that a query
meets a group once however many of its files it reads; a group that a frequent pivot makes large is cut into blocks,
and its queries too, so it is many tasks. Equal vectors are one entry of the index, with its least ids: no result needs
more than k + 1 ids of one vector. Queries that find fewer than k entries read all files in a second pass.

Vectors that are null, zero, hold null or non-finite components, or have another length than most take no
part, as queries or candidates. Rows that repeat an id and a vector count once. Inner products that overflow are
infinite, with ties to the smaller id as elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import forget, save, table

#: Pivots whose order makes the permutations that footrule distances compare; a rank is a byte.
RANKED = 128


@dataclass(frozen=True)
class Settings:
    """pivots: ``pivots * sqrt(vectors)`` of them, from 128 to ``most_pivots``, a sample of the distinct vectors by hash.
    posted: files a vector is in. probed: ``probed * sqrt(pivots)`` files are read by a query. reranked: share of a file
    that is reranked by inner product. rows, queries: entries of a block of a group of files, and queries of one."""

    pivots: float = 4.0
    most_pivots: int = 1 << 17
    posted: int = 6
    probed: float = 3.4
    reranked: float = 0.15
    rows: int = 1 << 14
    queries: int = 1 << 13


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def distinct_vectors(vectors: DataFrame, k: int, is_query: Column) -> tuple[DataFrame, DataFrame, str]:
    """(``vec_id, key, query`` by row, ``uid, ids, key, query`` by distinct vector, number format of ``key``); ``key`` is
    the vector's bytes, ``ids`` its k + 1 least ids. Copies within a batch are merged before the shuffle."""
    kind = "<f4" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "<f8"

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            # + 0.0: -0.0 and 0.0 are one component
            yield pd.DataFrame({"vec_id": f["vec_id"], "key": [(np.asarray(v, kind) + np.zeros(1, kind)).tobytes() for v in f["v"]], "query": f["query"]})

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                g = f.sort_values("vec_id").drop_duplicates(["key", "vec_id"]).groupby("key", sort=False)
                yield pd.DataFrame([(key, x["vec_id"].to_numpy()[: k + 1], bool(x["query"].any())) for key, x in g], columns=["key", "ids", "query"])

    v = F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), is_query.alias("query")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("v") == (common["n"] if common else 0))
    rows = save(rows.mapInPandas(pack, "vec_id long, key binary, query boolean"), "vectors")
    merged = rows.mapInPandas(merge, "key binary, ids array<long>, query boolean")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    entries = merged.groupBy("key").agg(ids.alias("ids"), F.max("query").alias("query"))
    return rows, save(entries.select(F.col("ids")[0].alias("uid"), "ids", "key", "query"), "entries"), kind


def _vectors(keys: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, keys)), kind).reshape(len(keys), -1).astype(np.float64)


@dataclass
class Pivots:
    """The pivots, with the component that equals norms; vectors are divided by ``scale`` first, so nothing overflows."""

    wide: np.ndarray
    scale: float
    top: float

    def order(self, v: np.ndarray, query: bool, many: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``many`` nearest pivots of each vector, nearest first, and the ranks of the first RANKED pivots as bytes."""
        v = v / self.scale
        last = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.top - (v**2).sum(1), 0))
        near = np.hstack([v, last[:, None]]) @ self.wide.T
        order = np.argsort(-near[:, :RANKED], axis=1, kind="stable")
        rank = np.zeros((len(v), RANKED), np.uint8)  # pivots that aren't there rank 0 for all
        np.put_along_axis(rank, order, np.arange(order.shape[1], dtype=np.uint8)[None, :].repeat(len(v), 0), 1)
        first = np.argpartition(-near, many - 1, axis=1)[:, :many]
        return np.take_along_axis(first, np.argsort(-np.take_along_axis(near, first, 1), axis=1, kind="stable"), 1), rank


_EVEN = np.uint64(0x00FF00FF00FF00FF)


def shared_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums of the lesser ranks of rows of ``a`` and ``b`` (bytes), which broadcast. All permutations have one sum of
    ranks, so the footrule distance is twice that sum less twice this one. Eight bytes are added at once."""
    least = np.minimum(a, b).view(np.uint64)
    lanes = ((least & _EVEN) + ((least >> np.uint64(8)) & _EVEN)).sum(-1)  # four lanes of 16 bits: 16 * 510 at most
    return (lanes * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int32)


def search_group(index: pd.DataFrame, queries: pd.DataFrame, s: Settings, k: int, kind: str) -> pd.DataFrame:
    """The best ``k`` entries of the files of a group for each of its queries: ``q, uid, score``. ``index`` holds ``pivot,
    uid, ranks, key``; ``queries`` hold ``uid, pivots`` (those of the group that a query reads, as int32 bytes)``, ranks,
    key``. Ties go to the smaller uid."""
    order = np.lexsort((index["uid"].to_numpy(), index["pivot"].to_numpy()))
    index = index.iloc[order]
    pivot, uid = index["pivot"].to_numpy(), index["uid"].to_numpy()
    ranks, v = np.frombuffer(b"".join(map(bytes, index["ranks"])), np.uint8).reshape(-1, RANKED), _vectors(index["key"], kind)
    asked = [np.frombuffer(bytes(x), "<i4") for x in queries["pivots"]]
    q_of, p_of = np.repeat(np.arange(len(asked)), [len(x) for x in asked]), np.concatenate(asked)
    q_ranks, q = np.frombuffer(b"".join(map(bytes, queries["ranks"])), np.uint8).reshape(-1, RANKED), _vectors(queries["key"], kind)
    q_of = q_of[np.argsort(p_of, kind="stable")]
    p_of = np.sort(p_of)
    files = np.unique(pivot)
    begins, ends = np.searchsorted(pivot, files), np.searchsorted(pivot, files, side="right")
    found_q, found_v, found_s = [], [], []
    for file, lo, hi in zip(files.tolist(), begins.tolist(), ends.tolist(), strict=True):
        mine = q_of[np.searchsorted(p_of, file) : np.searchsorted(p_of, file, side="right")]
        n, step = hi - lo, max(1, (1 << 13) // (hi - lo))
        rerank, keep = min(n, max(2 * k, math.ceil(s.reranked * n))), min(n, k)
        for at in range(0, len(mine), step):
            some = mine[at : at + step]
            near = np.arange(n)[None, :].repeat(len(some), 0)
            if rerank < n:
                shared = shared_ranks(ranks[None, lo:hi], q_ranks[some][:, None]).astype(np.int64)
                near = np.sort(np.argpartition(shared * -n + np.arange(n), rerank - 1, axis=1)[:, :rerank], axis=1)
            score = np.einsum("qrd,qd->qr", v[lo + near], q[some])
            best = np.argsort(-score, axis=1, kind="stable")[:, :keep] if keep < rerank else np.arange(rerank)[None, :].repeat(len(some), 0)
            found_q.append(np.repeat(some, keep))
            found_v.append((lo + np.take_along_axis(near, best, 1)).ravel())
            found_s.append(np.take_along_axis(score, best, 1).ravel())
    if not found_q:
        return pd.DataFrame({"q": pd.Series([], dtype="int64"), "uid": pd.Series([], dtype="int64"), "score": pd.Series([], dtype=float)})
    a, b, score = (np.concatenate(x) for x in (found_q, found_v, found_s))
    b = uid[b]
    # An entry may stand in several files of the group.
    order = np.lexsort((b, a))
    a, b, score = a[order], b[order], score[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    a, b, score = a[new], b[new], score[new]
    order = np.lexsort((b, -score, a))
    a, b, score = a[order], b[order], score[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return pd.DataFrame({"q": queries["uid"].to_numpy()[a], "uid": b, "score": score})[place < k]


def _search(entries: DataFrame, queries: DataFrame, pivots: Pivots, total: int, probed: int, s: Settings, k: int, kind: str) -> DataFrame:
    """``q, uid, score``: the best ``k`` entries found of each query entry."""
    n_pivots = len(pivots.wide)
    posted = min(s.posted, n_pivots)
    n_groups = min(n_pivots, max(16, math.ceil(total * posted / s.rows)))
    shared = entries.sparkSession.sparkContext.broadcast(pivots)  # most_pivots vectors at most
    chunk = max(16, (1 << 22) // n_pivots)  # rows whose products with all pivots are held at a time

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), chunk):
                g = f.iloc[at : at + chunk]
                order, rank = shared.value.order(_vectors(g["key"], kind), False, posted)
                each = np.repeat(np.arange(len(g)), posted)
                packed = np.array([r.tobytes() for r in rank], dtype=object)
                pivot = order.ravel().astype("int32")
                yield pd.DataFrame({"g": pivot % n_groups, "pivot": pivot, "uid": g["uid"].to_numpy()[each], "ranks": packed[each], "key": g["key"].to_numpy()[each]})

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), chunk):
                g = f.iloc[at : at + chunk]
                order, rank = shared.value.order(_vectors(g["key"], kind), True, probed)
                rows = []
                for pivot, r, uid, key in zip(order.astype("<i4"), rank, g["uid"], g["key"], strict=True):
                    pivot = pivot[np.argsort(pivot % n_groups, kind="stable")]
                    cuts = np.flatnonzero(np.diff(pivot % n_groups)) + 1
                    rows += [(int(p[0]) % n_groups, p.tobytes(), uid, r.tobytes(), key) for p in np.split(pivot, cuts)]
                yield pd.DataFrame(rows, columns=["g", "pivots", "uid", "ranks", "key"])

    files = entries.mapInPandas(post, "g int, pivot int, uid long, ranks binary, key binary")
    asked = queries.mapInPandas(ask, "g int, pivots binary, uid long, ranks binary, key binary")
    # One row a group: how many blocks its files and its queries are cut into.
    size = files.groupBy("g").agg(F.count("*").alias("n")).join(asked.groupBy("g").agg(F.count("*").alias("m")), "g")
    size = save(size.select("g", F.ceil(F.col("n") / (2 * s.rows)).cast("int").alias("nb"), F.ceil(F.col("m") / s.queries).cast("int").alias("mb")), "groups")
    small = F.broadcast(size)  # at most one row a pivot
    own = F.xxhash64("uid")
    files = files.join(small, "g").withColumn("b", F.pmod(own, "nb")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
    asked = asked.join(small, "g").withColumn("c", F.pmod(own, "mb").cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    files = files.select("g", F.col("b").cast("int").alias("b"), "c", "pivot", "uid", "ranks", "key")
    asked = asked.select("g", F.col("b").cast("int").alias("b"), "c", "pivots", "uid", "ranks", "key")

    def cell(index: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(wanted):
            return pd.DataFrame({"q": pd.Series([], dtype="int64"), "uid": pd.Series([], dtype="int64"), "score": pd.Series([], dtype=float)})
        return search_group(index, wanted, s, k, kind)

    keys = ["g", "b", "c"]
    found = files.groupBy(keys).cogroup(asked.groupBy(keys)).applyInPandas(cell, "q long, uid long, score double")
    found = found.groupBy("q", "uid").agg(F.max("score").alias("score"))  # one that stands in several groups has one score
    best = W.partitionBy("q").orderBy(F.desc("score"), "uid")
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, settings: Settings | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows ``is_query`` selects, against all rows but their own."""
    s = settings or Settings()
    rows, entries, kind = distinct_vectors(vectors, k, is_query)

    def largest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                v = _vectors(f["key"], kind)
                biggest = np.abs(v).max()
                yield pd.DataFrame({"n": [len(f)], "scale": [biggest], "top": [((v / biggest) ** 2).sum(1).max()]})

    each = entries.select("key").mapInPandas(largest, "n long, scale double, top double")
    seen = each.agg(F.sum("n").alias("n"), F.max("scale").alias("scale")).first()
    total, scale = seen["n"] or 0, seen["scale"] or 1.0
    # Squares of vectors over the greatest component of all: of batches with a lesser one they are lesser still.
    top = each.agg(F.max(F.col("top") * F.pow(F.col("scale") / F.lit(scale), F.lit(2.0))).alias("t")).first()["t"] if total else 1.0
    n_pivots = min(s.most_pivots, max(RANKED, math.ceil(s.pivots * math.sqrt(total))))
    # Twice as many by a share of the hashes, then the first of them: no task holds more than these.
    lot = F.pmod(F.xxhash64("uid", F.lit(5)), F.lit(1 << 30))
    chosen = entries.where(lot < max(1, min(1 << 30, math.ceil(2 * (n_pivots + 50) / max(1, total) * (1 << 30))))).select(lot.alias("lot"), "uid", "key").toPandas()
    chosen = chosen.sort_values(["lot", "uid"]).head(n_pivots)
    p = _vectors(chosen["key"], kind) / scale if len(chosen) else np.ones((1, 1))
    pivots = Pivots(np.hstack([p, np.sqrt(np.maximum(top - (p**2).sum(1), 0))[:, None]]), scale, top)
    probed = min(len(p), math.ceil(s.probed * math.sqrt(len(p))))
    wanted = entries.where("query")
    need = k + 1
    found = save(_search(entries, wanted, pivots, total, probed, s, need, kind), "found")
    short = wanted.join(found.groupBy("q").agg(F.count("*").alias("n")).withColumnRenamed("q", "uid"), "uid", "left").where(F.coalesce("n", F.lit(0)) < min(need, total))
    short = save(short.select("uid", "ids", "key", "query"), "short")
    if not short.isEmpty():
        again = _search(entries, short, pivots, total, len(p), replace(s, reranked=1.0), need, kind)
        both = save(found.join(short.select(F.col("uid").alias("q")), "q", "left_anti").unionByName(again), "found")
        forget(found)
        found = both
    forget(short)

    each = found.join(entries.select("uid", "ids"), "uid").select("q", "score", F.explode("ids").alias("vec_id"))
    best = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= need)
    lists = each.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("list"))
    named = rows.where("query").select(F.col("vec_id").alias("query_id"), "key").distinct().join(entries.select("key", F.col("uid").alias("q")), "key")
    mine = named.join(lists, "q").select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    return mine.select("query_id", F.posexplode("list").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op1_permutation_index": op1_permutation_index}
ORACLES: dict[str, str] = {}
