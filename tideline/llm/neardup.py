"""Near-duplicate documents by SetSketch registers, bands, joint likelihood and an exact check of full sets.

A document's set holds its distinct word shingles. Register i keeps floor(1 - log_b min_d h_i(d)), h_i(d) being
exponential with rate a: exponentially spaced, truncated minima, mergeable by maximum. Documents with the same
set are one node, named by their least id. Bands of register values propose nodes that may be linked;
registers and set sizes of two nodes give the likeliest Jaccard similarity; pairs that may reach the limit are
confirmed on their full sets, fetched again from the texts.

Passages that many documents share would put all of these in one bucket. So shingles are counted over all
documents, in a table of fixed size, and a band is posted only if one of its registers comes from a shingle
that isn't common. A document with many common shingles also posts those that come first in order of
frequency, as many as any document similar enough must share one of (the prefix filter), so it needs no band.

First the least node of each bucket is compared with the others, which settles most groups. Buckets that then
still hold several components are finished: those of up to SMALL nodes by the pairs that lie in different
components, larger ones in cells of BLOCK x BLOCK nodes, in which one matrix product gives the sizes of all
intersections and only the links that join components leave. So every pair of a bucket is linked, implied by
links, or tested, and no large bucket becomes rows of pairs. A component that fills blocks has blocks of its own, which
meet those of other components only: a bucket with one large group costs in proportion to it.

Null ids take no part (component null, kept). Rows that share an id are one node with the links of each.
Documents without words or with null text have the empty set: linked with nothing, kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import forget, fresh, released, save, small_batches, table
from tideline.llm.components import connected_components

#: Registers, rows of a band, base, rate: at similarity 0.85 all 24 bands fail with 8e-7.
REGISTERS, ROWS, BASE, RATE = 120, 5, 1.001, 20.0
BANDS = REGISTERS // ROWS
#: Counters of shingles, by hash; a counter this many deviations over the mean marks its shingles as common.
SLOTS, DEVIATIONS, LEAST_COMMON = 1 << 20, 10.0, 30.0
#: From this share of common shingles on a document posts its prefix: bands do without up to a share of 0.5, and
#: documents that are similar enough differ in it by less than the rest.
PREFIX_FROM = 0.3
#: Slack of the likelihood filter below the limit: over 4 standard errors of 120 registers.
SLACK = 0.15

#: Bits of the bitmap that keeps texts of other documents out of the shuffle (1 MB of bits, 2 MB in the driver).
WANTED_BITS = 1 << 23
#: Nodes of a bucket whose pairs may become rows; side of a cell of larger ones, in nodes and in shingles.
SMALL, BLOCK, BLOCK_SHINGLES = 32, 512, 1 << 19

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, REGISTERS, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound of their number and of each one's length (about 15 MB)."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= 100_000:
                self.clear()
            self[word] = h
        return h


_HASHES = _Hashes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``width``: one for the whole."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    take = min(width, len(words))
    x = np.full(len(words) - take + 1, _C[4] >> np.uint64(take), np.uint64)
    for k in range(take):
        x = (x ^ h[k : len(words) - take + 1 + k]) * _C[k % 3] + (x >> np.uint64(29))
    x ^= x >> np.uint64(32)
    x *= _C[3]
    x ^= x >> np.uint64(29)
    return np.unique(x)


def _least(hashes: np.ndarray) -> np.ndarray:
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        block = hashes[at : at + 1024, None] ^ _XOR
        block *= _MUL
        np.minimum(least, block.min(0), out=least)
    return least


def _quantised(least: np.ndarray) -> np.ndarray:
    h = -np.log1p(-np.minimum((least.astype(np.float64) + 1) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, 65535).astype("<u2")


def registers(hashes: np.ndarray) -> np.ndarray:
    """The uint16 registers of a non-empty set."""
    return _quantised(_least(hashes))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64) & (SLOTS - 1)


def shingle_counts(docs: DataFrame, width: int) -> np.ndarray:
    """Documents by slot of their shingles: ``SLOTS`` counters, whatever the number of documents.

    Each task sums its own, then stretches of them are summed over tasks; only the sums reach the driver.
    """
    stretch = SLOTS // 256

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, size = np.zeros(SLOTS, np.uint32), [], 0
        for f in frames:
            for text in f["text"]:
                held.append(_slots(shingles(text, width)))
                size += len(held[-1])
                if size > SLOTS // 4:
                    total += np.bincount(np.concatenate(held), minlength=SLOTS).astype(np.uint32)
                    held, size = [], 0
        total += np.bincount(np.concatenate([*held, np.empty(0, np.int64)]), minlength=SLOTS).astype(np.uint32)
        yield packed(total)

    def packed(total: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"at": np.arange(256, dtype=np.int32), "n": [total[i : i + stretch].tobytes() for i in range(0, SLOTS, stretch)]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for f in frames:
            for at, n in zip(f["at"].tolist(), f["n"], strict=True):
                part = np.frombuffer(bytes(n), np.uint32)
                sums[at] = sums[at] + part if at in sums else part.astype(np.int64)
        yield pd.DataFrame({"at": np.array(list(sums), np.int32), "n": [n.tobytes() for n in sums.values()]})

    # A task sums the stretches it is dealt batch by batch, however many tasks wrote them.
    rows = docs.select("text").mapInPandas(lambda f: released(each(f)), "at int, n binary").repartition("at").mapInPandas(lambda f: released(add(f)), "at int, n binary").toPandas()
    out = np.zeros(SLOTS, np.int64)
    for at, n in zip(rows["at"], rows["n"], strict=True):
        out[at * stretch : (at + 1) * stretch] = np.frombuffer(bytes(n), np.int64)
    return out


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """A byte a slot: 0 where its shingles aren't common, else rising with the counter."""
    mean = counts.mean()
    limit = mean + DEVIATIONS * np.sqrt(mean) + LEAST_COMMON
    over = np.log2(np.maximum(counts / limit, 1.0))
    return np.where(counts <= limit, 0, 1 + np.minimum(over * 8, 254)).astype(np.uint8)


def _posts(hashes: np.ndarray, rank: np.ndarray, percent: int) -> tuple[bytes, np.ndarray]:
    """The registers of a set, and the buckets that it is posted in."""
    common = rank > 0
    rare = _least(hashes[~common])
    least = np.minimum(rare, _least(hashes[common]))
    regs = _quantised(least)
    raw = regs.tobytes()
    named = (rare == least).reshape(BANDS, ROWS).any(1)
    out = [xxhash.xxh3_64_intdigest(raw[2 * ROWS * k : 2 * ROWS * (k + 1)], seed=k + 1) for k in np.flatnonzero(named).tolist()]
    posts = np.array(out, np.uint64)
    if common.mean() >= PREFIX_FROM:
        first = np.lexsort((hashes, rank))[: len(hashes) - -(-percent * len(hashes) // 100) + 1]
        posts = np.concatenate([posts, hashes[first]])
    return raw, posts.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log(np.maximum(1 - x * (BASE - 1) / BASE, 1e-12)) / np.log(BASE)


def likeliest(ku: np.ndarray, kv: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that maximises the joint likelihood of two sketches, by pair, sizes known."""
    above, below = (ku > kv).sum(1), (ku < kv).sum(1)
    u = nu / (nu + nv)
    most = np.minimum(nu, nv) / np.maximum(nu, nv)
    grid = np.linspace(0, 1, 201)[None, :] * most[:, None]
    more, less = _p(u[:, None] - (1 - u)[:, None] * grid), _p((1 - u)[:, None] - u[:, None] * grid)
    logs = [n[:, None] * np.log(np.maximum(p, 1e-12)) for n, p in ((above, more), (below, less), (REGISTERS - above - below, 1 - more - less))]
    return np.take_along_axis(grid, sum(logs).argmax(1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, n, key, regs, posts`` of each row: set size, a 128-bit name of the set, registers, buckets.
    Empty sets: null but for the size."""
    table_of = docs.sparkSession.sparkContext.broadcast(ranks_of(shingle_counts(docs, width)))  # SLOTS bytes

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = table_of.value
        for f in frames:
            rows = []
            for text in f["text"]:
                x = shingles(text, width)
                if len(x):
                    rows.append((len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest(), *_posts(x, ranks[_slots(x)], percent)))
                else:
                    rows.append((0, None, None, None))
            columns = dict(zip(("n", "key", "regs", "posts"), zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in ("n", "key", "regs", "posts")}
            yield pd.DataFrame({"doc_id": f["doc_id"], **columns})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(lambda f: released(each(f)), "doc_id long, n long, key binary, regs binary, posts array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node, s``: full sets of the documents whose id is in ``wanted`` (``node``)."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"node": f["doc_id"], "s": [shingles(t, width).view(np.int64) for t in f["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(_may_be_in(F.col("doc_id"), wanted))
    return rows.join(wanted, rows.doc_id == wanted.node, "left_semi").mapInPandas(lambda f: released(each(f)), "node long, s array<long>")


def _may_be_in(doc_id: Column, wanted: DataFrame) -> Column:
    """False for most ids that aren't in ``wanted`` (``node``), so that their texts needn't be shuffled: a bitmap of
    WANTED_BITS bits, of fixed size, made by a grouped bit_or. It only saves work; the join behind it decides."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(WANTED_BITS))
    own = wanted.select(slot(F.col("node")).alias("slot"))
    words = own.groupBy(F.floor(F.col("slot") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("bits")).toPandas()
    bits = np.zeros(WANTED_BITS // 32, np.int64)
    bits[words["word"]] = words["bits"]
    shared = wanted.sparkSession.sparkContext.broadcast(bits.astype(np.uint32))

    def has(slots: pd.Series) -> pd.Series:
        at = slots.fillna(0).to_numpy(np.int64)
        return pd.Series((shared.value[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1) == 1)

    @F.pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(map(has, batches))

    return test(slot(doc_id))


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach ``percent``: by sizes, by likelihood, then exactly."""
    limit = percent / 100

    def of(ru: pd.Series, rv: pd.Series, nu: pd.Series, nv: pd.Series) -> pd.Series:
        if not len(ru):
            return pd.Series([], dtype=float)
        ku, kv = (np.frombuffer(b"".join(map(bytes, r)), "<u2").reshape(-1, REGISTERS) for r in (ru, rv))
        return pd.Series(likeliest(ku, kv, nu.to_numpy(float), nv.to_numpy(float)))

    @F.pandas_udf("double")
    def estimate(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from released(of(*columns) for columns in batches)

    x = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    y = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    near = pairs.join(x, "b").join(y, "a").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    near = save(near.where(estimate("ra", "rb", "na", "nb") >= limit - SLACK).select("a", "b").distinct(), "near")
    wanted = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    full = save(_sets(docs, wanted, width), "sets")
    s = full.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    t = full.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    both = near.join(s, "b").join(t, "a").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    links = save(both.where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b").distinct(), "links")
    forget(near)
    forget(full)
    return links


def linked_pairs(sets: list[np.ndarray], parts: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of ``left`` and ``right`` (positions in ``sets``) that join different ``parts``: a
    spanning forest of them. Intersections are counted exactly, as a product of incidence matrices."""
    size = np.array([len(x) for x in sets])
    member = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    member, column = member[keep], number[column[keep]]
    common = np.zeros((len(left), len(right)), np.float32)
    by_column = np.argsort(column, kind="stable")
    member, column = member[by_column], column[by_column]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[member[lo:hi], column[lo:hi] - at] = 1
        common += m[left] @ m[right].T
    union = size[left][:, None] + size[right][None, :] - common
    a, b = np.nonzero((100 * common.astype(np.float64) >= percent * union) & (parts[left][:, None] != parts[right][None, :]))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(left[a].tolist(), right[b].tolist(), strict=True):
        p, q = find(int(parts[x])), find(int(parts[y]))
        if p != q:
            root[p] = q
            out.append((x, y))
    return out


def _in_cells(large: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components of the members (``bucket, node, n, c``) of large buckets. A cell takes two blocks of
    a bounded number of nodes and, in the mean, of shingles, so long texts make more cells."""

    def cell(f: pd.DataFrame) -> pd.DataFrame:
        i, j = int(f["i"].iloc[0]), int(f["j"].iloc[0])
        sets = [np.asarray(x, np.int64) for x in f["s"]]
        left, right = (np.flatnonzero(f["block"].to_numpy() == k) for k in (i, j))
        node, part = f["node"].to_numpy(), f["c"].to_numpy()
        found = linked_pairs(sets, part, left, right, percent) if len(left) and len(right) else []
        return pd.DataFrame({"a": [max(node[x], node[y]) for x, y in found], "b": [min(node[x], node[y]) for x, y in found]}, dtype="int64")

    full = _sets(docs, large.select("node").distinct(), width)
    rows = _blocks(large)
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda o: (o < F.col("base")) | (o >= F.col("base") + F.col("alone"))))
    rows = rows.withColumn("other", other).select("bucket", "node", "c", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return rows.join(full, "node").groupBy("bucket", "i", "j").applyInPandas(cell, "a long, b long").distinct()


def _blocks(large: DataFrame) -> DataFrame:
    """``bucket, node, c, block, total, base, alone`` of the members (``bucket, node, n, c``) of large buckets, in blocks
    numbered from 0 to ``total`` - 1. A component that fills blocks has some of its own, ``alone`` of them from ``base``
    on, which needn't meet each other; the members of smaller ones share blocks (``alone`` 0)."""
    need = lambda size, shingles: F.ceil(F.greatest(size / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    parts = large.groupBy("bucket", "c").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    parts = parts.withColumn("big", (F.col("size") > BLOCK / 2) | (F.col("shingles") > BLOCK_SHINGLES / 2))
    big = parts.where("big").select("bucket", "c", need(F.col("size"), F.col("shingles")).alias("alone"))
    before = W.partitionBy("bucket").orderBy("c").rowsBetween(W.unboundedPreceding, -1)  # a row for each that fills blocks
    big = big.withColumn("base", F.coalesce(F.sum("alone").over(before), F.lit(0)).cast("int"))
    sums = parts.groupBy("bucket").agg(
        F.coalesce(F.sum(F.when(F.col("big"), need(F.col("size"), F.col("shingles")))), F.lit(0)).cast("int").alias("own"),
        F.coalesce(need(F.sum(F.when(~F.col("big"), F.col("size"))), F.sum(F.when(~F.col("big"), F.col("shingles")))), F.lit(0)).alias("common"),
    )
    rows = large.select("bucket", "node", "c").join(big, ["bucket", "c"], "left").join(sums, "bucket")
    lot = F.xxhash64("node")
    block = F.when(F.col("alone").isNotNull(), F.col("base") + F.pmod(lot, F.col("alone"))).otherwise(F.col("own") + F.pmod(lot, F.col("common")))
    return rows.select("bucket", "node", "c", block.cast("int").alias("block"), (F.col("own") + F.col("common")).alias("total"), F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("alone", F.lit(0)).alias("alone"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row; see the module's text for all cases."""
    small_batches(docs.sparkSession)
    sketched = save(sketches(docs, width, percent), "sketches")
    filled = sketched.where(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    nodes = filled.groupBy("key").agg(F.min(F.struct("doc_id", "n", "regs", "posts")).alias("r"))
    nodes = save(nodes.select("key", F.col("r.doc_id").alias("node"), F.col("r.n").alias("n"), F.col("r.regs").alias("regs"), F.col("r.posts").alias("posts")), "nodes")

    # Rows of one id in several sets join these sets' nodes.
    named = filled.select("doc_id", "key").join(nodes.select("key", "node"), "key").select("doc_id", "node")
    several = named.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("doc_id")
    same = named.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")

    posted = nodes.select("node", "n", F.explode("posts").alias("bucket"))
    shared = posted.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("hi")).where("leader < hi").select("bucket", "leader")
    members = save(posted.join(shared, "bucket"), "members")
    pairs = members.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    links = save(same.union(_confirmed(pairs, nodes, docs, width, percent)), "links")
    component = connected_components(links)

    mine = members.join(component, "node", "left").select("bucket", "node", "n", "leader", F.coalesce("component", "node").alias("c"))
    mixed = mine.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("bucket", "size")
    rest = save(mine.join(mixed, "bucket"), "rest")
    forget(members)
    few = rest.where((F.col("size") <= SMALL) & (F.col("node") != F.col("leader")))
    a = few.select("bucket", F.col("node").alias("a"), F.col("c").alias("ca"))
    b = few.select("bucket", F.col("node").alias("b"), F.col("c").alias("cb"))
    pairs = a.join(b, "bucket").where("ca <> cb and a > b").select("a", "b").distinct()
    more = save(_confirmed(pairs, nodes, docs, width, percent).union(_in_cells(rest.where(F.col("size") > SMALL), docs, width, percent)), "links")
    if not more.isEmpty():
        component = connected_components(links.union(more))

    named = nodes.select("key", "node").join(component, "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))
    # The id of a set-less row can be a node through another row of that id.
    bare = sketched.where(F.col("key").isNull() & F.col("doc_id").isNotNull()).select("doc_id", "n")
    bare = bare.join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component_id"))
    rows = filled.select("doc_id", "n", "key").join(named, "key").select("doc_id", "n", "component_id")
    null = sketched.where(F.col("doc_id").isNull()).select("doc_id", "n", F.lit(None).cast("long").alias("component_id"))
    every = rows.unionByName(bare).unionByName(null)
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with their own columns only, one for each component: that of the least id, and of rows
    that share this id the one whose JSON has the least md5. Rows with null ids stay."""
    decided = save(near_duplicates(docs, width, percent), "decided")
    id_ = fresh("id", docs)
    gone = decided.where("not kept").select(F.col("doc_id").alias(id_)).distinct()
    left = docs.join(gone, docs["doc_id"] == gone[id_], "left_anti")
    twice = save(decided.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_)), "twice")
    if twice.isEmpty():
        return left
    once = left.join(twice, left["doc_id"] == twice[id_], "left_anti")
    row = F.struct(*docs.columns)
    first = F.min_by(row, F.md5(F.to_json(row).cast("binary"))).alias("row")
    return once.union(left.join(twice, left["doc_id"] == twice[id_], "left_semi").groupBy("doc_id").agg(first).select("row.*"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


#: Exact for any input that DuckDB can hold: all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
k AS (SELECT list_sort(s) AS k, min(doc_id) AS node FROM s WHERE len(s) > 0 GROUP BY 1),
e AS (SELECT node, len(k) AS n, unnest(k) AS x FROM k),
p AS (SELECT a.node AS a, b.node AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT node AS root, node FROM k UNION SELECT reach.root, both_ways.b FROM reach JOIN both_ways ON reach.node = both_ways.a),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, coalesce(c.component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN k ON list_sort(s.s) = k.k LEFT JOIN c ON k.node = c.node
"""

QUERIES = {"op10_near_duplicates": op10_near_duplicates}
ORACLES = {"op10_near_duplicates": ORACLE}
