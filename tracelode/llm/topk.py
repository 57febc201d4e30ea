"""Exact top-k search: a KD-tree per shard, best-first over leaves by box bounds, kth scores propagated.

Rows are dealt to shards of bounded size; each shard is one group whose rows come first and build the tree once, and the
queries that are routed to it follow as a stream, so vectors move once and neither many queries nor many rows meet in
memory. A shard's tree halves its rows at the median of the widest component, level by level, each node with its tight box.
A box's bound for a query is the inner product with the corner that suits the query best. Bounds go down the
tree (a node under the query's kth score takes its subtree along); leaves are then visited in order of their
best bound, each by those queries of the block whose own bound for it still reaches their kth score. Each query
first searches the shard that its own id falls in; its kth score there is where all other shards start.

In many dimensions boxes say little: of the test tables' 64 components even the true kth score leaves 99.99% of a shard's
leaves to visit, so a leaf is one matrix product, large enough to be quick where nothing can be pruned.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; only
vectors of equal length meet; rows with a null vec_id take no part; a row never finds rows of its own vec_id;
repeated rows are separate candidates; ties go to the smaller vec_id; fewer than k candidates give fewer rows;
an empty table gives an empty result; extra columns are left alone. Inner products are exact while the
sum of absolute products is below 2**53; up to 2**40 the fast order is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.llm.common import table, work_dir, written

SHARD, QUERIES, LEAF = 32_768, 1024, 512
#: Bits of a row's place in a shard, beside the score, in the key by which rows are ordered.
PLACE = 22


class Tree:
    """Levels of boxes over rows in an order in which every node's rows are neighbours."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF) -> None:
        depth = max(0, int(np.ceil(np.log2(max(1, len(rows)) / leaf))))
        order, cuts = np.arange(len(rows)), np.array([0, len(rows)])
        self.levels = [self._boxes(rows, cuts)]
        for _ in range(depth):
            new = [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own, mid = order[a:b], (b - a) // 2
                wide = int(np.argmax(np.ptp(rows[own], axis=0))) if b > a else 0
                order[a:b] = own[np.argpartition(rows[own, wide], mid)] if b - a > 1 else own
                new += [a + mid, b]
            cuts = np.array(new)
            self.levels.append(self._boxes(rows[order], cuts))
        self.order, self.cuts = order, cuts

    @staticmethod
    def _boxes(rows: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        full = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        empty = np.zeros(rows.shape[1])
        return tuple(np.stack([f(rows[a:b], axis=0) if b > a else empty for a, b in full]) for f in (np.min, np.max))

    def bounds(self, queries: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Of each query and leaf; minus infinity under a node that is below the query's floor."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        alive = np.ones((len(queries), 1), bool)
        for k, (lo, hi) in enumerate(self.levels):
            if k:
                alive = np.repeat(alive, 2, axis=1)
            top = up @ hi.T + down @ lo.T
            alive &= top >= floor[:, None]
        return np.where(alive, top, -np.inf)


class Shard:
    """Rows in order of their ids, under a tree that is built once."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        sort = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[sort], rows[sort]
        self.tree = Tree(self.rows, LEAF)
        self.visited = self.offered = 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of each query's k best rows that reach its floor, ties to the smaller id."""
        bound = self.tree.bounds(queries, floor)
        best = bound.max(axis=0)
        kth, top = floor.astype(float).copy(), Best(len(queries), k, float(np.abs(queries).sum(axis=1).max(initial=0) * np.abs(self.rows).max(initial=0)))
        for leaf in np.argsort(-best, kind="stable"):
            active = np.flatnonzero((bound[:, leaf] >= kth) & np.isfinite(bound[:, leaf]))
            self.visited, self.offered = self.visited + len(active), self.offered + len(queries)
            a, b = self.tree.cuts[leaf], self.tree.cuts[leaf + 1]
            if not len(active) or a == b:
                continue
            own = self.tree.order[a:b]
            scores = queries[active] @ self.rows[own].T
            scores[query_ids[active][:, None] == self.ids[own][None, :]] = -np.inf
            hit = ((scores >= kth[active][:, None]) & np.isfinite(scores)).any(axis=1)
            if hit.any():
                kth[active[hit]] = np.maximum(kth[active[hit]], top.add(active[hit], scores[hit], own))
        return top.rows(query_ids, self.ids, floor)


class Best:
    """The k best (score, place) of each query; of equal scores the smaller place is the better."""

    def __init__(self, n: int, k: int, largest: float) -> None:
        self.k, self.packed = k, largest < 2.0**40
        self.scores, self.places = np.full((n, k), -np.inf), np.full((n, k), (1 << PLACE) - 1)

    def add(self, queries: np.ndarray, scores: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Enters the scores of ``queries`` at ``places``; their kth scores then."""
        s = np.concatenate((self.scores[queries], scores), axis=1)
        p = np.concatenate((self.places[queries], np.broadcast_to(places, scores.shape)), axis=1)
        if self.packed:  # one whole number holds both
            key = (np.maximum(s, -(2.0**40)).astype(np.int64) << PLACE) + ((1 << PLACE) - 1 - p)
            at = np.argpartition(key, -self.k, axis=1)[:, -self.k :]
        else:
            at = np.lexsort((p, -s), axis=1)[:, : self.k]
        self.scores[queries], self.places[queries] = np.take_along_axis(s, at, 1), np.take_along_axis(p, at, 1)
        return self.scores[queries].min(axis=1)

    def rows(self, query_ids: np.ndarray, ids: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, r = np.nonzero(self.scores >= np.where(np.isfinite(floor), floor, -np.finfo(float).max)[:, None])
        return query_ids[q], ids[self.places[q, r]], self.scores[q, r].astype(np.int64)


def matrix(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query.

    ``vectors``: (vec_id, v array<long>); ``queries``: (query_id, v).
    """
    spark = vectors.sparkSession
    work = work_dir(spark)
    usable = (F.col("v").isNotNull()) & (F.size("v") > 0)
    vectors = written(vectors.where(usable & F.col("vec_id").isNotNull()).select("vec_id", "v"), f"{work}/vectors")
    queries = written(queries.where(usable & F.col("query_id").isNotNull()).distinct().select("query_id", "v"), f"{work}/queries")
    shards = max(1, -(-vectors.count() // SHARD))
    shard = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    nothing = F.lit(None).cast("double").alias("floor")
    dealt = written(vectors.select(F.size("v").alias("dim"), shard.alias("shard"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v", nothing), f"{work}/dealt")
    home = F.pmod(F.xxhash64(F.lit(1), "query_id"), F.lit(shards)).cast("int")
    asked = queries.select(F.size("v").alias("dim"), home.alias("home"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's rows, then its queries."""
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        held: Shard | None = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            cut = int(np.searchsorted(kinds, 1))
            if cut:
                ids.append(batch.column("id").slice(0, cut).to_numpy())
                rows.append(matrix(batch.column("v").slice(0, cut)))
            for lo in range(cut, batch.num_rows, QUERIES):
                if not ids:
                    return
                held = held or Shard(np.concatenate(ids), np.concatenate(rows))
                part = batch.slice(lo, QUERIES)
                floor = part.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                found = held.search(part.column("id").to_numpy(), matrix(part.column("v")), floor, k)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["query_id", "vec_id", "score"])

    def round_of(asked: DataFrame) -> DataFrame:
        """``asked``: dim, shard, kind, id, v, floor."""
        both = dealt.unionByName(asked.select(*dealt.columns)).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")
        return both.groupBy("dim", "shard").applyInArrow(meet, "query_id long, vec_id long, score long")

    at_home = written(round_of(asked.withColumn("shard", F.col("home")).withColumn("floor", F.lit(None).cast("double"))), f"{work}/home")
    kth = at_home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), F.col("least").cast("double").alias("floor"))
    others = asked.join(kth, "id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
    every = at_home.union(written(round_of(others), f"{work}/others")) if shards > 1 else at_home
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(64 * x) of each component; null where a component is null or not finite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.when(~F.coalesce(bad, F.lit(True)), F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("long")))
    return vectors.select("vec_id", v.alias("v"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v"), 20)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
