"""Approximate nearest neighbours by a forest of hash prefixes.

A tree is the sorted array of the vectors' hash strings, one bit for each of ``DEPTH`` random hyperplanes through the mean
of the data. The vectors are dealt by a hash into shards of bounded size, each with a forest of ``TREES`` trees of its own.
A query descends every tree to its longest shared prefix; then all trees ascend together, one bit at a time, until the
subtrees under the shared prefix hold ``GATHER`` entries for each vector of the shard (2.5 % of all its entries) and as many
different vectors as are wanted. Of these the ones that most trees hold are the candidates and are compared exactly: ``BUDGET``
times ``k`` of the whole table, dealt over the shards in proportion, at least one in ``SHARE`` of a shard's vectors; ties in the
number of trees are all compared. How far the trees ascend decides on recall: at a sixteenth of these entries a twentieth of
the true neighbours stands behind 1,290 others of a shard, at all of them behind 36 (evenly spread vectors, the hardest case).
Every query asks every shard, so the work grows with queries times vectors: on evenly spread vectors no smaller part of the
entries holds the neighbours, whatever the order in which they are looked through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .pigeonhole_join import usable

TREES = 320
DEPTH = 32
#: Vectors to compare for each neighbour asked, over the whole table; of how many in a shard one is compared at least; entries
#: to gather for each vector of a shard.
BUDGET, SHARE, GATHER = 30, 64, 8
#: Vectors of a shard, and queries that meet it in one task.
SHARD, QUERY_BLOCK = 16384, 65536
_TOGETHER = 8  # trees whose planes are multiplied at once


def hashes(vectors: np.ndarray, mean: np.ndarray, trees: int = TREES) -> np.ndarray:
    """The hash strings as integers, a row for each tree: the first plane is the highest bit."""
    centred, out = (vectors - mean).astype(np.float32), np.empty((trees, len(vectors)), np.uint32)
    half = np.float32(2) ** np.arange(15, -1, -1, dtype=np.float32)
    for t in range(0, trees, _TOGETHER):
        many = min(_TOGETHER, trees - t)
        planes = np.random.default_rng([t, len(mean)]).standard_normal((len(mean), many * DEPTH), dtype=np.float32)
        bits = (centred @ planes > 0).reshape(len(vectors), many, 2, DEPTH // 2).astype(np.float32) @ half
        out[t : t + many] = (bits.astype(np.uint32) @ np.array([1 << 16, 1], np.uint32)).T
    return out


def subtree(order: np.ndarray, hashed: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted array the strings lie that share the first ``length`` bits."""
    low = np.uint64(DEPTH) - np.asarray(length, dtype=np.uint64)
    first = hashed.astype(np.uint64) >> low << low
    return np.searchsorted(order, first, "left"), np.searchsorted(order, first + (np.uint64(1) << low), "left")


class Forest:
    """The trees of one shard: ids in rising order, their vectors, and each tree's sorted strings."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, mean: np.ndarray, trees: int = TREES) -> None:
        at = np.lexsort((*vectors.T[::-1], ids))
        self.ids, self.vectors, self.mean = ids[at], vectors[at], mean
        codes = hashes(self.vectors, mean, trees)
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, axis=1).astype(np.uint64)

    def spans(self, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each tree and query, where the subtree under the first ``length`` bits begins and ends."""
        found = [subtree(run, hashed, length) for run, hashed in zip(self.sorted, codes, strict=True)]
        return np.stack([low for low, _ in found]), np.stack([high for _, high in found])

    def ascended(self, codes: np.ndarray, entries: int) -> np.ndarray:
        """For each query the longest prefix under which all trees together hold so many entries. Subtrees only grow on the way
        up, so the end of the ascent is found by halving."""
        least, most = np.zeros(codes.shape[1], np.int64), np.full(codes.shape[1], DEPTH)
        while (least < most).any():
            middle = (least + most + 1) // 2
            low, high = self.spans(codes, middle)
            enough = (high - low).sum(axis=0) >= entries
            least, most = np.where(enough, middle, least), np.where(enough, most, middle - 1)
        return least

    def candidates(self, asked_ids: np.ndarray, asked: np.ndarray, wanted: int, gather: int = GATHER):
        """For each query the places of its candidates; never those of its own id."""
        n, entries = len(self.ids), self.order.ravel()
        if n <= wanted:
            for i in asked_ids:
                yield np.flatnonzero(self.ids != i)
            return
        codes = hashes(asked, self.mean, len(self.order))
        first = (np.arange(len(self.order)) * n)[:, None]
        length = self.ascended(codes, gather * n)
        low, high = self.spans(codes, length)
        own = [np.searchsorted(self.ids, asked_ids, side) for side in ("left", "right")]
        for q in range(len(asked_ids)):
            begin, end = low[:, q] + first[:, 0], high[:, q] + first[:, 0]
            while True:
                sizes = end - begin
                at = np.arange(sizes.sum()) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)
                trees = np.bincount(entries[at], minlength=n)
                trees[own[0][q] : own[1][q]] = 0  # the query itself
                if length[q] == 0 or np.count_nonzero(trees) >= wanted:
                    break
                length[q] -= 1
                begin, end = (x[:, 0] + first[:, 0] for x in self.spans(codes[:, [q]], length[[q]]))
            least = max(1, np.partition(trees, n - wanted)[n - wanted])
            yield np.flatnonzero(trees >= least)


def wanted_of(held: int, all_: int, k: int, budget: int = BUDGET) -> int:
    """How many of a shard's ``held`` vectors are compared."""
    return max(-(-budget * k * held // all_), -(-held // SHARE), min(held, k))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, budget: int = BUDGET) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the ``k`` nearest found by Euclidean distance, ties to the smaller id.

    ``queries`` has the columns of ``vectors`` (vec_id, embedding). Vectors that are null, zero or hold null or non-finite
    components, and rows without vec_id, take no part; nor does a row compare with itself (its own vec_id) or with vectors
    of another length than most have. Of equal vectors the ``k + 1`` smallest ids take part, as no more can be among the
    nearest. A vec_id that is repeated counts with the nearest of its vectors, and asks with all of them. Empty tables give no
    rows; other columns are ignored.
    """
    good = lambda df: df.filter(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    points, asked = good(vectors), good(queries)
    sizes = points.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    schema = "query_id long, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = sizes.dims, sizes["count"]
    points, asked = points.filter(F.size("embedding") == dims), asked.filter(F.size("embedding") == dims)
    centre = points.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).collect()  # one row for each dimension
    mean = np.zeros(dims)
    for r in centre:
        mean[r.i] = r.x
    shards, blocks = -(-n // SHARD), -(-max(1, asked.count()) // QUERY_BLOCK)
    copy = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    held = (
        points.withColumn("copy", copy)
        .filter(F.col("copy") <= k + 1)
        .select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    )
    spread = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1))))

    def searched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not left.empty and not right.empty:
            forest = Forest(left.vec_id.to_numpy(), np.stack(list(left.embedding)), mean)
            asked_ids, want = right.vec_id.to_numpy(), np.stack(list(right.embedding))
            near_all = forest.candidates(asked_ids, want, wanted_of(len(left), n, k, budget))
            for i, v, near in zip(asked_ids, want, near_all, strict=True):
                score = np.sqrt(((forest.vectors[near] - v) ** 2).sum(1))
                best = np.lexsort((forest.ids[near], score))
                ids, first = np.unique(forest.ids[near][best], return_index=True)
                best = best[np.sort(first)[:k]]
                out.append(pd.DataFrame({"query_id": i, "vec_id": forest.ids[near][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"score": "float64"})

    near = held.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInPandas(searched, schema)
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")).alias("rank")
    return near.select("query_id", rank, "vec_id", "score").filter(F.col("rank") <= k)
