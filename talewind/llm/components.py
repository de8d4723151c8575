"""Connected components of a graph given by its links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import HOT, durable


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id that links reach) for every end of ``links`` (a, b); the order of the ends is free.

    Every round moves links nearer to the least id of their component; the rounds end when all links are stars: each node has
    one link to a lower one, which has none. Links of a hub (see ``join_counted``) stay dealt over all tasks and meet a broadcast
    of the hubs' minima; those of other nodes take their minimum from a window, which spills. Links of a node with itself and
    nulls are dropped.
    """
    spark, kind = links.sparkSession, links.schema["a"].dataType.simpleString()
    links = durable(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    own = W.partitionBy("a")
    while True:
        both = links.withColumn("up", F.lit(1)).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("up")))
        nodes = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"), F.sum("up").alias("ups"))
        no_star = (F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("n") > 1))
        is_hub = F.col("n") * HOT > F.lit(2 * links.count())  # fewer than HOT
        open_, hubs = nodes.agg(F.count_if(no_star), F.collect_list(F.when(is_hub, F.struct("a", "m")))).first()
        if not open_:
            stars = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
            return stars.unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        hub = F.col("a").isin([h.a for h in hubs]) if hubs else F.lit(False)

        # links to what is above a node go to its least neighbour
        large = both.drop("up").filter(~hub).withColumn("m", F.least(F.min("b").over(own), "a"))
        if hubs:
            least = spark.createDataFrame([(h.a, h.m) for h in hubs], f"a {kind}, m {kind}")
            large = large.unionByName(both.drop("up").filter(hub).join(F.broadcast(least), "a"))
        large = large.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if hubs:
            large = durable(large)

        # then all that is below a node to the least of it; no node has more links here than before
        small = large.filter(~hub).withColumn("m", F.min("b").over(own))
        if hubs:
            lower = large.filter(hub).groupBy("a").agg(F.min("b").alias("m"))
            small = small.unionByName(large.filter(hub).join(F.broadcast(lower), "a"))
        moved = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
        links = durable(moved.select("l.*").filter("a <> b").distinct())


def roots(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The roots of nodes of a forest inside one task."""
    i = parent[i]
    while (up := parent[i]).size and (up != i).any():
        i = up
    return i


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j; a root is the least index of its tree."""
    while i.size:
        a, b = roots(parent, i), roots(parent, j)
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
