"""Sharding by a k-d tree: recursive splits at distributed weighted medians along the widest metadata dimension.

The points are groups of equal rows (by default equal texts), each with its bytes as weight, so copies stay together.
A node that stands for several shards is split where the weight before the cut is the share of its left half; the cut is
found from histograms of a sortable 62-bit key (dimension, then digest), refined until the bin at the cut is light. Only
bins come to the driver: at most ``BINS`` for each node, whatever the number of rows. The few groups that weigh more than
``1 / (HEAVY * shards)`` of everything (at most ``HEAVY * shards`` of them exist) are dealt first, largest first to the
lightest shard, and the tree then fills the shards up to equal bytes.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable, text_group

BINS = 4096
HEAVY = 64
_DIGEST_BITS = 31
_SPAN = 1 << 62
#: A cut is good enough when the bin that holds it weighs under this share of a shard.
_TOLERANCE = 1e-3
#: Rows of a shard that one task numbers.
_BLOCK_ROWS = 20_000


@dataclass
class Node:
    """A cell of the tree with the shards it stands for; ``condition`` says which points lie in it."""

    shards: list[int]
    condition: Column
    splits: list[tuple[str, int]] = field(default_factory=list)


def _key(dimension: str) -> Column:
    """Sortable key of a point: the dimension scaled to 31 bits, then 31 bits of the group's digest."""
    scaled = F.least(F.greatest(F.col(dimension), F.lit(0.0)), F.lit(1.0)) * F.lit(float((1 << _DIGEST_BITS) - 1))
    return F.shiftleft(F.floor(scaled).cast("long"), _DIGEST_BITS) + F.col("digest")


def _filled(heavy: list[int], light: int, shards: int) -> list[float]:
    """What each shard takes of the light weight so that all end as level as the heavy groups allow."""
    order = sorted(range(shards), key=lambda s: heavy[s])
    level = 0.0
    for n in range(1, shards + 1):
        level = (light + sum(heavy[s] for s in order[:n])) / n
        if n == shards or level <= heavy[order[n]]:
            break
    return [max(0.0, level - h) for h in heavy]


def _cuts(points: DataFrame, nodes: list[tuple[Node, str, float]], tolerance: float) -> list[int]:
    """For each (node, dimension, wanted weight to its left) the key before which that weight lies."""
    found: list[int | None] = [None] * len(nodes)
    windows = [(0, _SPAN, 0.0)] * len(nodes)  # keys from, to, and the weight before them
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cell") + 1)
    while None in found:
        steps = [max(1, -(-(to - start) // BINS)) for start, to, _ in windows]
        cell = reduce(lambda o, i: F.when(nodes[i][0].condition, F.lit(i)).otherwise(o), [i for i, x in enumerate(found) if x is None], F.lit(None).cast("int"))
        keyed = points.withColumn("cell", cell).filter("cell IS NOT NULL")
        key = F.element_at(F.array(*[_key(d) for _, d, _ in nodes]), F.col("cell") + 1)
        bins = (
            keyed.select("cell", "bytes", key.alias("key"))
            .filter((F.col("key") >= pick([w[0] for w in windows])) & (F.col("key") < pick([w[1] for w in windows])))
            .withColumns({"low": pick([w[0] for w in windows]), "step": pick(steps)})
            .groupBy("cell", F.expr("(key - low) div step").alias("bin"))
            .agg(F.sum("bytes").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last"))
            .collect()
        )
        for i, (_, _, wanted) in enumerate(nodes):
            if found[i] is not None:
                continue
            before = windows[i][2]
            for row in sorted((r for r in bins if r.cell == i), key=lambda r: r.bin):
                if before + row.bytes >= wanted:
                    if row.first == row.last or row.bytes <= tolerance:
                        found[i] = row.last + 1 if before + row.bytes - wanted < wanted - before else row.first
                    else:
                        windows[i] = (row.first, row.last + 1, before)
                    break
                before += row.bytes
            else:
                found[i] = _SPAN  # nothing left to its right
    return found


def assign_shards(groups: DataFrame, dimensions: list[str], shards: int) -> DataFrame:
    """``groups`` (group, bytes, digest, dimensions in 0..1) with a ``shard`` each."""
    total, = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if not total:
        return groups.withColumn("shard", F.lit(0))
    rows = groups.filter(F.col("bytes") * (HEAVY * shards) > F.lit(total)).select("group", "bytes").collect()
    load, dealt = [0] * shards, {s: [] for s in range(shards)}
    for r in sorted(rows, key=lambda r: (-r.bytes, r.group)):
        s = min(range(shards), key=lambda s: (load[s], s))
        load[s] += r.bytes
        dealt[s].append(r.group)
    heavy = reduce(lambda o, s: F.when(F.col("group").isin(dealt[s]), F.lit(s)).otherwise(o), [s for s in dealt if dealt[s]], F.lit(None).cast("int"))
    points = groups.withColumn("heavy", heavy)
    light = points.filter("heavy IS NULL")
    wanted = _filled(load, total - sum(load), shards)

    nodes, leaves = [Node(list(range(shards)), F.lit(True))], []
    while nodes:
        leaves += [n for n in nodes if len(n.shards) == 1]
        nodes = [n for n in nodes if len(n.shards) > 1]
        if not nodes:
            break
        cell = reduce(lambda o, i: F.when(nodes[i].condition, F.lit(i)).otherwise(o), range(len(nodes)), F.lit(None).cast("int"))
        spread = {
            r.cell: r
            for r in light.groupBy(cell.alias("cell")).agg(*[(F.max(d) - F.min(d)).alias(d) for d in dimensions]).collect()
        }
        plan = []
        for i, n in enumerate(nodes):
            widest = max(dimensions, key=lambda d: ((spread[i][d] if i in spread else 0) or 0, -dimensions.index(d)))
            plan.append((n, widest, sum(wanted[s] for s in n.shards[: len(n.shards) // 2])))
        below = []
        for (n, d, _), cut in zip(plan, _cuts(light, plan, _TOLERANCE * total / shards), strict=True):
            half = len(n.shards) // 2
            for part, side in ((n.shards[:half], _key(d) < F.lit(cut)), (n.shards[half:], _key(d) >= F.lit(cut))):
                below.append(Node(part, n.condition & side, [*n.splits, (d, cut)]))
        nodes = below
    leaf = reduce(lambda o, n: F.when(n.condition, F.lit(n.shards[0])).otherwise(o), leaves, F.lit(None).cast("int"))
    return points.withColumn("shard", F.coalesce("heavy", leaf)).drop("heavy")


def shard_documents(docs: DataFrame, shards: int = 8, dimensions: Mapping[str, Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row, the shards' bytes near equal and equal texts together.

    A row weighs its UTF-8 bytes plus one. Null text counts as empty; null ids and sources are ordinary values; repeated
    rows each get a slot; an empty table gives an empty result. Other columns are ignored. ``dimensions`` maps names to
    columns in 0..1 (default: length, source, language); a group takes the least value of its rows.
    """
    dimensions = dimensions or {
        "dim_length": F.log2(F.octet_length(F.coalesce("text", F.lit(""))) + 1.0) / 40,
        "dim_source": F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / float(1 << 20),
        "dim_lang": F.pmod(F.xxhash64("lang"), F.lit(1 << 20)) / float(1 << 20),
    }
    text = F.coalesce("text", F.lit(""))
    slim = durable(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            text_group(F.col("text")).alias("group"),
            *[c.cast("double").alias(n) for n, c in dimensions.items()],
        )
    )
    names = list(dimensions)
    groups = durable(
        slim.groupBy("group")
        .agg(F.sum("size").alias("bytes"), *[F.min(n).alias(n) for n in names])
        .withColumn("digest", F.pmod(F.xxhash64("group"), F.lit(1 << _DIGEST_BITS)))
    )
    placed = slim.join(assign_shards(groups, names, shards).select("group", "shard"), "group").select("doc_id", "size", "text_crc32", "group", "shard")
    return with_slots(placed)


def with_slots(placed: DataFrame) -> DataFrame:
    """Gapless slots from 0 in each shard: rows are numbered inside hashed blocks, after the rows of earlier blocks."""
    placed = durable(placed)
    blocks = -(-(placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 1) // _BLOCK_ROWS)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "group"), F.lit(blocks)).cast("int"))
    earlier = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    first = placed.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("first"))
    inside = W.partitionBy("shard", "block").orderBy("doc_id", "group")
    return placed.join(first, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.row_number().over(inside) - 1 + F.col("first")).cast("long").alias("slot")
    )
