"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within the squared distance 2 - 2c. After a fixed rotation the components are cut into
blocks; whatever the pair, in some block the squared distance is at most that block's share (in proportion to its
dimensions) of the whole. So each block is range-joined under its own budget: vectors are put in cells as wide as the
block's radius along its first axis, and a cell meets itself and the cell before. Every pair that a block lets through is
verified on the original vectors in double precision, and counted in the first block that lets it through, so each link
counts once and no link is lost. Exact copies are one vector with a weight. Cells are cut into chunks of bounded size that
meet pair by pair, so no task holds more than two chunks, and a task returns counts and a spanning forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .components import components, roots, unite

BLOCKS = 4
#: Rows of a cell that one task compares with as many others.
CHUNK = 16384
_TILE = 512
_SLACK = 1e-5  # of the block test, which runs in single precision


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, nothing in it null or not finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_edges(dims: int) -> np.ndarray:
    return np.linspace(0, dims, min(BLOCKS, dims) + 1).astype(int)


def budgets(dims: int, cosine: float) -> np.ndarray:
    return (2 - 2 * cosine) * np.diff(block_edges(dims)) / dims + 1e-12


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    raw = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # far from overflow and underflow
    return raw, raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def compare(left: np.ndarray, right: np.ndarray, left_w: np.ndarray, right_w: np.ndarray, block: int, cosine: float, same: bool):
    """Weights of links for both sides and the forest (over left, then right) of the pairs that ``block`` counts."""
    dims = left.shape[1]
    edges, most, turn = block_edges(dims), budgets(dims, cosine), rotation(dims)
    (lraw, lu), (rraw, ru) = unit(left), unit(right)
    lt, rt = (lu @ turn).astype(np.float32), (ru @ turn).astype(np.float32)
    a, b = edges[block], edges[block + 1]
    # |x - y|^2 = |x|^2 - 2xy + |y|^2 as one product of two matrices
    one = lambda m: np.ones((len(m), 1), np.float32)
    square = lambda m: (m[:, a:b] ** 2).sum(1, keepdims=True)
    wide, tall = np.hstack([-2 * lt[:, a:b], square(lt), one(lt)]), np.hstack([rt[:, a:b], one(rt), square(rt)]).T
    n_left, n_right = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    parent = np.arange(len(left) + (0 if same else len(right)))
    shift = 0 if same else len(left)
    for s in range(0, len(left), _TILE):
        rows = slice(s, min(s + _TILE, len(left)))
        # of a chunk with itself, only what comes after
        after = s if same else 0
        i, j = np.divmod(np.flatnonzero(wide[rows] @ tall[:, after:] <= most[block] + _SLACK), len(right) - after)
        j = j + after
        if same:
            upper = j > i + s
            i, j = i[upper], j[upper]
        for k in range(0, i.size, 1 << 17):
            x, y = i[k : k + (1 << 17)] + s, j[k : k + (1 << 17)]
            # the first block that lets the pair through counts it; the test is the same wherever it is made
            near = ((lu[x] * ru[y]).sum(1)) >= cosine - 1e-9
            x, y = x[near], y[near]
            first = np.ones(x.size, bool)
            for o in range(block):
                c, d = edges[o], edges[o + 1]
                first &= ((lu[x] @ turn[:, c:d] - ru[y] @ turn[:, c:d]) ** 2).sum(1) > most[o]
            own = ((lu[x] @ turn[:, a:b] - ru[y] @ turn[:, a:b]) ** 2).sum(1) <= most[block]
            x, y = x[first & own], y[first & own]
            p, q = lraw[x], rraw[y]
            linked = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1))) >= cosine
            x, y = x[linked], y[linked]
            np.add.at(n_left, x, right_w[y])
            np.add.at(n_right, y, left_w[x])
            unite(parent, x, y + shift)
    return n_left, n_right, roots(parent, np.arange(parent.size))


def near_duplicates(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links (other rows with a cosine of at least ``cosine``), component_id, kept, for every row.

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor does a row without vec_id;
    vectors of different lengths don't compare; exact copies link with each other; rows that repeat a vec_id are rows of
    their own in the counts; an empty table gives none; other columns are ignored. ``cosine`` must be over 0.
    """
    rows = vectors.select("vec_id", "embedding", (usable("embedding") & F.col("vec_id").isNotNull()).alias("ok"))
    groups = durable(rows.filter("ok").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("key", F.monotonically_increasing_id()))  # two vectors may share an id, not a key

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dims, same in part.groupby(part.embedding.map(len)):
                turned = unit(list(same.embedding))[1] @ rotation(dims)
                for block, (start, most) in enumerate(zip(block_edges(dims), budgets(dims, cosine), strict=False)):
                    cell = np.floor(turned[:, start] / np.sqrt(most)).astype(np.int32)
                    yield same.assign(dims=dims, block=block, cell=cell)[["key", "copies", "embedding", "dims", "block", "cell"]]

    schema = f"key long, copies long, embedding {vectors.schema['embedding'].dataType.simpleString()}, dims int, block int, cell int"
    cells = groups.select("key", "copies", "embedding").mapInPandas(placed, schema)
    # a cell is as wide as its block's radius and vectors have length 1: a few cells for each block
    counts = {(r.dims, r.block, r.cell): r["count"] for r in cells.groupBy("dims", "block", "cell").count().collect()}
    chunks = {k: -(-n // CHUNK) for k, n in counts.items()}

    def met(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each vector once for each pair of chunks it stands in; kind: own chunk with own chunk, or the cell before with it."""
        for part in parts:
            out = []
            for (dims, block, cell), of in part.groupby(["dims", "block", "cell"]):
                own, after, before = chunks[dims, block, cell], chunks.get((dims, block, cell + 1), 0), chunks.get((dims, block, cell - 1), 0)
                mine = (of.key.to_numpy() % 0x7FFFFFFF * 0x9E3779B1 >> 7) % own
                for chunk, some in of.groupby(mine):
                    tiles = [(cell, 0, chunk, j, 0) for j in range(chunk, own)] + [(cell, 0, i, chunk, 1) for i in range(chunk)]
                    tiles += [(cell, 1, p, chunk, 1) for p in range(before)] + [(cell + 1, 1, chunk, j, 0) for j in range(after)]
                    out += [some.assign(cell=c, kind=k, i=i, j=j, side=side) for c, k, i, j, side in tiles]
            if out:
                yield pd.concat(out)[["key", "copies", "embedding", "dims", "block", "cell", "kind", "i", "j", "side"]]

    tiles = cells.mapInPandas(met, schema + ", kind int, i int, j int, side int")

    def joined(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, block, _, kind, i, j = (int(x) for x in key)
        part = part.sort_values("key", kind="stable")
        left, right = part[part.side == 0], part[part.side == 1]
        same = kind == 0 and i == j
        if same:
            right = left
        if left.empty or right.empty:
            return pd.DataFrame({"key": [], "links": [], "root": []}).astype("int64")
        one, two = np.stack(list(left.embedding)), np.stack(list(right.embedding))
        n_left, n_right, root = compare(one, two, left.copies.to_numpy(), right.copies.to_numpy(), block, cosine, same)
        ids = left.key.to_numpy() if same else np.concatenate([left.key.to_numpy(), right.key.to_numpy()])
        links = n_left + n_right if same else np.concatenate([n_left, n_right])
        some = links > 0
        return pd.DataFrame({"key": ids[some], "links": links[some], "root": ids[root[some]]})

    found = durable(tiles.groupBy("dims", "block", "cell", "kind", "i", "j").applyInPandas(joined, "key long, links long, root long"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    names = groups.select("key", "rep")
    ends = found.filter("key <> root").select("key", "root").distinct().join(names.withColumnRenamed("rep", "a"), "key")
    ends = ends.select("a", F.col("root").alias("key")).join(names.withColumnRenamed("rep", "b"), "key").select("a", "b")
    reached = components(ends).withColumnRenamed("id", "rep")
    classes = groups.join(links, "key", "left").join(reached, "rep", "left").select(
        "embedding",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    inside = rows.filter("ok").join(classes, "embedding").select("vec_id", "n_links", "component_id")
    outside = rows.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.unionByName(outside).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
