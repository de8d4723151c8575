"""A Merkle manifest of a dataset, with proofs looked up by coordinates.

The leaves of a partition (a language) stand in the order of their ids; runs of ``fanout`` consecutive nodes are hashed into
their parents until one is left, the subroot; the subroots in the order of their partitions are hashed likewise into the root.

The node table is written in rounds of ``LEVELS`` levels: what one block of ``fanout ** LEVELS`` consecutive nodes yields needs
nothing else. A proof is looked up in that table: a node's place and the fanout give the coordinates (level, place) of all its
siblings in a round, these are exploded and joined with the table, put in order and concatenated; the proof of the block's own
node is its continuation. So no node is looked up by more than a block's nodes, be a partition as large as it may, and the
coordinates of a leaf don't grow with the table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.operators.ordered import placed

from .common import durable

#: What a leaf holds, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a round.
LEVELS = 6
_PATH = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """The digest of fields: ``-`` for null, else the number of their UTF-8 bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def proof_digest(path: Column) -> Column:
    """The digest of a proof's siblings, from the leaf's level to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, s: digest(s["before"], node, s["after"]))


def _up(n: Column, by: int) -> Column:
    return F.floor((n + (by - 1)) / F.lit(by)).cast("long") if by > 1 else n


@dataclass
class Grown:
    """The rounds of a forest's node table (tree, n, level, place, node; ``n`` nodes at the round's first level) and the trees'
    roots (tree, round, root)."""

    rounds: list[DataFrame]
    roots: DataFrame
    fanout: int


def grown(leaves: DataFrame, fanout: int) -> Grown:
    """The forest over ``leaves`` (tree, n, place, node): ``place`` from 0, ``n`` the tree's leaves, ``node`` a binary digest."""
    span, none = fanout**LEVELS, F.expr("CAST(array() AS array<struct<level: int, place: bigint, node: binary>>)")
    widest = leaves.agg(F.max("n")).first()[0] or 0
    rounds, roots, below = [], [], leaves
    while widest > 0:
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: F.lower(F.hex(x["node"])))
        blocks = below.groupBy("tree", "n", F.expr(f"place div {span}").alias("block")).agg(in_order.alias("level0"))
        for level in range(1, LEVELS + 1):
            low = f"level{level - 1}"
            last = F.expr(f"(size({low}) - 1) div {fanout}")
            run = F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.array_join(F.slice(low, i * fanout + 1, F.lit(fanout)), "").cast("binary"), 256))  # noqa: B023
            blocks = blocks.withColumn(f"level{level}", F.when((F.col("n") > span) | (F.size(low) > 1), run))
        each = [
            F.coalesce(
                F.transform(
                    f"level{level}",
                    lambda node, i: F.struct(F.lit(level).alias("level"), (F.col("block") * fanout ** (LEVELS - level) + i).alias("place"), F.unhex(node).alias("node")),  # noqa: B023
                ),
                none,
            )
            for level in range(LEVELS + 1)
        ]
        nodes = durable(blocks.select("tree", "n", F.explode(F.flatten(F.array(*each))).alias("e")).select("tree", "n", "e.*"))
        one = reduce(lambda o, level: F.when(F.col("level") == level, _up(F.col("n"), fanout**level) == 1).otherwise(o), range(LEVELS + 1), F.lit(False))
        least = reduce(lambda o, level: F.when(F.col("level") == level, _up(F.col("n"), fanout ** (level - 1)) > 1).otherwise(o), range(1, LEVELS + 1), F.lit(True))
        roots.append(nodes.filter((F.col("n") <= span) & one & least).select("tree", F.lit(len(rounds)).alias("round"), F.col("node").alias("root")))
        rounds.append(nodes)
        below = nodes.filter((F.col("n") > span) & (F.col("level") == LEVELS)).select("tree", _up(F.col("n"), span).alias("n"), "place", "node")
        widest = -(-widest // span) if widest > span else 0
    if not roots:
        return Grown([], leaves.select("tree", F.lit(0).alias("round"), F.col("node").alias("root")), fanout)
    return Grown(rounds, reduce(DataFrame.unionByName, roots), fanout)


def siblings(fanout: int) -> Column:
    """The coordinates (level, place) of a node's siblings in a round, from its place and the round's ``n``; besides, at level
    -1, the node itself, so that it stays where it has none."""
    own, n, out = F.col("place"), F.col("n"), [F.array(F.struct(F.lit(-1).alias("level"), F.col("place").alias("place")))]
    for level in range(LEVELS):
        at = F.floor(own / fanout**level).cast("long")
        first = F.floor(own / fanout ** (level + 1)).cast("long") * fanout
        last = F.least(first + (fanout - 1), _up(n, fanout**level) - 1)
        out.append(F.transform(F.filter(F.sequence(first, last), lambda i: i != at), lambda i: F.struct(F.lit(level).alias("level"), i.alias("place"))))  # noqa: B023
    return F.flatten(F.array(*out))


def proofs(forest: Grown, above: DataFrame, kept: DataFrame) -> DataFrame:
    """``kept`` (tree, n, place, and what to keep of each leaf in a struct ``row``) with ``path``: the siblings before and after
    the leaf and its ancestors, level by level, and the tree's ``note``. ``above`` (tree, note, path) continues the paths of the
    trees' roots."""
    fanout, span, upper = forest.fanout, forest.fanout**LEVELS, None
    for number in reversed(range(len(forest.rounds))):
        nodes = forest.rounds[number]
        low = kept if number == 0 else nodes.filter("level = 0").select("tree", "n", "place", F.lit(0).alias("row"))
        asked = low.select("tree", "n", "row", F.col("place").alias("own"), F.explode(siblings(fanout)).alias("s"))
        asked = asked.select("tree", "n", "own", F.when(F.col("s.level") == -1, F.col("row")).alias("row"), "s.level", "s.place")
        found = asked.join(nodes.select("tree", "level", "place", "node"), ["tree", "level", "place"], "left")
        found = found.withColumn("block", F.expr(f"own div {span}")).repartition("tree", "block")
        known = F.collect_list(F.when(F.col("level") >= 0, F.struct("level", "place", "node")))
        each = found.groupBy("tree", "block", "own", "n").agg(known.alias("known"), F.max("row").alias("row"))
        side = lambda level, of: F.array_join(F.transform(F.filter("known", lambda s: (s["level"] == level) & of(s["place"], level)), lambda s: F.lower(F.hex(s["node"]))), "")
        at = lambda level: F.floor(F.col("own") / fanout**level).cast("long")
        steps = [
            F.when(_up(F.col("n"), fanout**level) > 1, F.struct(side(level, lambda p, k: p < at(k)).alias("before"), side(level, lambda p, k: p > at(k)).alias("after")))
            for level in range(LEVELS)
        ]
        each = each.withColumn("known", F.array_sort("known")).select("tree", "block", "own", "row", F.filter(F.array(*steps), lambda s: s.isNotNull()).alias("path"))
        done = forest.roots.filter(F.col("round") == number).select("tree").join(above, "tree").select("tree", F.lit(0).cast("long").alias("block"), "note", F.col("path").alias("rest"))
        rest = done if upper is None else done.unionByName(upper.select("tree", F.col("own").alias("block"), "note", F.col("path").alias("rest")))
        upper = each.join(rest, ["tree", "block"]).select("tree", "own", "row", "note", F.concat("path", "rest").alias("path"))
    if upper is None:  # no leaves
        return kept.join(above, "tree").select("tree", F.col("place").alias("own"), "row", "note", "path")
    return upper


def manifest(docs: DataFrame, altered: dict[str, Column] | None = None, fanout: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, path (array of siblings before and after, level by level) and now (the leaf as it is with
    the columns ``altered``) of every document.

    Null fields are values of their own; null ids stand first in their language and a null language first among these; rows
    that repeat an id in a language stand in the order of their leaves, equal rows are leaves each; texts are hashed whole; an
    empty table gives none. Other columns are ignored.
    """
    if fanout < 2:
        raise ValueError("a run has two nodes at least")
    fields = {c: F.col(c) for c in FIELDS}
    tree = F.coalesce(F.concat(F.lit("."), F.col("lang").cast("string")), F.lit(""))
    rows = docs.select("doc_id", tree.alias("tree"), leaf(*fields.values()).alias("leaf"), leaf(*(fields | (altered or {})).values()).alias("now"))
    rows = rows.select("doc_id", "tree", F.unhex("leaf").alias("node"), F.when(F.col("leaf") != F.col("now"), F.unhex("now")).alias("now"))
    leaves = durable(placed(rows, ["doc_id", "node"], ["tree"], "place", "n"))
    forest = grown(leaves.select("tree", "n", "place", "node"), fanout)
    subroots = durable(placed(forest.roots.select(F.lit("").alias("all"), "tree", F.col("root").alias("node")), ["tree"], [], "place", "n"))
    top = grown(subroots.select(F.col("all").alias("tree"), "n", "place", "node"), fanout)
    nothing = subroots.limit(1).select(F.col("all").alias("tree"), F.lit("").alias("note"), F.expr(f"CAST(array() AS {_PATH})").alias("path"))
    of_top = proofs(top, nothing, subroots.select(F.col("all").alias("tree"), "n", "place", F.struct("tree", "node").alias("row")))
    hexed = lambda c: F.lower(F.hex(c))
    above = durable(of_top.select("row.tree", hexed("row.node").alias("note"), "path"))
    found = proofs(forest, above, leaves.select("tree", "n", "place", F.struct(F.lit(1).alias("there"), "doc_id", "node", "now").alias("row")))
    root = top.roots.select(hexed("root").alias("root"))  # one row at most
    return found.join(F.broadcast(root)).select(
        "row.doc_id", hexed("row.node").alias("leaf"), F.col("note").alias("subroot"), "root", "path", hexed(F.coalesce("row.now", "row.node")).alias("now")
    )
