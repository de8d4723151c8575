"""Graph operators over nodes (id, name, groups, ...) and edges (src, dst, type, strength, event_ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.durable import durable
from ..sources.tables import tasks as table_tasks
from . import contacts

ORDER = ("event_ord", "src", "dst", "type")


def dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``rows`` dealt by their keys to so many tasks; left as they are where no number is given."""
    return rows.repartition(tasks, *keys) if tasks else rows


def degree(edges: DataFrame) -> DataFrame:
    """id, degree: ends of edges, so a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def oriented(edges: DataFrame) -> DataFrame:
    """id, other and the edge's columns, once from each end; loops are left out."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))
    return edges.filter("src <> dst").select(F.explode(ends).alias("e"), *rest).select("e.id", "e.other", *rest)


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among ``nodes``."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """side, id, src, dst, type: ends of edges that no node has."""
    parts = []
    for side in ("src", "dst"):
        missing = edges.join(nodes.select(F.col("id").alias(side)), side, "left_anti")
        parts.append(missing.select(F.lit(side).alias("side"), F.col(side).alias("id"), "src", "dst", "type"))
    return parts[0].unionByName(parts[1])


def with_groups(nodes: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges with the groups of both ends (ga, gb). Nodes are dealt by id to ``tasks``, and so are the edges that meet them."""
    n = dealt(nodes.select("id", "groups"), tasks, "id")
    return edges.join(n.withColumnsRenamed({"id": "src", "groups": "ga"}), "src").join(n.withColumnsRenamed({"id": "dst", "groups": "gb"}), "dst")


def density(nodes: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per group: nodes, inner edges, edges for each node, nodes without an inner edge."""
    of = dealt(nodes.select("id", F.explode("groups").alias("grp")), tasks, "grp", "id")
    common = F.flatten(F.transform("ga", lambda a: F.filter("gb", lambda b: a == b)))
    inner = with_groups(nodes, edges.select("src", "dst"), tasks).select("src", "dst", F.explode(common).alias("grp"))
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("leaves")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("leaves")))
    linked = dealt(inner.select("grp", F.explode(ends).alias("e")).select("grp", "e.id", "e.leaves"), tasks, "grp", "id").groupBy("grp", "id").agg(F.sum("leaves").alias("leaves"))
    counts = of.groupBy("grp", "id").agg(F.count("*").alias("n")).join(linked, ["grp", "id"], "left").groupBy("grp").agg(
        F.sum("n").alias("n_nodes"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("n_edges"), (F.sum("n") - F.count("leaves")).alias("n_isolated")
    )
    return counts.select("grp", "n_nodes", "n_edges", (F.col("n_edges") / F.greatest("n_nodes", F.lit(1))).alias("density"), "n_isolated")


def neighbour_stats(nodes: DataFrame, edges: DataFrame, strong: int = 3) -> DataFrame:
    """id, name, neighbours, strong neighbours, neighbours of no common group, edges."""
    of = nodes.select(F.col("id").alias("other"), F.col("groups").alias("other_groups"))
    met = oriented(edges).join(nodes.select("id", "name", "groups"), "id").join(of, "other")
    per = met.groupBy("id", "name", "other").agg(
        F.max("strength").alias("strength"), F.count("*").alias("n"), F.first(~F.arrays_overlap("groups", "other_groups")).alias("cross_")
    )
    return per.groupBy("id", "name").agg(
        F.count("*").alias("neighbours"), F.count_if(F.col("strength") >= strong).alias("strong"), F.count_if("cross_").alias("cross_groups"), F.sum("n").alias("n_edges")
    )


def pair_first(edges: DataFrame, strongest: bool = False, tasks: int | None = None) -> DataFrame:
    """One edge for each unordered pair: the first by file order, or the strongest and then the first."""
    order = [F.desc("strength")] * strongest + [F.col(c) for c in ORDER]
    pairs = dealt(edges.withColumns({"low_": F.least("src", "dst"), "high_": F.greatest("src", "dst")}), tasks, "low_", "high_")
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("low_", "high_").orderBy(*order))).filter("rank = 1").drop("rank", "low_", "high_")


def steps_from(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """id, other: every edge once from each end (loops left out), dealt by id to twice as many tasks as edges are."""
    return dealt(oriented(edges).select("id", "other"), tasks and 2 * tasks, "id")


def breadth_first(edges: DataFrame, roots: DataFrame, depth: int, tasks: int | None = None) -> DataFrame:
    """root, id, dist: what each root (root) reaches in at most ``depth`` steps; a few joins, each against the new ones only."""
    steps = steps_from(edges, tasks)  # what stands twice goes when the new ones are told apart
    seen = roots.select("root", F.col("root").alias("id"), F.lit(0).alias("dist"))
    new = seen
    for d in range(1, depth + 1):
        new = new.join(steps, "id").select("root", F.col("other").alias("id")).distinct().join(seen, ["root", "id"], "left_anti").withColumn("dist", F.lit(d))
        seen = seen.unionByName(new)
    return seen


def discovery(edges: DataFrame, roots: DataFrame, depth: int, tasks: int | None = None) -> DataFrame:
    """root, id, dist, parent: as :func:`breadth_first`, with who led to whom: of the nodes one step nearer the one that was
    itself found first, by its own chain of finders and then by id."""
    steps = steps_from(edges, tasks)
    new = roots.select("root", F.col("root").alias("id"), F.lit(0).alias("dist"), F.lit(None).cast("string").alias("parent"), F.expr("CAST(array() AS array<string>)").alias("chain"))
    seen = new
    for d in range(1, depth + 1):
        led = new.join(steps, "id").select("root", F.col("other").alias("id"), F.col("id").alias("parent"), F.array_append("chain", F.col("id")).alias("chain"))
        first = led.groupBy("root", "id").agg(F.min("chain").alias("chain")).join(seen.select("root", "id"), ["root", "id"], "left_anti")
        new = first.select("root", "id", F.lit(d).alias("dist"), F.element_at("chain", -1).alias("parent"), "chain")
        seen = seen.unionByName(new)
    return seen.drop("chain")


def level_edges(edges: DataFrame, found: DataFrame, depth: int, tasks: int | None = None) -> DataFrame:
    """root, dist, edges: how many edges each step of a search (root, id, dist) looks at."""
    looked = found.filter(F.col("dist") < depth).join(steps_from(edges, tasks), "id")
    return looked.groupBy("root", (F.col("dist") + 1).alias("dist")).agg(F.count("*").alias("edges"))


def ego_groups(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, grp, n, own: in which groups a root's neighbours are, and whether the root is."""
    near = roots.join(oriented(edges).select(F.col("id").alias("root"), "other").distinct(), "root")
    each = near.join(nodes.select(F.col("id").alias("other"), F.explode("groups").alias("grp")), "other").groupBy("root", "grp").agg(F.count("*").alias("n"))
    own = nodes.select(F.col("id").alias("root"), F.explode("groups").alias("grp"), F.lit(True).alias("own"))
    return each.join(own, ["root", "grp"], "left").withColumn("own", F.coalesce("own", F.lit(False)))


def common_contacts(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b (a < b), common: neighbours that both ends of the given pairs (of different nodes, in any order) have, if any.

    A common neighbour closes a triangle of relations and the pair; those are counted over numbers that stand for the nodes.
    """
    every = edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(contacts.RELATION).alias("f"))
    every = every.unionByName(pairs.filter("a <> b").select("a", "b", F.lit(contacts.ASKED).alias("f")))
    ids = durable(every.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("number", F.monotonically_increasing_id()))
    of = lambda x, y: ids.withColumnsRenamed({"id": x, "number": y})
    links = durable(every.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("f").cast("long").alias("f")))
    order = contacts.listed(links.select(F.explode(F.array("a", "b"))), 2 * links.count())
    found = contacts.common(links, order, table_tasks(links))
    named = found.join(of("a", "x"), "x").join(of("b", "y"), "y")
    return named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common")


def merge_nodes(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges after every ``src_id`` became ``dst_id`` (merges): new loops go, old ones stay, a moved edge beats one that
    stood, the later moved beats the earlier."""
    names = merges.select("src_id", "dst_id")
    moved = (
        edges.join(names.withColumnsRenamed({"src_id": "src", "dst_id": "new_src"}), "src", "left")
        .join(names.withColumnsRenamed({"src_id": "dst", "dst_id": "new_dst"}), "dst", "left")
        .select(
            F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "type", "strength", "event_ord",
            (F.col("new_src").isNotNull() | F.col("new_dst").isNotNull()).alias("moved"), F.col("src").alias("old_src"), F.col("dst").alias("old_dst"),
        )
    )
    kept = moved.filter(~F.col("moved") | (F.col("src") != F.col("dst")))
    rank = F.row_number().over(W.partitionBy("src", "dst", "type").orderBy(F.desc("moved"), F.desc("event_ord"), F.desc("old_src"), F.desc("old_dst")))
    return kept.withColumn("rank", rank).filter("rank = 1").select("src", "dst", "type", "strength", "event_ord", "moved")


def merge_records(nodes: DataFrame, merges: DataFrame, texts: tuple[str, ...] = ("note",), inherited: tuple[str, ...] = ("played_by",)) -> DataFrame:
    """``nodes`` (id, name, aliases, groups, tags, ``texts``, ``inherited``) after ``merges`` (src_id, dst_id), with merged_from.

    The other's name and aliases become aliases, groups and tags are united; a text that neither holds the other is appended
    with its origin; inherited fields fill what is empty; what was merged is gone. Several into one: in the order of their ids.
    """
    none = F.expr("CAST(array() AS array<string>)")
    gone = nodes.withColumnRenamed("id", "src_id").join(merges, "src_id")
    parts = gone.groupBy("dst_id").agg(F.array_sort(F.collect_list(F.struct("src_id", "name", "aliases", "groups", "tags", *texts, *inherited))).alias("parts"))
    kept = nodes.join(merges.select(F.col("src_id").alias("id")), "id", "left_anti").join(parts.withColumnRenamed("dst_id", "id"), "id", "left").withColumn("parts", F.coalesce("parts", F.array().cast(parts.schema["parts"].dataType)))
    united = lambda old, field: F.array_distinct(F.concat(F.coalesce(old, none), F.flatten(F.transform("parts", lambda p: F.coalesce(p[field], none)))))
    names = F.flatten(F.transform("parts", lambda p: F.concat(F.array(p["name"]), F.coalesce(p["aliases"], none))))
    aliases = F.concat(F.coalesce("aliases", none), F.array_distinct(F.array_except(F.filter(names, lambda x: (x != "") & (x != F.col("name"))), F.coalesce("aliases", none))))

    def joined(c: str) -> Column:
        def step(acc: Column, p: Column) -> Column:
            more = F.trim(F.coalesce(p[c], F.lit("")))
            held = (more == "") | F.contains(acc, more) | ((acc != "") & F.contains(more, acc))
            return F.when(acc == "", more).when(held, acc).otherwise(F.concat(acc, F.lit("\n\n("), p["name"], F.lit(")\n"), more))

        return F.aggregate("parts", F.trim(F.coalesce(c, F.lit(""))), step)

    filled = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.try_element_at(F.filter(F.transform("parts", lambda p: F.nullif(F.trim(p[c]), F.lit(""))), lambda x: x.isNotNull()), F.lit(1)))
    new = {"aliases": aliases, "groups": united(F.col("groups"), "groups"), "tags": united(F.col("tags"), "tags"), **{c: joined(c) for c in texts}, **{c: filled(c) for c in inherited}}
    return kept.select("id", "name", *[v.alias(k) for k, v in new.items()], F.transform("parts", lambda p: p["src_id"]).alias("merged_from"))


def kind(tag: Column) -> Column:
    """KP before BOSS before PC before NPC."""
    return F.when(tag == "KP", "kp").when(tag == "BOSS", "boss").when(tag == "PC", "pc").otherwise("npc")


def merge_values(values: DataFrame, merges: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``values`` (id, ``by``, value, ord) after every ``src_id`` became ``dst_id``: a value stands once for each node and ``by``
    (a dimension of attributes, the group of events), with origin (null: the node's own) and ord, which order them: the
    node's own first, then what came with each merged node, by their ids.

    Values are rows, so what repeats is combined before the shuffle and no node's values are one array. Null and empty values
    go; a null in ``by`` is a value. Merges of merged nodes aren't followed, as in :func:`merge_nodes`.
    """
    names = merges.select(F.col("src_id").alias("id"), "dst_id")
    moved = values.filter("value <> ''").join(names, "id", "left").select(F.coalesce("dst_id", "id").alias("id"), *by, "value", F.when(F.col("dst_id").isNotNull(), F.col("id")).alias("origin"), "ord")
    first = moved.groupBy("id", *by, "value").agg(F.min(F.struct(F.col("origin").isNotNull().alias("came"), "origin", "ord")).alias("first_"))
    return first.select("id", *by, "value", "first_.origin", "first_.ord")


def merge_counts(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """src_id, dst_id, moved, dropped of every merge: relations that touched the merged node, and those of them that went as new
    loops or met one that stood or had been moved there.

    Of relations that meet the first (one that stood, else the earliest moved) counts for none; a relation between two merged
    nodes moves with both and is dropped for the later. Only counts are combined, no group is sorted.
    """
    ends = merges.select("src_id", "dst_id")
    touched = (
        edges.join(ends.withColumnsRenamed({"src_id": "src", "dst_id": "new_src"}), "src", "left").join(ends.withColumnsRenamed({"src_id": "dst", "dst_id": "new_dst"}), "dst", "left")
        .withColumn("from_", F.when(F.col("new_src").isNotNull(), F.col("src"))).withColumn("to_", F.when(F.col("new_dst").isNotNull(), F.col("dst")))
        .select(F.coalesce("new_src", "src").alias("a"), F.coalesce("new_dst", "dst").alias("b"), "type", "event_ord", F.col("src").alias("s"), F.col("dst").alias("d"), "from_", "to_", F.greatest("from_", "to_").alias("last_"))
    )
    moved = touched.filter("last_ IS NOT NULL")
    each = moved.select(F.explode(F.array_distinct(F.array_compact(F.array("from_", "to_")))).alias("src_id")).groupBy("src_id").agg(F.count("*").alias("moved"))
    falls = moved.groupBy(F.col("last_").alias("src_id")).agg(F.count("*").alias("all_"))
    apart = touched.filter("last_ IS NULL OR a <> b")  # of a loop nothing stays
    by = F.struct(F.col("last_").isNotNull().alias("moved_"), "event_ord", "s", "d", F.col("last_").alias("src_id"))
    stay = apart.groupBy("a", "b", "type").agg(F.min(by).alias("f")).filter("f.moved_").groupBy("f.src_id").agg(F.count("*").alias("stay_"))
    out = ends.join(each, "src_id", "left").join(falls, "src_id", "left").join(stay, "src_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("src_id", "dst_id", zero("moved").alias("moved"), (zero("all_") - zero("stay_")).alias("dropped"))
