"""Reports: counts and shares of manifests, groups, speakers and relation types; visibility, slices and slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .graph import degree, oriented
from .names import groups_or
from .ordered import placed


def manifest_counts(files: DataFrame) -> DataFrame:
    """measure, value, n of ``files`` (status, kind, grp): files by status and by kind, and the number of groups."""
    each = files.select(F.explode(F.array(F.struct(F.lit("status").alias("measure"), F.col("status").alias("value")), F.struct(F.lit("kind").alias("measure"), F.col("kind").alias("value")))).alias("m"))
    counts = each.groupBy("m.measure", "m.value").agg(F.count("*").alias("n"))
    return counts.unionByName(files.agg(F.lit("groups").alias("measure"), F.lit(None).cast("string").alias("value"), F.countDistinct("grp").alias("n")))


def group_sizes(nodes: DataFrame, default: str = "(none)") -> DataFrame:
    """grp, n; nodes without a real group count under ``default``."""
    return nodes.select(F.explode(groups_or(F.col("groups"), default)).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))


def housekeeping(**parts: DataFrame) -> DataFrame:
    """grp and a count for each part (frames with grp), 0 where a group has none."""
    each = [p.groupBy("grp").agg(F.count("*").alias("n")).select("grp", F.lit(name).alias("part"), "n") for name, p in parts.items()]
    every = each[0]
    for e in each[1:]:
        every = every.unionByName(e)
    return every.groupBy("grp").agg(*[F.coalesce(F.sum(F.when(F.col("part") == name, F.col("n"))), F.lit(0)).alias(name) for name in parts])


def totals(lines: DataFrame, file: str, who: str, tokens: Column, seconds: Column) -> DataFrame:
    """file, who, lines, tokens, seconds: by file and speaker, by file (null speaker), and of all (both null)."""
    return lines.rollup(file, who).agg(F.count("*").alias("lines"), F.sum(tokens).alias("tokens"), F.sum(seconds).alias("seconds"))


def type_profile(edges: DataFrame, text: str, compound: str, anchored: str) -> DataFrame:
    """edges, types, compound types, edges with a compound type, edges whose ``text`` holds a time (patterns), percent of these."""
    is_compound = F.col("type").rlike(compound)
    return edges.agg(
        F.count("*").alias("n"),
        F.countDistinct("type").alias("types"),
        F.countDistinct(F.when(is_compound, F.col("type"))).alias("compound_types"),
        F.count_if(is_compound).alias("compound_edges"),
        F.count_if(F.col(text).rlike(anchored)).alias("anchored"),
        F.expr(f"count_if({text} RLIKE '{anchored}') * 100 DIV greatest(count(*), 1)").alias("anchored_percent"),
    )


def type_samples(edges: DataFrame, text: str, order: list[str], samples: int = 3, most: int = 70) -> DataFrame:
    """type, n, samples: the first texts of each type that aren't blank, cut to ``most`` code points, in file order."""
    cut = F.nullif(F.substring(F.trim(F.col(text)), 1, most), F.lit(""))
    first = F.row_number().over(W.partitionBy("type").orderBy(*order))
    some = edges.withColumn("cut_", cut).filter("cut_ IS NOT NULL").withColumn("at_", first).filter(F.col("at_") <= samples)
    shown = some.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("at_", "cut_"))), lambda s: s["cut_"]).alias("samples"))
    return edges.groupBy("type").agg(F.count("*").alias("n")).join(shown, "type", "left").withColumn("samples", F.coalesce("samples", F.expr("CAST(array() AS array<string>)")))


def visible(nodes: DataFrame, excluded: list[str], part: str | None = None) -> DataFrame:
    """Nodes that a graph shows: not excluded, not marked as left out (in_graph), some group holding ``part``."""
    shown = nodes.filter(~F.col("id").isin(excluded) & F.coalesce("in_graph", F.lit(True))) if excluded else nodes.filter(F.coalesce("in_graph", F.lit(True)))
    return shown if part is None else shown.filter(F.exists(F.coalesce("groups", F.expr("CAST(array() AS array<string>)")), lambda g: F.contains(g, F.lit(part))))


def in_scope(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that have an id and aren't unconfirmed, and the edges between two of them that are no loops and confirmed too."""
    confirmed = lambda df: df.filter(F.coalesce("confirmed", F.lit(True))) if "confirmed" in df.columns else df
    kept = confirmed(nodes).filter("id <> ''")
    ids = lambda side: kept.select(F.col("id").alias(side)).distinct()
    return kept, confirmed(edges).filter("src <> dst").join(ids("src"), "src", "left_semi").join(ids("dst"), "dst", "left_semi")


def time_slice(lines: DataFrame, start: str, end: str, first: float, last: float) -> DataFrame:
    """The lines that begin and end within the inclusive range."""
    return lines.filter(F.col(start).between(first, last) & F.col(end).between(first, last))


def neighbour_list(edges: DataFrame) -> DataFrame:
    """id, place, other, type, strength: each node's neighbours, strongest first, then the ones with most relations."""
    order = W.partitionBy("id").orderBy(F.desc("strength"), F.desc("degree"), "other", "type")
    each = oriented(edges).join(degree(edges).withColumnRenamed("id", "other"), "other")
    return each.select("id", F.row_number().over(order).alias("place"), "other", "type", "strength", "degree")


def perspectives(nodes: DataFrame, default: str = "(none)") -> DataFrame:
    """perspective, value, n, place: nodes by group, by who plays them and by kind, the largest first."""
    views = F.flatten(
        F.array(
            F.transform(groups_or(F.col("groups"), default), lambda g: F.struct(F.lit("group").alias("perspective"), g.alias("value"))),
            F.array(F.struct(F.lit("played_by").alias("perspective"), F.coalesce(F.nullif("played_by", F.lit("")), F.lit(default)).alias("value"))),
            F.array(F.struct(F.lit("kind").alias("perspective"), F.coalesce("kind", F.lit(default)).alias("value"))),
        )
    )
    counts = nodes.select(F.explode(views).alias("v")).groupBy("v.perspective", "v.value").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy("perspective").orderBy(F.desc("n"), "value")))


def slots(members: DataFrame, given: DataFrame, next_slot: int = 0) -> DataFrame:
    """id, slot of ``members`` (id, name): those of ``given`` (id, slot) stay, the others follow in the order of name and id
    behind every slot in use. No task ranks all members, or all of a name."""
    kept = members.join(given, "id").select("id", F.col("slot").cast("long").alias("slot"))
    free = members.join(given.select("id"), "id", "left_anti").select("id", F.coalesce("name", F.lit("")).alias("name"))
    start = kept.agg(F.greatest(F.coalesce(F.max("slot") + 1, F.lit(0)), F.lit(next_slot)).alias("start"))  # one row
    return kept.unionByName(placed(free, ["name", "id"]).join(F.broadcast(start)).select("id", (F.col("start") + F.col("position")).alias("slot")))


def talk_summary(messages: DataFrame, speaker: str, name: str, kind: str, order: str) -> DataFrame:
    """what (speaker, type), key, n, last_name: messages of each speaker with the name seen last, and of each type (null name).

    A missing speaker, name or type is ``?``. Both counts come from one pass and are combined before the shuffle.
    """
    known = messages.select(*[F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(n) for c, n in ((speaker, "s_"), (name, "n_"), (kind, "k_"))], F.col(order).alias("o_"))
    totals = known.groupingSets([["s_"], ["k_"]], "s_", "k_").agg(F.grouping("s_").alias("g_"), F.count("*").alias("n"), F.max_by("n_", F.struct("o_", "n_")).alias("last_"))
    by_type = F.col("g_") == 1
    return totals.select(F.when(by_type, "type").otherwise("speaker").alias("what"), F.when(by_type, F.col("k_")).otherwise(F.col("s_")).alias("key"), "n", F.when(~by_type, F.col("last_")).alias("last_name"))
