"""Change sets against a stored archive: every entry gets an outcome, and only the new ones are written.

Outcomes: ``pending`` (not confirmed), ``skipped`` (something is missing or unknown; a node that is stored or came earlier),
``duplicate`` (a relation or person that is stored, or accepted earlier in the change set), ``new``. Whether an entry is earlier counts among those that pass all other rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import stripped


def _decided(rows: DataFrame, key: list[str], problem: Column, stored: Column, again: str = "duplicate") -> DataFrame:
    """``rows`` (idx, ...) with outcome, ``again`` for what is stored or came earlier; rows that can't be accepted get a window
    of their own, so none grows hot."""
    open_ = problem.isNull() & ~stored
    alone = F.when(~open_, F.col("idx"))
    rank = F.row_number().over(W.partitionBy(*[F.when(open_, F.col(c)) for c in key], alone).orderBy("idx"))
    return rows.withColumn("outcome", F.coalesce(problem, F.when(stored | (rank > 1), again), F.lit("new")))


def plan_nodes(patch: DataFrame, stored: DataFrame) -> DataFrame:
    """``patch`` (idx, id, name, confirmed) with outcome, ids and names trimmed; ``stored`` has the ids of the archive. An entry
    without id or name, or whose id is stored or came earlier, is skipped."""
    known = stored.select("id", F.lit(True).alias("known")).distinct()
    trimmed = {c: stripped(c) for c in ("id", "name")}
    rows = patch.withColumns(trimmed).join(known, "id", "left")
    blank = F.coalesce((F.col("id") == "") | (F.col("name") == ""), F.lit(True))
    problem = F.when(~F.coalesce("confirmed", F.lit(True)), "pending").when(blank, "skipped")
    return _decided(rows, ["id"], problem, F.coalesce("known", F.lit(False)), "skipped").drop("known")


def plan_edges(patch: DataFrame, stored: DataFrame, ids: DataFrame) -> DataFrame:
    """``patch`` (idx, src, dst, type, confirmed) with outcome; ``ids`` (id): the stored nodes and those the patch adds."""
    end = lambda side: ids.select(F.col("id").alias(side), F.lit(True).alias(f"has_{side}")).distinct()
    known = stored.select("src", "dst", "type", F.lit(True).alias("known")).distinct()
    rows = patch.join(end("src"), "src", "left").join(end("dst"), "dst", "left").join(known, ["src", "dst", "type"], "left")
    problem = F.when(~F.coalesce("confirmed", F.lit(True)), "pending").when(F.col("has_src").isNull() | F.col("has_dst").isNull(), "skipped")
    return _decided(rows, ["src", "dst", "type"], problem, F.coalesce("known", F.lit(False))).drop("has_src", "has_dst", "known")


def appended(note: Column, more: Column) -> Column:
    """``more`` after ``note`` unless it holds it already; a full stop goes between where none stands."""
    gap = F.when(note.rlike("[。！？.]$"), "").otherwise("。")
    return F.when(F.coalesce(more, F.lit("")) == "", note).when(note == "", more).when(F.contains(note, more), note).otherwise(F.concat(note, gap, more))


def apply_updates(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """``stored`` (id, groups, note) after ``updates`` (idx, id, add_groups, add_note), in their order: groups are united in
    order of appearance, notes appended; ``changed`` tells whether anything did change. Updates of unknown ids do nothing."""
    ops = updates.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "add_groups", "add_note"))).alias("ops"))
    note = F.aggregate("ops", F.col("old_note"), lambda acc, o: appended(acc, o["add_note"]))
    groups = F.array_distinct(F.concat("old_groups", F.flatten(F.transform("ops", lambda o: F.coalesce(o["add_groups"], F.expr("CAST(array() AS array<string>)"))))))
    both = stored.withColumnsRenamed({"note": "old_note", "groups": "old_groups"}).join(ops, "id", "left")
    new = both.withColumns({"note": F.when(F.col("ops").isNull(), F.col("old_note")).otherwise(note), "groups": F.when(F.col("ops").isNull(), F.col("old_groups")).otherwise(groups)})
    return new.withColumn("changed", (F.col("note") != F.col("old_note")) | (F.size("groups") != F.size("old_groups"))).drop("ops", "old_note", "old_groups")


def apply_plan(stored: DataFrame, planned: DataFrame) -> DataFrame:
    """The stored rows and those planned as new, in the stored columns; applied twice it adds nothing."""
    return stored.unionByName(planned.filter("outcome = 'new'").select(*stored.columns))
