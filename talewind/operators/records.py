"""Editing stored records: relations set and removed by key, roles of people, decisions of reviewers, lint and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .graph import dealt


def upsert_edges(edges: DataFrame, upserts: DataFrame, ids: DataFrame) -> DataFrame:
    """``edges`` (src, dst, type, strength, event_ord) after ``upserts`` (seq, src, dst, old_type, type, strength).

    The last upsert of a pair counts; its ends must be in ``ids`` and differ. It changes the pair's relation of the old type,
    else the pair's first, else it is appended with its seq as event_ord. Another relation of the pair that has the new type
    already gives way to it.
    """
    newest = upserts.groupBy("src", "dst").agg(F.max(F.struct("seq", "type", "old_type", "strength")).alias("u"))
    known = lambda side: ids.select(F.col("id").alias(side)).distinct()
    valid = newest.filter("src <> dst").join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi")
    both = edges.join(valid, ["src", "dst"], "left")
    first = W.partitionBy("src", "dst").orderBy((~F.col("type").eqNullSafe(F.col("u.old_type"))).cast("int"), "event_ord", "type")
    ranked = both.withColumn("place", F.row_number().over(first))
    hit = F.col("u").isNotNull() & (F.col("place") == 1)
    changed = ranked.filter(F.col("u").isNull() | hit | (F.col("type") != F.col("u.type"))).select(
        "src", "dst", F.when(hit, F.col("u.type")).otherwise(F.col("type")).alias("type"), F.when(hit, F.col("u.strength")).otherwise(F.col("strength")).alias("strength"), "event_ord"
    )
    appended = valid.join(edges, ["src", "dst"], "left_anti").select("src", "dst", "u.type", "u.strength", F.col("u.seq").alias("event_ord"))
    return changed.unionByName(appended)


def delete_edges(edges: DataFrame, deletes: DataFrame, tasks: int | None = None) -> DataFrame:
    """``edges`` without those that ``deletes`` (src, dst, type) name; a null type is any type of the pair."""
    gone = dealt(deletes, tasks, "src", "dst").groupBy("src", "dst").agg(F.max(F.col("type").isNull()).alias("every"), F.collect_set("type").alias("types"))
    left = dealt(edges, tasks, "src", "dst").join(gone, ["src", "dst"], "left")
    return left.filter(F.col("every").isNull() | ~(F.col("every") | F.array_contains("types", F.col("type")))).select(*edges.columns)


def add_roles(people: DataFrame, updates: DataFrame) -> DataFrame:
    """uid, grp, role, idx: the roles that ``updates`` (idx, uid, grp, role) give to known people, each once, by its first update."""
    return updates.join(people.select("uid").distinct(), "uid", "left_semi").groupBy("uid", "grp", "role").agg(F.min("idx").alias("idx"))


def decide(entries: DataFrame, decisions: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``entries`` (idx, ``fields``) after ``decisions`` (seq, idx, action, field, value) in their order, with status.

    ``set`` writes a field, the last one counts; status is the last ``accept`` or ``reject``, else ``open``. Decisions on
    entries that aren't there do nothing. Combined by entry before the shuffle.
    """
    last = lambda value, when: F.max_by(value, F.when(when, F.col("seq")))
    is_set = lambda f: (F.col("action") == "set") & (F.col("field") == f)
    outcome = decisions.groupBy("idx").agg(
        last("action", F.col("action").isin("accept", "reject")).alias("status_"),
        *[F.struct(F.max(is_set(f)).alias("any"), last("value", is_set(f)).alias("value")).alias(f"{f}_") for f in fields],
    )
    values = [F.when(F.col(f"{f}_.any"), F.col(f"{f}_.value")).otherwise(F.col(f)).alias(f) for f in fields]
    return entries.join(outcome, "idx", "left").select("idx", *values, F.coalesce("status_", F.lit("open")).alias("status"))


def lint_nodes(patch: DataFrame) -> DataFrame:
    """One row for each id of ``patch`` (idx, id, name; both trimmed): its first name that isn't blank, how many different names and rows."""
    patch = patch.withColumns({"id": F.trim("id"), "name": F.trim("name")})
    named = F.when(F.col("name") != "", F.col("idx"))
    return patch.filter("id <> ''").groupBy("id").agg(
        F.min_by("name", named).alias("name"), F.countDistinct(F.when(F.col("name") != "", F.col("name"))).alias("names"), F.count("*").alias("n")
    )


def issues(patch: DataFrame) -> DataFrame:
    """issue, id, n: ids (trimmed) that stand more than once, blank ids, and entries with a blank name."""
    patch = patch.withColumns({"id": F.trim("id"), "name": F.trim("name")})
    blank = F.coalesce(F.col("id") == "", F.lit(True))
    nameless = F.coalesce(F.col("name") == "", F.lit(True))
    counts = patch.groupBy(F.when(~blank, F.col("id")).alias("id")).agg(F.count("*").alias("n"), F.count_if(nameless).alias("nameless"))
    found = F.array(
        F.struct(F.when(F.col("id").isNull(), "missing id").when(F.col("n") > 1, "duplicate id").alias("issue"), F.col("n").alias("n")),
        F.struct(F.when(F.col("nameless") > 0, "missing name").alias("issue"), F.col("nameless").alias("n")),
    )
    return counts.select("id", F.explode(found).alias("f")).filter("f.issue IS NOT NULL").select("f.issue", "id", "f.n")
