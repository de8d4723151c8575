"""The change-set planner: every entry of a patch gets an outcome, with what it would change; nothing is written here.

Outcomes: ``new``, ``update``, ``pending`` (not confirmed, or a key is missing that nobody may make up), ``skipped`` (missing,
unknown or without effect), ``duplicate``. :func:`outcome_counts` sums the plan up, :func:`counts_after` says what the stored
tables would hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import dealt
from .names import normalized
from .patch import _decided, appended, plan_edges

_NONE = "CAST(array() AS array<string>)"


def _strings(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.expr(_NONE))


def united(old: Column, more: Column) -> Column:
    """The old array and what the other has besides, in order; nulls are empty arrays."""
    old = _strings(old)
    return F.concat(old, F.array_distinct(F.array_except(_strings(more), old)))


def placed_nodes(planned: DataFrame, grp: str, prefix: str, aliases: DataFrame) -> DataFrame:
    """New nodes of a plan (``planned``: id, groups, played_by, outcome) as they are stored: the patch's group is among their
    groups, played_by is the canonical name (normalized tells whether that changed it), off_prefix marks other ids."""
    new = planned.filter("outcome = 'new'")
    named = normalized(new, "played_by", aliases)
    groups = F.when(F.array_contains(_strings("groups"), grp), _strings("groups")).otherwise(F.array_append(_strings("groups"), F.lit(grp)))
    return named.withColumns({"groups": groups, "played_by": F.col("canon"), "normalized": F.col("changed"), "off_prefix": ~F.startswith("id", F.lit(prefix))}).drop("canon", "changed")


def merged_events(old: Column, more: Column) -> Column:
    """Arrays of (grp, items), ``more`` merged into ``old`` by group: items are united, unknown groups follow."""
    items = lambda events, g: F.flatten(F.transform(F.filter(events, lambda e: e["grp"].eqNullSafe(g)), lambda e: _strings(e["items"])))
    kind = "CAST(array() AS array<struct<grp: string, items: array<string>>>)"
    old, more = F.coalesce(old, F.expr(kind)), F.coalesce(more, F.expr(kind))
    grown = F.transform(old, lambda e: F.struct(e["grp"].alias("grp"), united(e["items"], items(more, e["grp"])).alias("items")))
    names = F.array_distinct(F.transform(more, lambda e: e["grp"]))
    fresh = F.filter(names, lambda g: ~F.exists(old, lambda e: e["grp"].eqNullSafe(g)))
    return F.concat(grown, F.transform(fresh, lambda g: F.struct(g.alias("grp"), F.array_distinct(items(more, g)).alias("items"))))


def node_updates(stored: DataFrame, updates: DataFrame, aliases: DataFrame, tasks: int | None = None) -> DataFrame:
    """idx, id, outcome and the wanted values (null: no change) of ``updates`` (idx, id, confirmed, add_groups, add_tags,
    add_note, add_events, set_name, set_played_by) against ``stored`` (id, name, groups, tags, note, events, played_by).

    Each update is held against what is stored, as a plan is made before anything is written. Events count as a change only
    where they do change. ``tasks``: to how many updates and what is stored are dealt where they meet.
    """
    named = normalized(updates, "set_played_by", aliases, tasks).drop("changed")
    held = dealt(stored.select("id", F.struct("name", "groups", "tags", "note", "events", "played_by").alias("old")), tasks, "id")
    rows = named.join(held, "id", "left")
    differs = lambda new, old: F.when(~new.eqNullSafe(old), new)
    old_note = F.coalesce("old.note", F.lit(""))
    events = merged_events(F.col("old.events"), F.col("add_events"))
    wanted = {
        "groups": differs(united(F.col("old.groups"), F.col("add_groups")), _strings("old.groups")),
        "tags": differs(united(F.col("old.tags"), F.col("add_tags")), _strings("old.tags")),
        "note": differs(appended(F.rtrim(old_note), F.trim("add_note")), F.rtrim(old_note)),
        "events": F.when(F.size(_or_empty("add_events")) > 0, differs(events, F.coalesce("old.events", F.expr("CAST(array() AS array<struct<grp: string, items: array<string>>>)")))),
        "name": differs(F.nullif(F.trim("set_name"), F.lit("")), F.col("old.name")),
        "played_by": differs(F.nullif("canon", F.lit("")), F.col("old.played_by")),
    }
    found = rows.withColumns({f"new_{k}": v for k, v in wanted.items()})
    changed = F.coalesce(*[F.when(F.col(f"new_{k}").isNotNull(), True) for k in wanted], F.lit(False))
    outcome = F.when(~F.coalesce("confirmed", F.lit(True)), "pending").when(F.col("old").isNull() | ~changed, "skipped").otherwise("update")
    return found.withColumn("outcome", outcome).select("idx", "id", "outcome", *[F.when(F.col("outcome") == "update", F.col(f"new_{k}")).alias(f"new_{k}") for k in wanted])


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.expr("CAST(array() AS array<struct<grp: string, items: array<string>>>)"))


def plan_people(patch: DataFrame, stored: DataFrame) -> DataFrame:
    """``patch`` (idx, uid, confirmed) with outcome, against the ``stored`` uids: a blank uid waits, it can't be made up."""
    known = stored.select("uid", F.lit(True).alias("known")).distinct()
    rows = patch.withColumn("uid", F.trim("uid")).join(known, "uid", "left")
    problem = F.when(~F.coalesce("confirmed", F.lit(True)), "pending").when(F.coalesce(F.col("uid") == "", F.lit(True)), "pending")
    return _decided(rows, ["uid"], problem, F.coalesce("known", F.lit(False))).drop("known")


def people_updates(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """idx, uid, outcome, new_roles, new_note of ``updates`` (idx, uid, add_roles, add_note) against ``stored`` (uid, roles, note);
    roles are arrays of (grp, role), each pair once."""
    none = F.expr("CAST(array() AS array<struct<grp: string, role: string>>)")
    rows = updates.join(stored.select("uid", F.struct("roles", "note").alias("old")), "uid", "left")
    old, note = F.coalesce("old.roles", none), F.rtrim(F.coalesce("old.note", F.lit("")))
    more = F.array_distinct(F.array_except(F.coalesce("add_roles", none), old))
    found = rows.withColumns({"new_roles": F.when(F.size(more) > 0, F.concat(old, more)), "new_note": F.when(appended(note, F.trim("add_note")) != note, appended(note, F.trim("add_note")))})
    outcome = F.when(F.col("old").isNull() | (F.col("new_roles").isNull() & F.col("new_note").isNull()), "skipped").otherwise("update")
    return found.withColumn("outcome", outcome).select("idx", "uid", "outcome", *[F.when(F.col("outcome") == "update", F.col(c)).alias(c) for c in ("new_roles", "new_note")])


def profile_updates(stored: DataFrame, updates: DataFrame, lists: tuple[str, ...] = ("cards", "groups_played", "impressions"), texts: tuple[str, ...] = ("speaking_style", "rp_style")) -> DataFrame:
    """idx, uid, outcome and the new values of ``updates`` (idx, uid, add_<list>, append_<text>) against ``stored``: lists are
    united, texts appended on a line of their own unless they hold them already."""
    rows = updates.join(stored.select("uid", F.struct(*lists, *texts).alias("old")), "uid", "left")
    wanted = {}
    for c in lists:
        new = united(F.col(f"old.{c}"), F.col(f"add_{c}"))
        wanted[c] = F.when(new != _strings(f"old.{c}"), new)
    for c in texts:
        old, more = F.rtrim(F.coalesce(f"old.{c}", F.lit(""))), F.col(f"append_{c}")
        wanted[c] = F.when((F.trim(more) != "") & ~F.contains(old, F.trim(more)), F.when(old == "", more).otherwise(F.concat(old, F.lit("\n"), more)))
    found = rows.withColumns({f"new_{c}": v for c, v in wanted.items()})
    changed = F.coalesce(*[F.when(F.col(f"new_{c}").isNotNull(), True) for c in wanted], F.lit(False))
    outcome = F.when(F.col("old").isNull() | ~changed, "skipped").otherwise("update")
    return found.withColumn("outcome", outcome).select("idx", "uid", "outcome", *[F.when(F.col("outcome") == "update", F.col(f"new_{c}")).alias(f"new_{c}") for c in wanted])


def pending_entries(explicit: DataFrame, **planned: DataFrame) -> DataFrame:
    """kind, idx, item, reason, segment: the plan's pending entries and those that the patch itself lists (``explicit``: idx,
    item, reason, segment).

    ``planned`` are frames with idx, outcome, a key in their second column, and where they have them confirmed, name,
    pending_reason and segment. An entry's item is its name, else its key, with why it waits: its own reason, else that it isn't
    confirmed or has no key. Missing texts are empty.
    """
    text = lambda frame, c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in frame.columns else F.lit("")
    every = explicit.select(F.lit("explicit").alias("kind"), F.col("idx").cast("long").alias("idx"), *[text(explicit, c).alias(c) for c in ("item", "reason", "segment")])
    for kind, p in planned.items():
        key = next(c for c in p.columns if c not in ("idx", "outcome"))
        confirmed = F.coalesce("confirmed", F.lit(True)) if "confirmed" in p.columns else F.lit(False)
        own = F.nullif(text(p, "pending_reason"), F.lit(""))
        reason = F.coalesce(own, F.when(confirmed, "no key").otherwise("not confirmed"))
        item = F.coalesce(F.nullif(text(p, "name"), F.lit("")), text(p, key))
        waiting = p.filter("outcome = 'pending'").select(F.lit(kind).alias("kind"), F.col("idx").cast("long").alias("idx"), item.alias("item"), reason.alias("reason"), text(p, "segment").alias("segment"))
        every = every.unionByName(waiting)
    return every


def outcome_counts(**planned: DataFrame) -> DataFrame:
    """kind, outcome, n of a plan's parts."""
    every = None
    for kind, p in planned.items():
        part = p.groupBy("outcome").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "outcome", "n")
        every = part if every is None else every.unionByName(part)
    return every


def counts_after(stored: dict[str, DataFrame], planned: dict[str, DataFrame]) -> DataFrame:
    """kind, before, added, after, changes of each stored table; ``changes`` also counts updates, so a plan that only updates
    isn't empty."""
    every = None
    for kind, table in stored.items():
        before = table.agg(F.count("*").alias("before"))
        parts = planned[kind].agg(F.count_if(F.col("outcome") == "new").alias("added"), F.count_if(F.col("outcome").isin("new", "update")).alias("changes"))
        row = before.crossJoin(parts).select(F.lit(kind).alias("kind"), "before", "added", (F.col("before") + F.col("added")).alias("after"), "changes")  # one row with one row
        every = row if every is None else every.unionByName(row)
    return every


def merged_draft(patch: DataFrame, draft: DataFrame, ids: DataFrame) -> DataFrame:
    """The relations of ``patch`` and those of a ``draft`` (idx, src, dst, type) that may join them: both ends known, no loop, the
    triple new; the draft's follow behind the patch's in their order."""
    last = patch.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("last"))  # one row
    planned = plan_edges(draft.filter("src <> dst").withColumn("confirmed", F.lit(True)), patch, ids)
    more = planned.filter("outcome = 'new'").join(F.broadcast(last)).withColumn("idx", F.col("idx") + F.col("last") + 1)
    return patch.select("idx", "src", "dst", "type").unionByName(more.select("idx", "src", "dst", "type"))


def lint(nodes: DataFrame, edges: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A patch's nodes with one row for each id (the first name, note and player that aren't blank, aliases united in order),
    its edges without loops, and the updates that target the patch's own new ids."""
    first = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("idx"))).alias(c)
    aliases = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", _strings("aliases").alias("a")))), lambda x: x["a"]))).alias("aliases")
    named = nodes.filter("id <> ''").groupBy("id").agg(F.min("idx").alias("idx"), first("name"), first("note"), first("played_by"), aliases)
    return named, edges.filter("src <> dst"), updates.join(named.select("id"), "id", "left_semi")
