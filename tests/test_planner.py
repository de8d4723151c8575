"""The planner over a small archive: every rule, the counts, and that a second application changes nothing."""

import pytest
from pyspark.sql import functions as F

from talewind.operators import names, patch, planner

EVENTS = "array<struct<grp: string, items: array<string>>>"


@pytest.fixture(scope="module")
def archive(spark):
    nodes = spark.createDataFrame(
        [("a_1", "Ann", ["A"], ["PC"], "Old note", [("A", ["met"])], "Zed"), ("a_2", "Bo", [], None, None, None, None)],
        f"id string, name string, groups array<string>, tags array<string>, note string, events {EVENTS}, played_by string",
    )
    aliases = spark.createDataFrame([("Zed", "Zed", 0), ("zz", "Zed", 1), ("q", "Quin", 2), ("Quinn", "Quin", 3)], "alias string, canonical string, ord int")
    return nodes, aliases


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def test_aliases(spark, archive):
    values = spark.createDataFrame([(v,) for v in (None, "", "  ", "zz", " Zed ", "by zz here", "q", "aqa", "Quinn (x)", " new ")], "v string")
    got = {r.v: (r.canon, r.changed) for r in names.normalized(values, "v", archive[1]).collect()}
    assert got == {
        None: (None, False), "": ("", False), "  ": ("  ", False), "zz": ("Zed", True), " Zed ": ("Zed", False), "by zz here": ("Zed", True),
        "q": ("Quin", True), "aqa": ("aqa", False), "Quinn (x)": ("Quin", True), " new ": ("new", False),
    }


def test_new_nodes_are_placed(spark, archive):
    stored, aliases = archive
    entries = spark.createDataFrame(
        [(0, "a_1", "Ann", None, None, None), (1, "a_3", "Cy", ["B"], "zz", False), (2, "a_3", "Cy", ["B"], "zz", None), (3, "b_4", "Di", None, "New", True), (4, "a_5", "", None, None, None), (5, "a_3", "Again", None, None, None), (6, " ", "Ed", None, None, None), (7, "a_7", " \u3000", None, None, None), (8, " a_1 ", "Ann", None, None, None), (9, " a_3", "Cy", None, None, None)],
        "idx int, id string, name string, groups array<string>, played_by string, confirmed boolean",
    )
    planned = patch.plan_nodes(entries, stored)
    assert rows(planned, "idx", "outcome") == [(0, "skipped"), (1, "pending"), (2, "new"), (3, "new"), (4, "skipped"), (5, "skipped"), (6, "skipped"), (7, "skipped"), (8, "skipped"), (9, "skipped")]
    got = planner.placed_nodes(planned, "A", "a_", aliases)
    assert rows(got, "id", "groups", "played_by", "normalized", "off_prefix") == [("a_3", ["B", "A"], "Zed", True, False), ("b_4", ["A"], "New", False, True)]


def test_updates_of_nodes(spark, archive):
    stored, aliases = archive
    kind = f"idx int, id string, confirmed boolean, add_groups array<string>, add_tags array<string>, add_note string, add_events {EVENTS}, set_name string, set_played_by string"
    entries = [
        (0, "a_1", None, ["A", "B"], ["PC", "X"], " more ", [("A", ["met", "left"]), ("C", ["new"])], "Anna", "zz"),
        (1, "a_1", True, ["A"], ["PC"], "note", [("A", ["met"])], "Ann", "Zed"),  # nothing new
        (2, "a_2", None, None, None, "First.", None, None, None),
        (3, "gone", None, ["A"], None, None, None, None, None),
        (4, "a_2", False, ["A"], None, None, None, None, None),
        (5, "a_2", None, None, None, None, [("G", ["x", "x"])], " ", " "),
    ]
    got = {r.idx: r for r in planner.node_updates(stored, spark.createDataFrame(entries, kind), aliases).collect()}
    assert {i: r.outcome for i, r in got.items()} == {0: "update", 1: "skipped", 2: "update", 3: "skipped", 4: "pending", 5: "update"}
    r = got[0]
    assert (r.new_groups, r.new_tags, r.new_note, r.new_name, r.new_played_by) == (["A", "B"], ["PC", "X"], "Old note。more", "Anna", None)
    assert [(e.grp, e["items"]) for e in r.new_events] == [("A", ["met", "left"]), ("C", ["new"])]
    assert (got[2].new_note, got[2].new_groups) == ("First.", None)
    assert [(e.grp, e["items"]) for e in got[5].new_events] == [("G", ["x"])]


def test_people_profiles_and_pending(spark):
    stored = spark.createDataFrame([("u1", [("A", "x")], "Note."), ("u2", None, None)], "uid string, roles array<struct<grp: string, role: string>>, note string")
    people = spark.createDataFrame([(0, "u1", None), (1, " ", None), (2, "u9", None), (3, "u9", True), (4, None, True), (5, "u8", False)], "idx int, uid string, confirmed boolean")
    planned = planner.plan_people(people, stored)
    assert rows(planned, "idx", "outcome") == [(0, "duplicate"), (1, "pending"), (2, "new"), (3, "duplicate"), (4, "pending"), (5, "pending")]
    updates = spark.createDataFrame([(0, "u1", [("A", "x"), ("B", "y"), ("B", "y")], "more"), (1, "u1", [("A", "x")], "Note"), (2, "no", None, "z"), (3, "u2", None, "z")], "idx int, uid string, add_roles array<struct<grp: string, role: string>>, add_note string")
    got = {r.idx: r for r in planner.people_updates(stored, updates).collect()}
    assert {i: r.outcome for i, r in got.items()} == {0: "update", 1: "skipped", 2: "skipped", 3: "update"}
    assert [tuple(x) for x in got[0].new_roles] == [("A", "x"), ("B", "y")]
    assert (got[0].new_note, got[3].new_note, got[3].new_roles) == ("Note.more", "z", None)
    profiles = spark.createDataFrame([("u1", ["c"], None, None, "calm", None)], "uid string, cards array<string>, groups_played array<string>, impressions array<string>, speaking_style string, rp_style string")
    more = spark.createDataFrame([(0, "u1", ["c", "d"], None, None, "calm", "bold"), (1, "u1", ["c"], None, None, "cal", " ")], "idx int, uid string, add_cards array<string>, add_groups_played array<string>, add_impressions array<string>, append_speaking_style string, append_rp_style string")
    got = {r.idx: r for r in planner.profile_updates(profiles, more).collect()}
    assert (got[0].outcome, got[0].new_cards, got[0].new_speaking_style, got[0].new_rp_style, got[1].outcome) == ("update", ["c", "d"], None, "bold", "skipped")
    explicit = spark.createDataFrame([(0, "ask", "why"), (1, None, None)], "idx int, item string, reason string")
    told = spark.createDataFrame([(0, "n1", "Nia", False, "who is she?", "part 3", "pending"), (1, "n2", "", False, "", None, "pending"), (2, "n3", "Di", True, None, None, "new")], "idx int, id string, name string, confirmed boolean, pending_reason string, segment string, outcome string")
    waiting = planner.pending_entries(explicit, people=planned.select("idx", "uid", "confirmed", "outcome"), nodes=told)
    assert rows(waiting, "kind", "idx", "item", "reason", "segment") == [
        ("explicit", 0, "ask", "why", ""), ("explicit", 1, "", "", ""), ("nodes", 0, "Nia", "who is she?", "part 3"), ("nodes", 1, "n2", "not confirmed", ""),
        ("people", 1, "", "no key", ""), ("people", 4, "", "no key", ""), ("people", 5, "u8", "not confirmed", ""),
    ]


def test_a_whole_plan_in_the_expected_numbers(spark, archive):
    """4 new nodes, 1 updated, 3 new edges, 5 pending of which 2 are not confirmed, 3 normalized; applied it is 5 nodes, 3 edges."""
    stored = archive[0].filter("id = 'a_1'")
    aliases = archive[1]
    nodes = spark.createDataFrame(
        [(0, "a_2", "B", None, "zz", None), (1, "a_3", "C", None, "by zz", None), (2, "a_4", "D", None, "q", None), (3, "a_5", "E", None, "New", None), (4, "a_6", "F", None, None, False)],
        "idx int, id string, name string, groups array<string>, played_by string, confirmed boolean",
    )
    edges = spark.createDataFrame(
        [(0, "a_1", "a_2", "t", None), (1, "a_2", "a_3", "t", None), (2, "a_3", "a_4", "t", None), (3, "a_1", "a_2", "t", None), (4, "a_1", "a_6", "t", None), (5, "a_4", "a_5", "t", False)],
        "idx int, src string, dst string, type string, confirmed boolean",
    )
    none = spark.createDataFrame([], "src string, dst string, type string")
    planned = patch.plan_nodes(nodes, stored)
    new_ids = planned.filter("outcome = 'new'").select("id").unionByName(stored.select("id"))
    planned_edges = patch.plan_edges(edges, none, new_ids)
    kind = f"idx int, id string, confirmed boolean, add_groups array<string>, add_tags array<string>, add_note string, add_events {EVENTS}, set_name string, set_played_by string"
    updated = planner.node_updates(stored, spark.createDataFrame([(0, "a_1", None, ["B"], None, None, None, None, None)], kind), aliases)
    people = planner.plan_people(spark.createDataFrame([(0, "", None)], "idx int, uid string, confirmed boolean"), spark.createDataFrame([], "uid string"))
    explicit = spark.createDataFrame([(0, "one", ""), (1, "two", "")], "idx int, item string, reason string")
    counts = {(r.kind, r.outcome): r.n for r in planner.outcome_counts(nodes=planned, updates=updated, edges=planned_edges, people=people).collect()}
    assert counts[("nodes", "new")] == 4
    assert counts[("updates", "update")] == 1
    assert counts[("edges", "new")] == 3
    pending = planner.pending_entries(explicit, nodes=planned.select("idx", "id", "confirmed", "outcome"), edges=planned_edges.select("idx", "src", "confirmed", "outcome"), people=people.select("idx", "uid", "confirmed", "outcome"))
    assert pending.count() == 5
    assert pending.filter("reason = 'not confirmed'").count() == 2
    placed = planner.placed_nodes(planned, "A", "a_", aliases)
    assert placed.filter("normalized").count() == 3
    after = {r.kind: (r.before, r.added, r.after, r.changes) for r in planner.counts_after({"nodes": stored, "edges": none}, {"nodes": planned, "edges": planned_edges}).collect()}
    assert after == {"nodes": (1, 4, 5, 4), "edges": (0, 3, 3, 3)}
    applied = patch.apply_plan(stored.select("id", "name"), planned)
    assert applied.count() == 5
    assert patch.plan_nodes(nodes, applied).filter("outcome = 'new'").count() == 0


def test_drafts_and_lint(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([(0, "a", "b", "t")], "idx int, src string, dst string, type string")
    draft = spark.createDataFrame([(0, "a", "b", "t"), (1, "b", "c", "t"), (2, "b", "c", "t"), (3, "c", "c", "t"), (4, "c", "x", "t"), (5, "b", "a", "t")], "idx int, src string, dst string, type string")
    assert rows(planner.merged_draft(edges, draft, ids), "idx", "src", "dst") == [(0, "a", "b"), (2, "b", "c"), (6, "b", "a")]
    nodes = spark.createDataFrame([(0, "a", "", ["x"], None, ""), (1, "a", "A", ["y", "x"], "n", "p"), (2, "", "z", None, None, None)], "idx int, id string, name string, aliases array<string>, note string, played_by string")
    named, kept, odd = planner.lint(nodes, draft, spark.createDataFrame([("a",), ("b",)], "id string"))
    assert rows(named, "id", "idx", "name", "note", "played_by", "aliases") == [("a", 0, "A", "n", "p", ["x", "y"])]
    assert kept.count() == 5
    assert rows(odd, "id") == [("a",)]


def test_groups_prefixes_and_labels(spark):
    files = spark.createDataFrame([("x.txt",), ("Alpha/one.txt",), ("zzz/the Beta part.txt",), ("old/y.txt",), ("12.Gamma (2)_b.txt",), ("special_1.txt",)], "path string")
    got = {r.path: tuple(r.g) for r in files.withColumn("g", names.group_of(F.col("path"), [("special*", "S")], ["Alpha", "Beta", "Beta part"], {"old": "New"})).collect()}
    assert got == {
        "x.txt": ("x", "name"), "Alpha/one.txt": ("Alpha", "known"), "zzz/the Beta part.txt": ("Beta part", "held"), "old/y.txt": ("New", "alias"),
        "12.Gamma (2)_b.txt": ("Gamma", "name"), "special_1.txt": ("S", "rule"),
    }
    row = spark.createDataFrame([("团", "Group One", "", "a/b?. ", "Ann（G）", "（G）")], "g string, h string, e string, f string, l string, m string").select(
        names.id_prefix(F.col("g"), {}).alias("a"), names.id_prefix(F.col("h"), {"Group One": "g1"}).alias("b"), names.id_prefix(F.col("h"), {}).alias("c"),
        names.id_prefix(F.col("h"), {}, F.lit("p")).alias("d"), names.file_tag(F.col("f")).alias("t"), names.file_tag(F.col("e")).alias("u"), names.speaker(F.col("l")).alias("s"), names.speaker(F.col("m")).alias("v"),
    ).first()
    import hashlib

    assert tuple(row) == ("t" + hashlib.sha1("团".encode()).hexdigest()[:4], "g1", "groupo", "p", "a_b_", "part", "Ann", "（G）")
