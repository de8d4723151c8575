"""Cases that a reviewer found: odd values and sizes that the small tables don't have."""

import datetime
import os
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from oracle import DATA, assert_same
from pyspark.sql import functions as F

from talewind.operators import contacts, documents, graph, history, names, records, search
from talewind.plans import catalog, entries
from talewind.sources import tables

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
DAY = datetime.datetime(2020, 1, 1)

_PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
_ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def written(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        pq.write_table(spark.createDataFrame(rows, schema).toArrow(), path / f"{name}.parquet")
    return str(path)


def test_reviews_show_trimmed_ids_and_names(spark, tmp_path):
    orders = [(5, 1, "O", 9000.0, DAY, "1-URGENT"), (10, 2, "O", 9000.0, DAY, "1-URGENT"), (11, 3, "O", 9000.0, DAY, "1-URGENT"), (2, 3, "P", 1.0, DAY, "1-URGENT")]
    path = written(spark, tmp_path, part=([(17, "a", "b", "c", 1, 1.0)], _PART), orders=(orders, _ORDERS), events=([(5, DAY, 7, "view", 1.0, "{}")], _EVENTS))
    rows = {r.idx: (r.id, r.name) for r in QUERIES["review_decisions"](spark, path).collect()}
    assert rows == {5: ("R7", "N1"), 10: ("P34", "N2"), 11: ("P51", ""), 2: ("", "")}
    assert_same(QUERIES["review_decisions"](spark, path), SQL["review_decisions"], path)


def test_replayed_halves_are_rounded_to_even(spark, tmp_path):
    events = [(i, DAY, 1, kind, value, "{}") for i, (kind, value) in enumerate([("click", 2.5), ("view", 3.5), ("signup", 2.51), ("refund", 0.99), ("other", 1.5)])]
    path = written(spark, tmp_path, part=([(1, "a", "b", "c", 1, 1.0)], _PART), events=(events, _EVENTS))
    assert QUERIES["overlay_replay"](spark, path).first().attrs == "click=2,other=2,signup=3,tag=NPC,view=4"
    assert_same(QUERIES["overlay_replay"](spark, path), SQL["overlay_replay"], path)


def test_passages_are_found_by_one_reading(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "two three"), (3, None), (4, ""), (1, "one two three four"), (5, "x\none  two")], "doc_id int, body string")
    passages = spark.createDataFrame([(1, "two three"), (2, "e t"), (3, ""), (4, None), (5, "two three"), (6, "one  two")], "item_id int, passage string")
    want = sorted((d.doc_id, p.item_id) for d in docs.collect() for p in passages.collect() if d.body is not None and p.passage is not None and p.passage in d.body)
    for most in (1 << 20, 20):
        found = search.holding(docs, "body", passages, "passage", most)
        assert found.columns == ["doc_id", "body", "item_id", "passage"]
        assert sorted((r.doc_id, r.item_id) for r in found.collect()) == want


def test_nearest_over_odd_vectors_and_several_chunks(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [round(rng.random(), 1) for _ in range(64)], 0) for i in range(0, 300)]
    rows += [(300, None, 0), (350, [None] * 64, 0), (400, [float("nan")] * 64, 0), (450, [float("inf")] * 64, 0), (500, rows[50][1], 0), (501, rows[50][1], 0), (550, [None, *rows[7][1][1:]], 0), (600, rows[9][1][:9], 0)]
    path = written(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    assert_same(QUERIES["nearest_pick"](spark, path), SQL["nearest_pick"], path)
    v = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding")
    assert_same(search.nearest(v.filter("vec_id % 50 = 0"), v, 64, 4, 50), SQL["nearest_pick"], path)


def test_relations_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 7000)
    links = tables.edges(spark, DATA)
    assert links.rdd.getNumPartitions() == -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 7000)
    assert_same(QUERIES["edge_delete"](spark, DATA), SQL["edge_delete"])


def test_common_contacts_of_any_pairs(spark):
    """Hubs, loops, pairs that are no relations, turned and repeated pairs, against a plain search."""
    rng = random.Random(5)
    links = {(f"N{min(rng.randrange(40), rng.randrange(40))}", f"N{rng.randrange(40)}") for _ in range(260)}
    given = [(f"N{rng.randrange(42)}", f"N{rng.randrange(42)}") for _ in range(300)]
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {(min(p), max(p)): len(near.get(p[0], set()) & near.get(p[1], set())) for p in given if p[0] != p[1]}
    found = graph.common_contacts(spark.createDataFrame(sorted(links), "src string, dst string"), spark.createDataFrame(given, "a string, b string"))
    assert {(r.a, r.b): r.common for r in found.collect()} == {p: n for p, n in want.items() if n}


def test_a_log_with_relations_deleted_and_made_again(spark):
    """Against a plain fold; no relation is checkpointed on the way."""
    rng = random.Random(8)
    ids = [f"N{i}" for i in range(6)]
    nodes = spark.createDataFrame([(i, {"tag": "x"}) for i in ids], "id string, attrs map<string,string>")
    stored = sorted({(rng.choice(ids), rng.choice(ids), rng.choice("RS")) for _ in range(12)})
    alive, links, log = set(ids), {k: (k[2], 1) for k in stored}, []
    for seq in range(400):
        if rng.random() < 0.08:
            i, op = rng.choice(ids), rng.choice(["create", "delete"])
            log.append((seq, "node", op, i, None, None, None, None, None, None, None))
            alive = alive | {i} if op == "create" else alive - {i}
            links = {k: v for k, v in links.items() if k[0] in alive and k[1] in alive}
            continue
        k, op = (rng.choice(ids), rng.choice(ids), rng.choice("RS")), rng.choice(["create", "update", "update", "delete"])
        new, strength = rng.choice([None, "T"]) if op == "update" else None, rng.choice([None, 2, 3]) if op == "update" else 2
        log.append((seq, "edge", op, None, None, None, *k, new, strength))
        if op == "delete":
            links.pop(k, None)
        elif op == "create" and k not in links and k[0] in alive and k[1] in alive:
            links[k] = (k[2], 2)
        elif op == "update" and k in links:
            links[k] = (new or links[k][0], strength or links[k][1])
    frame = spark.createDataFrame(log, "seq long, kind string, op string, id string, dim string, value string, src string, dst string, type string, new_type string, strength int")
    people, left = history.replay_log(nodes, spark.createDataFrame([(*k, 1) for k in stored], "src string, dst string, type string, strength int"), frame)
    assert sorted(map(tuple, left.collect())) == sorted((k[0], k[1], *v) for k, v in links.items())
    assert {r.id: r.degree for r in people.collect()} == {i: sum((k[0] == i) + (k[1] == i) for k in links) for i in alive}
    assert left._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # built by one plan, not read from a checkpoint


def test_entries_are_parsed_once_and_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(entries, "ENTRIES", 300)
    found = QUERIES["cleaned_entries"](spark, DATA)
    assert found.rdd.getNumPartitions() == -(-spark.read.parquet(f"{DATA}/part.parquet").count() // 300)
    assert 0 < str(found._jdf.queryExecution().optimizedPlan()).count("parseJson") <= 2  # the filter and the value
    assert_same(found, SQL["cleaned_entries"])


def test_rows_of_cleaned_entries_are_its_structs(spark):
    texts = ['{"id": " n ", "name": 5, "groups": ["a", " ", null, " b"], "attrs": {"x": "1", "y": null, "z": [" "], "x ": ["2"]}}', "[]", "no", None, "{}", '{"attrs": [], "note": null}']
    docs = spark.createDataFrame(list(enumerate(texts)), "idx int, doc string")
    structs = docs.select("idx", documents.cleaned(F.col("doc"), documents.KEPT["node"]).alias("c")).filter("c IS NOT NULL").select("idx", "c.*")
    rows = documents.cleaned_rows(docs, documents.KEPT["node"]).orderBy("idx").collect()
    assert rows == structs.orderBy("idx").collect()
    assert [r.idx for r in rows] == [0, 4, 5]
    assert (rows[0].id, rows[0].name, rows[0].groups, rows[0].attrs) == ("n", None, ["a", "b"], {"y": None, "x": ["2"]})


def test_rows_without_a_name_or_of_a_frequent_one_are_spread(spark, monkeypatch):
    monkeypatch.setattr(names, "HOT", 100)
    given = [None] * 700 + [" "] * 20 + ["Frequent"] * 200 + [" the Frequent"] * 120 + ["unknown"] * 150 + ["Rare", "a Rare one", "none"]
    values = spark.createDataFrame(list(enumerate(given)), "i int, v string")
    aliases = spark.createDataFrame([("Frequent", "F", 0), ("Rare", "R", 1)], "alias string, canonical string, ord int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    try:
        found = names.normalized(values, "v", aliases, 8)
        sizes, rows = found.rdd.glom().map(len).collect(), found.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert len(sizes) == 8 and max(sizes) < 250
    means = {None: (None, False), " ": (" ", False), "Frequent": ("F", True), " the Frequent": ("F", True), "unknown": ("unknown", False), "Rare": ("R", True), "a Rare one": ("R", True), "none": ("none", False)}
    assert sorted((r.i, r.v, r.canon, r.changed) for r in rows) == [(i, v, *means[v]) for i, v in enumerate(given)]


def _shuffles(frame):
    """The shuffles of a plan that is not yet run: (their numbers of partitions, and of those that Spark chose itself)."""
    found = re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\), (\w+)", frame._jdf.queryExecution().executedPlan().toString())
    return [int(n) for n, _ in found], [int(n) for n, why in found if why == "ENSURE_REQUIREMENTS"]


@pytest.mark.parametrize("name", ["rel_density", "pair_dedupe_first", "pair_dedupe_strongest", "edge_delete", "cross_group_profile", "ego_level_edges"])
def test_what_follows_the_relations_is_dealt_by_their_number(spark, monkeypatch, name):
    """Only counts by group and by type, which are combined before, and the few roots go to as many tasks as the session says."""
    monkeypatch.setattr(tables, "TASK_ROWS", 7000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        every, own = _shuffles(QUERIES[name](spark, DATA))
        assert sum(n == 4 for n in every) <= {"rel_density": 1, "cross_group_profile": 1, "ego_level_edges": 4}.get(name, 0)
        assert max(own, default=9) == 9 or name == "ego_level_edges"
        assert_same(QUERIES[name](spark, DATA), SQL[name])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_relations_are_deleted_and_paired_in_any_number_of_tasks(spark):
    rng = random.Random(9)
    links = sorted({(f"N{rng.randrange(9)}", f"N{rng.randrange(9)}", rng.choice("RST")) for _ in range(150)})
    edges = spark.createDataFrame([(*k, rng.randrange(1, 4), i) for i, k in enumerate(links)], "src string, dst string, type string, strength int, event_ord int")
    deletes = spark.createDataFrame([("N1", "N2", None), ("N2", "N1", "R"), ("N3", "N3", "S"), ("N8", "N9", None)], "src string, dst string, type string")
    gone = {("N1", "N2", t) for t in "RST"} | {("N2", "N1", "R"), ("N3", "N3", "S")}
    groups = {f"N{i}": [f"g{i % 2}", f"h{i % 3}", f"g{i % 2}"] if i else None for i in range(9)}
    people = spark.createDataFrame(list(groups.items()), "id string, groups array<string>")
    for n in (None, 3, 7):
        assert sorted(r[:3] for r in records.delete_edges(edges, deletes, n).collect()) == sorted(set(links) - gone)
        first = {}
        for src, dst, *_ in links:
            first.setdefault((min(src, dst), max(src, dst)), (src, dst))
        assert sorted(r[:2] for r in graph.pair_first(edges, tasks=n).select("src", "dst").collect()) == sorted(first.values())
        inner = {}
        for src, dst, _ in links:
            for g in [a for a in groups[src] or [] for b in groups[dst] or [] if a == b]:
                inner.setdefault(g, []).append((src, dst))
        counts = {r.grp: r.n_edges for r in graph.density(people, edges, n).collect()}
        assert counts == {g: len(x) for g, x in inner.items()} | {g: 0 for g in counts if g not in inner}


def test_patterns_are_counted_by_one_reading_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_TEXTS", 300)
    found = QUERIES["text_lint"](spark, DATA)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    n = -(-spark.read.parquet(f"{DATA}/documents.parquet").count() // 300)
    assert "Join" not in plan and "Window" not in plan and plan.count("parquet") == 1
    assert n > 1 and re.search(rf"RepartitionByExpression \[doc_id#\w+\], {n}\b", plan)
    assert_same(found, SQL["text_lint"])


_LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"


def test_types_are_listed_with_missing_values(spark, tmp_path):
    """A type, an end and an order that are null: each type has its row, a relation without an end is counted but not shown."""
    rng = random.Random(1)
    lines = [(o, rng.randrange(9), 1, i, 50.0, rng.choice(["A", "R", None])) for o in range(12) for i in range(4)]
    lines += [(20, None, 1, 1, 50.0, "B"), (20, 5, 1, 2, 50.0, "B"), *[(None, i, 1, i, 50.0, "C") for i in range(5)], (7, 3, 1, 8, 1.0, "C"), (7, 4, 1, 9, 1.0, "C")]
    path = written(spark, tmp_path, lineitem=(lines, _LINE), part=([(1, "a", "b", "c", 1, 1.0)], _PART))
    rows = {r.type: (r.n, r.samples) for r in QUERIES["type_catalogue"](spark, path).collect()}
    assert set(rows) == {"A", "B", "C", "R", None} and rows["B"] == (1, None) and rows["C"][1].startswith("P3-P4 ")
    assert_same(QUERIES["type_catalogue"](spark, path), SQL["type_catalogue"], path)


def test_types_are_listed_from_three_relations_of_each_task(spark, monkeypatch):
    """Lines and relations are dealt by their number, and what one task of them hands on is no more than three of a type."""
    monkeypatch.setattr(tables, "TASK_ROWS", 7000)
    found = QUERIES["type_catalogue"](spark, DATA)
    plan = found._jdf.queryExecution().executedPlan().toString()
    n = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 7000)
    assert n > 4 and re.findall(r"Exchange hashpartitioning\(l_.*?, (\d+)\), REPARTITION_BY_NUM", plan) == [str(n)] * 4
    assert len(re.findall(r"Exchange hashpartitioning\(type#.*\n.*WindowGroupLimit .*, row_number\(\), 3, Partial", plan)) == 1
    assert_same(found, SQL["type_catalogue"])


def _shuffled(spark, run):
    """Bytes that the jobs of ``run`` write to shuffles."""
    context = spark.sparkContext
    context.setJobGroup("shuffled", "shuffled")
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    track, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in track.getJobIdsForGroup("shuffled") for s in track.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


def test_common_contacts_shuffle_less_than_twice_the_lines(spark, monkeypatch):
    """What is asked of a node's neighbours is sent as differences of numbers, and nothing is sent twice."""
    monkeypatch.setattr(tables, "TASK_ROWS", 15000)
    found = []
    sent = _shuffled(spark, lambda: found.extend(QUERIES["common_contacts"](spark, DATA).collect()))
    assert found and 0 < sent < 2 * os.path.getsize(f"{DATA}/lineitem.parquet")
    assert_same(QUERIES["common_contacts"](spark, DATA), SQL["common_contacts"])


def test_common_contacts_of_odd_lines(spark, tmp_path, monkeypatch):
    """Missing, negative and very large numbers, lines of one number, a part that most lines have."""
    monkeypatch.setattr(tables, "TASK_ROWS", 300)
    monkeypatch.setattr(contacts, "LISTED", 20)
    rng = random.Random(2)
    parts = [None, -3, 0, 2**63 - 1, -(2**63), 2**62, *range(1, 40)]
    lines = [(rng.choice([None, *range(200)]), 7 if rng.random() < 0.3 else rng.choice(parts), 1, rng.choice([None, 1, 2, 3, 4]), 1.0, "A") for _ in range(900)]
    path = written(spark, tmp_path, lineitem=(lines, _LINE), part=([(1, "a", "b", "c", 1, 1.0)], _PART))
    assert_same(QUERIES["common_contacts"](spark, path), SQL["common_contacts"], path)


def test_common_contacts_in_any_order_of_nodes_and_number_of_tasks(spark):
    rng = random.Random(4)
    near, links = {}, [(rng.randrange(50), 3 if i % 5 == 0 else rng.randrange(50), rng.choice([1, 1, 2, 3])) for i in range(700)]
    for a, b, f in links:
        if a != b and f & contacts.RELATION:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    pairs = {(min(a, b), max(a, b)) for a, b, f in links if a != b and f & contacts.ASKED}
    want = {p: n for p in pairs if (n := len(near.get(p[0], set()) & near.get(p[1], set())))}
    frame = spark.createDataFrame(links, "a long, b long, f long").filter("a <> b")
    for order, tasks, most in (([], 1, 1 << 20), ([3], 3, 7), ([9, 4, 3], 4, 1), (list(range(49, -1, -1)), 2, 50)):
        rows = contacts.common(frame, np.array(order, dtype=np.int64), tasks, most=most).collect()
        assert {(min(r.x, r.y), max(r.x, r.y)): r.common for r in rows} == want and len(rows) == len(want)
