"""JSON entries: replies, schemas and cleaning against plain models; logs of nodes and relations against a fold."""

import json
import random

import pytest
from pyspark.sql import functions as F

from talewind.operators import documents as doc
from talewind.operators import history


def test_replies(spark):
    said = {
        '{"a": 1}': {"a": 1}, '```json\n{"a": [1]}\n``` done': {"a": [1]}, "```\n[1, 2]": [1, 2], 'Here it is: {"b": {"c": 2}} as asked': {"b": {"c": 2}},
        "so [1, {\"x\": 2}] it is": {"x": 2}, "list [3] only": [3], "nothing": None, "": None, "{broken": None, " \n 7 ": 7, '```JSON {"k": "```"}': None,
    }
    rows = spark.createDataFrame([(t,) for t in said] + [(None,)], "t string").select("t", F.to_json(doc.json_reply(F.col("t"))).alias("j")).collect()
    assert {r.t: None if r.j is None else json.loads(r.j) for r in rows} == said | {None: None}


def test_schema_issues(spark):
    entries = [
        '{"id": "a", "name": "Ann", "groups": ["g"], "other": 1, "events": [{"group": "g", "items": []}], "in_graph": null}',
        '{"id": "", "name": 5, "note": null, "tags": ["x", 3], "events": [{"group": "g"}, 4]}',
        '{"id": "a", "name": "Again", "groups": "g", "in_graph": "yes"}', "[1]", "not json", None,
    ]
    frame = spark.createDataFrame(list(enumerate(entries)), "idx int, doc string")
    got = {(r.idx, r.place, r.level, r.issue) for r in doc.validated(frame, doc.RULES["characters"], "id").collect()}
    assert got == {
        (1, "/id", "error", "has less than 1 characters"), (1, "/name", "error", "is number, not string"), (1, "/", "error", "lacks groups"), (1, "/tags/1", "error", "is number, not string"),
        (1, "/events/0", "error", "lacks items"), (1, "/events/1", "error", "is number, not object"), (2, "/groups", "error", "is string, not array"),
        (2, "/in_graph", "error", "is string, not boolean or null"), (2, "/id", "error", "an earlier entry has a"), (3, "/", "error", "is array, not object"),
        (4, "/", "error", "no JSON"), (5, "/", "error", "no JSON"),
    }
    links = ['{"from": "a", "to": "b", "type": "t", "strength": "强", "event": ""}', '{"from": "a", "to": "b", "type": "t", "strength": "huge", "event": ""}', '{"from": "a", "to": "b", "type": "t", "event": ""}']
    got = {(r.idx, r.place, r.level) for r in doc.validated(spark.createDataFrame(list(enumerate(links)), "idx int, doc string"), doc.RULES["relations"]).collect()}
    assert got == {(1, "/strength", "warn"), (2, "/strength", "warn"), (2, "/", "error")}
    assert doc.validated(frame.limit(0), doc.RULES["players"], "uid").count() == 0


def test_cleaning(spark):
    dims = {f"d{i:02}": "v" for i in range(38)} | {" z ": None, "a" * 40: ["  x ", 3, "", "y" * 200], "late": "cut off", "num": 4}
    full = {"id": " n ", "name": "N" * 100, "note": 7, "evil": "drop", "aliases": ["a ", "", 3, "b" * 90], "tags": "no list", "groups": [], "attrs": dims}
    texts = [json.dumps(full), "[]", "broken", None, '{"attrs": 3, "played_by": "  "}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, d string").withColumn("c", doc.cleaned(F.col("d"), doc.KEPT["node"])).orderBy("i").collect()
    c = rows[0].c
    assert (c.id, c.name, c.note, c.aliases, c.tags, c.groups) == ("n", "N" * 80, None, ["a", "b" * 80], None, [])
    assert set(c.attrs) == {*[f"d{i:02}" for i in range(38)], "z", "a" * 30}
    assert (c.attrs["d00"], c.attrs["z"], c.attrs["a" * 30]) == (["v"], None, ["x", "y" * 120])
    assert rows[1].c is rows[2].c is rows[3].c is None
    assert rows[4].c.attrs is None and rows[4].c.played_by is None
    pair = spark.createDataFrame([({"a": ["1"], "b": ["2"]}, {"b": None, "c": ["3"], "a": ["9"]}), (None, {"x": ["1"]}), ({"k": ["v"]}, None)], "old map<string, array<string>>, new map<string, array<string>>")
    assert [r[0] for r in pair.select(doc.with_dimensions(F.col("old"), F.col("new"))).collect()] == [{"a": ["9"], "c": ["3"]}, {"x": ["1"]}, {"k": ["v"]}]


def folded(nodes, edges, log):
    """The log, one operation after another."""
    nodes, edges = {k: dict(v) for k, v in nodes.items()}, {k: list(v) for k, v in edges.items()}
    for r in sorted(log, key=lambda r: r[0]):
        _, kind, op, id_, dim, value, src, dst, type_, new_type, strength = r
        if kind == "node":
            if op == "create":
                nodes.setdefault(id_, {})
            elif op == "delete" and id_ in nodes:
                del nodes[id_]
                edges = {k: v for k, v in edges.items() if id_ not in k[:2]}
            elif op == "set" and id_ in nodes:
                nodes[id_][dim] = value
        elif op == "create" and src in nodes and dst in nodes:
            edges.setdefault((src, dst, type_), [type_, strength])
        elif op == "update" and (src, dst, type_) in edges:
            old = edges[src, dst, type_]
            edges[src, dst, type_] = [new_type or old[0], strength or old[1]]
        elif op == "delete":
            edges.pop((src, dst, type_), None)
    rows = sorted((k[0], k[1], *v) for k, v in edges.items())
    degree = {i: sum((a == i) + (b == i) for a, b, *_ in rows) for i in nodes}
    return {i: ({d: v for d, v in attrs.items() if v is not None}, degree[i]) for i, attrs in nodes.items()}, rows


@pytest.mark.parametrize("seed", [1, 2])
def test_one_log_of_nodes_and_relations(spark, seed):
    draw = random.Random(seed)
    ids = "abcdefg"
    nodes = {i: {"x": "0"} for i in "abcd"}
    edges = {("a", "b", "t"): ["t", 1], ("b", "c", "t"): ["t", 2], ("c", "c", "u"): ["u", 3]}
    log = []
    for seq in range(160):
        if draw.random() < 0.4:
            log.append((seq, "node", draw.choice(["create", "create", "set", "set", "delete"]), draw.choice(ids), draw.choice("xy"), draw.choice([None, "1", "2"]), None, None, None, None, None))
        else:
            op = draw.choice(["create", "create", "update", "delete"])
            log.append((seq, "edge", op, None, None, None, draw.choice(ids), draw.choice(ids), draw.choice("tu"), draw.choice([None, "n"]) if op == "update" else None, draw.choice([None, 5, 6])))
    kind = "seq long, kind string, op string, id string, dim string, value string, src string, dst string, type string, new_type string, strength int"
    draw.shuffle(log)
    people = spark.createDataFrame(list(nodes.items()), "id string, attrs map<string, string>")
    links = spark.createDataFrame([(a, b, t, s) for (a, b, t), (_, s) in edges.items()], "src string, dst string, type string, strength int")
    left, relations = history.replay_log(people, links, spark.createDataFrame(log, kind))
    expected = folded(nodes, edges, log)
    assert {r.id: (r.attrs, r.degree) for r in left.collect()} == expected[0]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in relations.collect()), key=key) == sorted(expected[1], key=key)
