"""Registered queries of the planner, of names and of reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, names, patch, planner, reports
from ..sources.tables import EDGES_SQL, NODES_SQL, edges, nodes, table, tasks
from .changes import _NODE_PATCH, node_patch
from .text import query_into

Q, S = {}, {}
query = query_into(Q, S)

_GRAPH = f"WITH {NODES_SQL}, {EDGES_SQL}"
_PATCH = f"WITH {NODES_SQL}, {_NODE_PATCH}"

#: Players' names in the order of registration.
_PLAYERS = [("URGENT", "Ursula"), ("2-HIGH", "Hal"), ("H", "Short"), ("LOW", "Lou"), ("SPEC", "Spencer")]
_PLAYERS_SQL = "al(alias, canonical, ord) AS (VALUES " + ", ".join(f"('{a}', '{c}', {i})" for i, (a, c) in enumerate(_PLAYERS)) + ")"


def players(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, c, i) for i, (a, c) in enumerate(_PLAYERS)], "alias string, canonical string, ord int")


def _canon(value: str) -> str:
    """SQL of a value's canonical name: whole alias, else the first registered of two characters that it holds, else trimmed."""
    return f"""CASE WHEN trim({value}) = '' OR {value} IS NULL THEN {value} ELSE coalesce((SELECT canonical FROM al WHERE alias = trim({value})),
      (SELECT arg_min(canonical, ord) FROM al WHERE length(alias) >= 2 AND contains(trim({value}), alias)), trim({value})) END"""


@query(_PATCH + f""", {_PLAYERS_SQL}, w AS (SELECT n.idx, n.id, o_orderpriority AS prio, ' ' || o_orderpriority AS played FROM np_out n JOIN orders ON o_orderkey = n.idx WHERE outcome = 'new')
SELECT idx, id, CASE WHEN prio = '1-URGENT' THEN prio ELSE prio || '|1-URGENT' END AS groups, {_canon('played')} AS played_by, {_canon('played')} <> trim(played) AS normalized, NOT starts_with(id, 'P1') AS off_prefix FROM w""")
def patch_places(spark: SparkSession, d: str) -> DataFrame:
    more = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.array("o_orderpriority").alias("groups"), F.concat(F.lit(" "), "o_orderpriority").alias("played_by"))
    planned = patch.plan_nodes(node_patch(spark, d), nodes(spark, d)).join(more, "idx")
    placed = planner.placed_nodes(planned, "1-URGENT", "P1", players(spark))
    return placed.select("idx", "id", F.array_join("groups", "|").alias("groups"), "played_by", "normalized", "off_prefix")


@query(f"WITH {NODES_SQL}, {_PLAYERS_SQL}" + f""", u AS (
  SELECT o_orderkey AS idx, 'P' || o_custkey * 2 AS id, o_orderpriority NOT LIKE '2%' AS ok, CASE WHEN o_orderkey % 3 > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'PC' END END AS tag,
    CASE WHEN o_orderkey % 5 = 0 THEN 'ring' ELSE o_orderpriority END AS note, CASE WHEN o_orderstatus = 'F' THEN 'N' || o_custkey END AS new_name, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END AS played FROM orders
), j AS (SELECT u.*, n.id IS NOT NULL AS known, n.name, n.tag AS own, {_canon('played')} AS canon FROM u LEFT JOIN nodes n USING (id)),
c AS (SELECT *, CASE WHEN tag IS NOT NULL AND tag <> own THEN own || '|' || tag END AS tags_, CASE WHEN NOT contains(name, note) THEN name || '。' || note END AS note_,
  CASE WHEN new_name <> name THEN new_name END AS name_, CASE WHEN canon <> 'Lou' THEN canon END AS played_ FROM j)
SELECT idx, id, CASE WHEN NOT ok THEN 'pending' WHEN NOT known OR coalesce(tags_, note_, name_, played_) IS NULL THEN 'skipped' ELSE 'update' END AS outcome,
  CASE WHEN ok AND known THEN tags_ END AS new_tags, CASE WHEN ok AND known THEN note_ END AS new_note, CASE WHEN ok AND known THEN name_ END AS new_name, CASE WHEN ok AND known THEN played_ END AS new_played_by FROM c""")
def patch_node_updates(spark: SparkSession, d: str) -> DataFrame:
    events = "CAST(NULL AS array<struct<grp: string, items: array<string>>>)"
    stored = nodes(spark, d).select("id", "name", "groups", F.array("tag").alias("tags"), F.col("name").alias("note"), F.expr(events).alias("events"), F.lit("Lou").alias("played_by"))
    updates = table(spark, d, "orders").selectExpr(
        "o_orderkey AS idx", "concat('P', o_custkey * 2) AS id", "o_orderpriority NOT LIKE '2%' AS confirmed", "CAST(NULL AS array<string>) AS add_groups",
        "CASE WHEN o_orderkey % 3 > 0 THEN array(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'PC' END) END AS add_tags",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'ring' ELSE o_orderpriority END AS add_note", f"{events} AS add_events",
        "CASE WHEN o_orderstatus = 'F' THEN concat('N', o_custkey) END AS set_name", "CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END AS set_played_by",
    )
    found = planner.node_updates(stored, updates, players(spark), tasks(table(spark, d, "orders")))
    return found.select("idx", "id", "outcome", F.array_join("new_tags", "|").alias("new_tags"), "new_note", "new_name", "new_played_by")


_PEOPLE = """p AS (SELECT o_orderkey AS idx, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_custkey::VARCHAR END AS uid, o_orderpriority NOT LIKE '2%' AS ok FROM orders)
, o AS (SELECT idx, trim(uid) AS uid, CASE WHEN NOT ok OR trim(uid) = '' THEN 'pending' WHEN uid IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_custkey % 3 = 0) THEN 'duplicate' ELSE 'open' END AS o FROM p)
, people AS (SELECT idx, uid, CASE WHEN o <> 'open' THEN o WHEN row_number() OVER (PARTITION BY o, uid ORDER BY idx) = 1 THEN 'new' ELSE 'duplicate' END AS outcome FROM o)"""


def people_plan(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "orders").selectExpr("o_orderkey AS idx", "CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE CAST(o_custkey AS string) END AS uid", "o_orderpriority NOT LIKE '2%' AS confirmed")
    return planner.plan_people(entries, stored_people(spark, d))


def stored_people(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("uid"))


@query(f"WITH {_PEOPLE} SELECT * FROM people")
def patch_people(spark: SparkSession, d: str) -> DataFrame:
    return people_plan(spark, d).select("idx", "uid", "outcome")


@query("""WITH u AS (SELECT o_orderkey AS idx, o_custkey AS uid, o_orderpriority AS g, o_orderstatus AS r FROM orders), s AS (SELECT c_custkey AS uid, c_mktsegment AS note FROM customer WHERE c_custkey % 4 > 0)
, j AS (SELECT u.*, s.note FROM u LEFT JOIN s USING (uid))
SELECT idx, uid, CASE WHEN note IS NULL OR (r = 'F' AND g = '5-LOW' AND contains(note, r)) THEN 'skipped' ELSE 'update' END AS outcome,
  CASE WHEN note IS NOT NULL AND NOT (r = 'F' AND g = '5-LOW') THEN '5-LOW/F,' || g || '/' || r END AS new_roles, CASE WHEN note IS NOT NULL AND NOT contains(note, r) THEN note || '。' || r END AS new_note FROM j""")
def patch_people_updates(spark: SparkSession, d: str) -> DataFrame:
    role = lambda g, r: F.array(F.struct(g.alias("grp"), r.alias("role")))
    stored = table(spark, d, "customer").filter("c_custkey % 4 > 0").select(F.col("c_custkey").alias("uid"), role(F.lit("5-LOW"), F.lit("F")).alias("roles"), F.col("c_mktsegment").alias("note"))
    updates = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("uid"), role(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("add_roles"), F.col("o_orderstatus").alias("add_note"))
    found = planner.people_updates(stored, updates)
    return found.select("idx", "uid", "outcome", F.array_join(F.transform("new_roles", lambda r: F.concat_ws("/", r["grp"], r["role"])), ",").alias("new_roles"), "new_note")


@query("""WITH u AS (SELECT o_orderkey AS idx, o_custkey AS uid, o_orderpriority AS c, o_orderstatus AS t FROM orders), s AS (SELECT c_custkey AS uid, c_mktsegment AS style FROM customer WHERE c_custkey % 4 > 0)
, j AS (SELECT u.*, s.style FROM u LEFT JOIN s USING (uid))
SELECT idx, uid, CASE WHEN style IS NULL OR (c = '5-LOW' AND contains(style, t)) THEN 'skipped' ELSE 'update' END AS outcome,
  CASE WHEN style IS NOT NULL AND c <> '5-LOW' THEN '5-LOW,' || c END AS new_cards, CASE WHEN style IS NOT NULL AND NOT contains(style, t) THEN style || chr(10) || t END AS new_style FROM j""")
def patch_profile_updates(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "customer").filter("c_custkey % 4 > 0").select(F.col("c_custkey").alias("uid"), F.array(F.lit("5-LOW")).alias("cards"), F.col("c_mktsegment").alias("style"))
    updates = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("uid"), F.array("o_orderpriority").alias("add_cards"), F.col("o_orderstatus").alias("append_style"))
    found = planner.profile_updates(stored, updates, ("cards",), ("style",))
    return found.select("idx", "uid", "outcome", F.array_join("new_cards", ",").alias("new_cards"), "new_style")


@query(_PATCH + f""", {_PEOPLE} SELECT 'nodes' AS kind, (SELECT count(*) FROM nodes) AS before, count_if(outcome = 'new') AS added, (SELECT count(*) FROM nodes) + count_if(outcome = 'new') AS after, count_if(outcome = 'new') AS changes FROM np_out
UNION ALL SELECT 'people', (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0), count_if(outcome = 'new'), (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) + count_if(outcome = 'new'), count_if(outcome = 'new') FROM people""")
def patch_counts(spark: SparkSession, d: str) -> DataFrame:
    stored = {"nodes": nodes(spark, d), "people": stored_people(spark, d)}
    return planner.counts_after(stored, {"nodes": patch.plan_nodes(node_patch(spark, d), stored["nodes"]), "people": people_plan(spark, d)})


@query(_PATCH + f""", {_PEOPLE} SELECT 'nodes' AS kind, idx, coalesce(nullif(name, ''), id, '') AS item, CASE WHEN idx % 3 = 0 THEN 'ask ' || idx ELSE 'not confirmed' END AS reason, 's' || idx % 7 AS segment FROM np_out WHERE outcome = 'pending'
UNION ALL SELECT 'people', p.idx, p.uid, CASE WHEN ok THEN 'no key' ELSE 'not confirmed' END, '' FROM people p JOIN p AS e USING (idx) WHERE outcome = 'pending'
UNION ALL SELECT 'explicit', item_id, text, '', 'b' || item_id FROM benchmark""")
def patch_pending(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("item"), F.lit(None).cast("string").alias("reason"), F.concat(F.lit("b"), "item_id").alias("segment"))
    own = {"pending_reason": F.when(F.col("idx") % 3 == 0, F.concat(F.lit("ask "), "idx")), "segment": F.concat(F.lit("s"), F.col("idx") % 7)}
    planned = patch.plan_nodes(node_patch(spark, d), nodes(spark, d)).withColumns(own)
    waiting = planned.select("idx", "id", "name", "confirmed", "outcome", *own)
    return planner.pending_entries(listed, nodes=waiting, people=people_plan(spark, d).select("idx", "uid", "confirmed", "outcome"))


@query(_GRAPH + """, pa AS (SELECT event_ord AS idx, src, dst, type FROM edges WHERE strength = 3), dr AS (SELECT event_ord AS idx, src, dst, CASE WHEN event_ord % 2 = 0 THEN type ELSE 'R' END AS type FROM edges WHERE strength < 3),
k AS (SELECT id FROM nodes WHERE tag <> 'KP'), v AS (SELECT DISTINCT src, dst, type FROM dr WHERE src <> dst AND src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k))
SELECT src, dst, type FROM pa UNION ALL SELECT src, dst, type FROM v WHERE (src, dst, type) NOT IN (SELECT (src, dst, type) FROM pa)""")
def patch_draft(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    of = lambda some, kind: some.select(F.col("event_ord").alias("idx"), "src", "dst", kind.alias("type"))
    draft = of(e.filter("strength < 3"), F.when(F.col("event_ord") % 2 == 0, F.col("type")).otherwise("R"))
    return planner.merged_draft(of(e.filter("strength = 3"), F.col("type")), draft, nodes(spark, d).filter("tag <> 'KP'").select("id")).select("src", "dst", "type")


@query("""WITH f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name || '.txt' ELSE p_type || '/' || p_name || '.txt' END AS path, p_name AS stem, p_type AS ty FROM part)
, r AS (SELECT *, CASE WHEN id % 3 = 0 THEN stem ELSE ty END AS raw FROM f)
SELECT id, CASE WHEN starts_with(stem, 'small') THEN 'Small' WHEN raw IN ('PROMO', 'steel', 'steel r') THEN raw WHEN contains(raw || ' ' || stem, 'steel r') THEN 'steel r' WHEN contains(raw || ' ' || stem, 'PROMO') THEN 'PROMO'
  WHEN contains(raw || ' ' || stem, 'steel') THEN 'steel' WHEN raw = 'ECONOMY' THEN 'Eco' ELSE raw END AS grp FROM r""")
def group_chain(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(".txt"))).otherwise(F.concat("p_type", F.lit("/"), "p_name", F.lit(".txt")))
    grp = names.group_of(F.col("path"), [("small*", "Small")], ["PROMO", "steel", "steel r"], {"ECONOMY": "Eco"})
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), path.alias("path")).select("id", grp["grp"].alias("grp"))


@query(r"""SELECT DISTINCT p_type AS grp, CASE WHEN p_type = 'ECONOMY' THEN 'eco' ELSE left(lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')), 6) END AS prefix,
CASE WHEN p_brand = 'Brand#1' THEN 'asked' WHEN p_type = 'ECONOMY' THEN 'eco' ELSE left(lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')), 6) END = 'asked' AS asked,
trim(replace(replace(left(p_brand || '/' || p_type || ':*?', 12), '/', '_'), ':', '_')) AS tag FROM part""")
def name_forms(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("p_brand") == "Brand#1", "asked")
    prefix = names.id_prefix(F.col("p_type"), {"ECONOMY": "eco"})
    tag = names.file_tag(F.concat("p_brand", F.lit("/"), "p_type", F.lit(":*?")), 12)
    told = F.coalesce(asked, prefix) == "asked"
    return table(spark, d, "part").select(F.col("p_type").alias("grp"), prefix.alias("prefix"), told.alias("asked"), tag.alias("tag")).distinct()


@query(f"WITH {NODES_SQL}" + """, m AS (SELECT *, [brand, 'KP', ptype] AS gs FROM nodes) SELECT id, brand = 'Brand#11' AS detail,
CASE WHEN brand = 'Brand#11' THEN id || ' ' || name || '（' || tag || '）' || ' | ' || brand || '、KP、' || ptype ELSE name END AS line FROM m""")
def canon_block(spark: SparkSession, d: str) -> DataFrame:
    people = nodes(spark, d).select("id", "name", F.array("tag").alias("aliases"), F.array(F.col("groups")[0], F.lit("KP"), F.col("groups")[1]).alias("groups"))
    return names.canon_block(people, "Brand#11").select("id", "detail", "line")


@query(f"WITH {NODES_SQL}" + """, t AS (SELECT unnest(['P42', 'small ring', 'ring', 'BOSS', 'Brand#1', 'none']) AS term)
, h AS (SELECT term, id, CASE WHEN id = term THEN 1 WHEN name = term THEN 2 WHEN contains(name, term) THEN 3 WHEN contains(tag, term) OR contains(brand, term) THEN 4 END AS tier FROM nodes, t)
SELECT term, tier, id FROM h WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY term)""")
def resolve_terms(spark: SparkSession, d: str) -> DataFrame:
    people = nodes(spark, d).select("id", "name", F.array("tag", F.col("groups")[0]).alias("aliases"))
    return names.resolved(people, ["P42", "small ring", "ring", "BOSS", "Brand#1", "none"])


@query("""SELECT 'status' AS measure, CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' ELSE 'new' END AS value, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 2
UNION ALL SELECT 'kind', lang, count(*) FROM documents GROUP BY lang UNION ALL SELECT 'groups', NULL, count(DISTINCT source) FROM documents""")
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").otherwise("new")
    docs = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return reports.manifest_counts(docs.select(status.alias("status"), F.col("lang").alias("kind"), F.col("source").alias("grp")))


@query("SELECT CASE WHEN source IS NULL OR lang = 'en' THEN '(none)' ELSE source END AS grp, count(*) AS n FROM documents GROUP BY 1")
def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    groups = F.when(F.col("lang") == "en", F.array(F.lit("PC"), F.lit(""))).otherwise(F.array("source"))
    return reports.group_sizes(table(spark, d, "documents").select(groups.alias("groups")))


@query("""SELECT grp, count_if(p = 'd') AS docs, count_if(p = 'l') AS labelled, count_if(p = 't') AS toxic FROM (SELECT source AS grp, 'd' AS p FROM documents
UNION ALL SELECT source, 'l' FROM documents JOIN labels USING (doc_id) UNION ALL SELECT source, 't' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) GROUP BY grp""")
def housekeeping_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("grp"))
    labelled = docs.join(table(spark, d, "labels"), "doc_id")
    return reports.housekeeping(docs=docs, labelled=labelled, toxic=labelled.filter("toxic = 1"))


@query("SELECT conv_id % 10 AS file, role AS who, count(*) AS lines, sum(length(text))::BIGINT AS tokens, sum(turn * 0.5)::DOUBLE AS seconds FROM conversations GROUP BY ROLLUP (conv_id % 10, role)")
def speaker_totals(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "conversations").select((F.col("conv_id") % 10).alias("file"), F.col("role").alias("who"), "text", "turn")
    return reports.totals(lines, "file", "who", F.length("text"), F.col("turn") * F.lit(0.5))


@query("""SELECT count(*) AS n, count(DISTINCT p_type) AS types, count(DISTINCT p_type) FILTER (p_type LIKE '%O%') AS compound_types, count_if(p_type LIKE '%O%') AS compound_edges,
count_if(contains(p_name, 'ring')) AS anchored, count_if(contains(p_name, 'ring')) * 100 // count(*) AS anchored_percent FROM part""")
def type_shares(spark: SparkSession, d: str) -> DataFrame:
    return reports.type_profile(table(spark, d, "part").select(F.col("p_type").alias("type"), F.col("p_name").alias("text")), "text", "O", "ring")


@query("""WITH s AS (SELECT p_brand AS type, left(trim(p_name), 6) AS cut, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_size % 3 > 0)
SELECT p_brand AS type, count(*) AS n, (SELECT string_agg(cut, '|' ORDER BY k) FROM s WHERE s.type = p_brand AND k <= 3) AS samples FROM part GROUP BY p_brand""")
def type_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_brand").alias("type"), F.when(F.col("p_size") % 3 > 0, F.col("p_name")).otherwise(" ").alias("text"), "p_partkey")
    return reports.type_samples(rows, "text", ["p_partkey"], most=6).select("type", "n", F.array_join("samples", "|").alias("samples"))


@query(f"WITH {NODES_SQL}" + """, v AS (SELECT 'group' AS perspective, unnest(groups) AS value FROM nodes UNION ALL SELECT 'played_by', CASE WHEN price > 1000 THEN tag ELSE '(none)' END FROM nodes UNION ALL SELECT 'kind', lower(tag) FROM nodes)
, c AS (SELECT perspective, value, count(*) AS n FROM v GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY perspective ORDER BY n DESC, value) AS place FROM c""")
def perspectives(spark: SparkSession, d: str) -> DataFrame:
    people = nodes(spark, d).select("groups", F.when(F.col("price") > 1000, F.col("tag")).otherwise("").alias("played_by"), graph.kind(F.col("tag")).alias("kind"))
    return reports.perspectives(people)


@query(_GRAPH + """, s AS (SELECT src AS id, dst AS other, type, strength FROM edges WHERE src <> dst UNION ALL SELECT dst, src, type, strength FROM edges WHERE src <> dst)
, g AS (SELECT id AS other, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY strength DESC, degree DESC, other, type) AS place, other, type, strength, degree FROM s JOIN g USING (other)""")
def neighbour_list(spark: SparkSession, d: str) -> DataFrame:
    return reports.neighbour_list(edges(spark, d))


@query("""WITH g AS (SELECT p_partkey AS id, p_partkey * 2 AS slot FROM part WHERE p_partkey % 3 = 0)
SELECT id, slot FROM g UNION ALL SELECT p_partkey, (SELECT max(slot) FROM g) + row_number() OVER (ORDER BY p_name, p_partkey) FROM part WHERE p_partkey % 3 > 0""")
def stable_slots(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return reports.slots(p, p.filter("id % 3 = 0").select("id", (F.col("id") * 2).alias("slot")), 5)


@query(f"WITH {NODES_SQL}" + " SELECT id, name FROM nodes WHERE id NOT IN ('P1', 'P2') AND tag <> 'KP' AND (contains(brand, '#1') OR contains(ptype, '#1'))")
def visible_nodes(spark: SparkSession, d: str) -> DataFrame:
    people = nodes(spark, d).withColumn("in_graph", F.when(F.col("tag") == "KP", False))
    return reports.visible(people, ["P1", "P2"], "#1").select("id", "name")


@query(_GRAPH + """, k AS (SELECT id FROM nodes WHERE tag <> 'KP'), e AS (SELECT * FROM edges WHERE type <> 'A')
SELECT src, dst, type FROM e WHERE src <> dst AND src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def confirmed_scope(spark: SparkSession, d: str) -> DataFrame:
    people = nodes(spark, d).withColumn("confirmed", F.when(F.col("tag") == "KP", False))
    links = edges(spark, d).withColumn("confirmed", F.when(F.col("type") == "A", False))
    return reports.in_scope(people, links)[1].select("src", "dst", "type")


@query("SELECT event_id FROM events WHERE value BETWEEN 5 AND 40 AND value + 2 BETWEEN 5 AND 40")
def time_slice(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("value").alias("s"), (F.col("value") + 2).alias("e"))
    return reports.time_slice(e, "s", "e", 5, 40).select("event_id")


@query(f"WITH {NODES_SQL}" + " SELECT id, name FROM nodes WHERE id IN ('P3', 'P5') OR brand = 'Brand#7' OR name = 'small ring'")
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    """By id, by group, or by name."""
    return nodes(spark, d).filter(F.col("id").isin("P3", "P5") | F.array_contains("groups", "Brand#7") | (F.col("name") == "small ring")).select("id", "name")
