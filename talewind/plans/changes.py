"""Registered queries over change sets, revisions and manifests, with their SQL.

The stored archive is the entity graph; the change set is made of orders (an entry for each), the log of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, patch
from ..sources.tables import EDGES_SQL, NODES_SQL, edges, nodes, table
from .text import query_into

Q, S = {}, {}
query = query_into(Q, S)

_NODE_PATCH = """np_raw AS (
  SELECT o_orderkey AS idx, CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN '  ' END WHEN o_orderkey % 5 = 0 THEN ' P' || (o_custkey * 17) || ' ' ELSE 'P' || (o_custkey * 17) END AS id,
         CASE WHEN o_totalprice < 5000 THEN '' WHEN o_orderkey % 11 = 0 THEN '   ' ELSE 'N' || o_custkey || ' ' END AS name,
         CASE WHEN o_orderpriority LIKE '1%' THEN false WHEN o_orderpriority LIKE '2%' THEN true END AS confirmed FROM orders
), np AS (SELECT idx, trim(id) AS id, trim(name) AS name, confirmed FROM np_raw
), planned AS (
  SELECT *, CASE WHEN NOT coalesce(confirmed, true) THEN 'pending' WHEN coalesce(id, '') = '' OR name = '' THEN 'skipped'
                 WHEN id IN (SELECT id FROM nodes) THEN 'skipped' ELSE 'open' END AS o FROM np
), np_out AS (
  SELECT idx, id, name, CASE WHEN o <> 'open' THEN o WHEN row_number() OVER (PARTITION BY o, id ORDER BY idx) = 1 THEN 'new' ELSE 'skipped' END AS outcome FROM planned)"""


def node_patch(spark: SparkSession, d: str) -> DataFrame:
    key, priority = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    own = F.concat(F.lit("P"), F.col("o_custkey") * 17)
    named = F.when(key % 5 == 0, F.concat(F.lit(" "), own, F.lit(" "))).otherwise(own)
    return table(spark, d, "orders").select(
        key.alias("idx"),
        F.when(F.col("o_orderstatus") != "P", named).when(key % 2 == 0, "  ").alias("id"),
        F.when(F.col("o_totalprice") < 5000, "").when(key % 11 == 0, "   ").otherwise(F.concat(F.lit("N"), "o_custkey", F.lit(" "))).alias("name"),
        F.when(priority == "1", False).when(priority == "2", True).alias("confirmed"),
    )


@query(f"WITH {NODES_SQL}, {_NODE_PATCH} SELECT * FROM np_out")
def patch_plan_nodes(spark: SparkSession, d: str) -> DataFrame:
    return patch.plan_nodes(node_patch(spark, d), nodes(spark, d)).select("idx", "id", "name", "outcome")


@query(f"WITH {NODES_SQL}, {_NODE_PATCH} SELECT id, name FROM nodes UNION ALL SELECT id, name FROM np_out WHERE outcome = 'new'")
def patch_apply(spark: SparkSession, d: str) -> DataFrame:
    stored = nodes(spark, d)
    return patch.apply_plan(stored.select("id", "name"), patch.plan_nodes(node_patch(spark, d), stored))


@query(f"WITH {NODES_SQL}, {EDGES_SQL}" + """, ep AS (
  SELECT l_orderkey * 1000000 + l_suppkey * 100 + l_linenumber AS idx, 'P' || nxt AS src, 'P' || l_partkey AS dst, l_returnflag AS type,
         CASE WHEN l_discount > 0.09 THEN false END AS confirmed FROM lines WHERE nxt IS NOT NULL
), k AS (SELECT id FROM nodes WHERE tag <> 'KP'), o AS (
  SELECT *, CASE WHEN NOT coalesce(confirmed, true) THEN 'pending' WHEN src NOT IN (SELECT id FROM k) OR dst NOT IN (SELECT id FROM k) THEN 'skipped'
                 WHEN EXISTS (SELECT 1 FROM edges e WHERE e.src = ep.src AND e.dst = ep.dst AND e.type = ep.type) THEN 'duplicate' ELSE 'open' END AS o FROM ep
), r AS (SELECT *, CASE WHEN o <> 'open' THEN o WHEN row_number() OVER (PARTITION BY o, src, dst, type ORDER BY idx) = 1 THEN 'new' ELSE 'duplicate' END AS outcome FROM o)
SELECT outcome, type, count(*) AS n, min(idx) AS first_idx FROM r GROUP BY ALL""")
def patch_plan_edges(spark: SparkSession, d: str) -> DataFrame:
    """A draft that holds every relation the other way round, planned against those stored."""
    entries = (
        edge_lines(spark, d)
        .filter("next IS NOT NULL")
        .select(
            (F.col("l_orderkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("idx"),
            F.concat(F.lit("P"), "next").alias("src"),
            F.concat(F.lit("P"), "l_partkey").alias("dst"),
            F.col("l_returnflag").alias("type"),
            F.when(F.col("l_discount") > 0.09, False).alias("confirmed"),
        )
    )
    planned = patch.plan_edges(entries, edges(spark, d), nodes(spark, d).filter("tag <> 'KP'").select("id"))
    return planned.groupBy("outcome", "type").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


def edge_lines(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    line = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").withColumn("next", F.lead("l_partkey").over(line))


@query(f"WITH {NODES_SQL}" + """, u AS (SELECT o_orderkey AS idx, 'P' || o_custkey AS id, o_orderpriority AS g, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority || '.' ELSE o_orderstatus END AS note FROM orders)
, ops AS (SELECT id, list(g ORDER BY idx) AS gs, list(note ORDER BY idx) AS ns FROM u GROUP BY id), j AS (SELECT n.id, n.groups, n.name, gs, ns FROM nodes n LEFT JOIN ops USING (id))
SELECT id, CASE WHEN gs IS NULL THEN name ELSE list_reduce(list_prepend(name, ns), lambda a, x: CASE WHEN contains(a, x) THEN a WHEN right(a, 1) IN ('。', '！', '？', '.') THEN a || x ELSE a || '。' || x END) END AS note,
  len(groups) + coalesce(len(list_filter(list_distinct(gs), lambda x: NOT list_contains(groups, x))), 0) AS n_groups FROM j""")
def patch_updates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    note = F.when(F.col("o_orderstatus") == "O", F.concat("o_orderpriority", F.lit("."))).otherwise(F.col("o_orderstatus"))
    updates = o.select(F.col("o_orderkey").alias("idx"), F.concat(F.lit("P"), "o_custkey").alias("id"), F.array("o_orderpriority").alias("add_groups"), note.alias("add_note"))
    new = patch.apply_updates(nodes(spark, d).select("id", "groups", F.col("name").alias("note")), updates)
    return new.select("id", "note", F.size("groups").cast("long").alias("n_groups"))


_REVISIONS = "WITH r AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events), v AS (SELECT * FROM r WHERE b IS NULL OR b <> event_type)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return history.revisions(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query(_REVISIONS + " SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM v GROUP BY user_id")
def history_latest(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(_log(spark, d), "user_id", "event_id", "event_type")


@query(_REVISIONS + " SELECT user_id, event_id, event_type FROM v WHERE event_id > (SELECT max(event_id) - 2000 FROM v)")
def history_retention(spark: SparkSession, d: str) -> DataFrame:
    return history.retained(_log(spark, d), "event_id", 2000)


@query("""SELECT n.user_id, t.body AS event_type FROM (SELECT user_id, arg_max(event_type, event_id) AS body FROM events GROUP BY user_id) n
JOIN (SELECT user_id, arg_max(event_type, event_id) AS body FROM events WHERE event_id <= 500 GROUP BY user_id) t USING (user_id) WHERE n.body <> t.body""")
def history_rollback(spark: SparkSession, d: str) -> DataFrame:
    return history.rollback(table(spark, d, "events"), "user_id", "event_id", "event_type", 500)


@query("""SELECT doc_id AS path, sha256(coalesce(text, '')) AS hash,
CASE WHEN l.doc_id IS NULL THEN 'new' WHEN toxic = 1 AND coalesce(text, '') <> '' THEN 'changed' ELSE 'unchanged' END AS status, coalesce(quality, 9) AS first_seen
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    """What was labelled was seen before, a toxic text in another form."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    current = docs.select(F.col("doc_id").alias("path"), sha(F.col("text")).alias("hash"), F.lit(9).alias("seen"))
    labelled = docs.join(table(spark, d, "labels"), "doc_id")
    old = F.when(F.col("toxic") == 1, F.lit("")).otherwise(F.col("text"))
    return history.manifest_diff(current, labelled.select(F.col("doc_id").alias("path"), sha(old).alias("hash"), F.col("quality").alias("first_seen")))


@query(f"WITH {NODES_SQL}" + """, ops AS (SELECT event_id AS seq, 'P' || user_id AS id, event_type AS et, value FROM events)
, last AS (SELECT id, max(seq) FILTER (WHERE et = 'error') AS gone, max(seq) FILTER (WHERE et = 'purchase') AS made_last FROM ops GROUP BY id)
, base AS (SELECT id, -1 AS seq FROM nodes UNION ALL SELECT id, seq FROM ops WHERE et = 'purchase')
, made AS (SELECT b.id, min(b.seq) AS made FROM base b LEFT JOIN last l USING (id) WHERE b.seq > coalesce(l.gone, -2) GROUP BY b.id)
, sets AS (SELECT id, seq, et AS dim, CASE WHEN value >= 1 THEN value::INT::VARCHAR END AS value FROM ops WHERE et NOT IN ('error', 'purchase') UNION ALL SELECT id, -1, 'tag', tag FROM nodes)
, vals AS (SELECT s.id, dim, arg_max_null(value, seq) AS value FROM sets s JOIN made m ON m.id = s.id AND s.seq >= m.made GROUP BY ALL)
SELECT m.id, coalesce(string_agg(dim || '=' || value, ',' ORDER BY dim) FILTER (WHERE value IS NOT NULL), '') AS attrs FROM made m LEFT JOIN vals USING (id) GROUP BY m.id""")
def overlay_replay(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "create").otherwise("set")
    value = F.when((F.col("value") >= 1) & (kind == "set"), F.bround("value").cast("int").cast("string"))
    ops = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("P"), "user_id").alias("id"), kind.alias("op"), F.col("event_type").alias("dim"), value.alias("value"))
    new = history.replay(nodes(spark, d).select("id", F.create_map(F.lit("tag"), "tag").alias("attrs")), ops)
    pairs = F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return new.select("id", F.array_join(pairs, ",").alias("attrs"))
