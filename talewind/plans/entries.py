"""Registered queries over entries that come as JSON text, and over one log of nodes and relations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, history
from ..sources.tables import EDGES_SQL, NODES_SQL, edges, nodes, table, tasks
from .text import query_into

Q, S = {}, {}
query = query_into(Q, S)

#: Entries that one task parses: a stored file may be a single group of rows, which Spark reads in one task.
ENTRIES = 50_000

# entries made of parts, some of them broken in a known way
_DOC = """CASE WHEN p_partkey % 17 = 0 THEN '{"id": ' || p_name WHEN p_partkey % 19 = 0 THEN '[' || p_size || ']' ELSE
  '{"id": "' || CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN 'P' || (p_partkey - 7) ELSE 'P' || p_partkey END || '"'
  || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ', "name": ' || CASE WHEN p_partkey % 3 = 0 THEN '' || p_size ELSE '"' || p_name || '"' END END
  || ', "groups": ' || CASE WHEN p_partkey % 13 = 0 THEN '"' || p_brand || '"' ELSE '["' || p_brand || '", ' || CASE WHEN p_partkey % 2 = 0 THEN '"' || p_type || '"' ELSE 'null' END || ']' END || '}' END"""


@query(f"""WITH e AS (SELECT p_partkey AS idx, {_DOC} AS doc FROM part), o AS (SELECT idx, idx % 17 = 0 AS bad, idx % 19 = 0 AND idx % 17 > 0 AS arr FROM e), s AS (SELECT idx FROM o WHERE NOT bad AND NOT arr)
, k AS (SELECT idx, json_extract_string(doc, '$.id') AS key FROM e JOIN s USING (idx))
SELECT idx, '/' AS place, 'error' AS level, CASE WHEN bad THEN 'no JSON' ELSE 'is array, not object' END AS issue FROM o WHERE bad OR arr
UNION ALL SELECT idx, '/id', 'error', 'has less than 1 characters' FROM s WHERE idx % 11 = 0
UNION ALL SELECT idx, '/', 'error', 'lacks name' FROM s WHERE idx % 5 = 0 UNION ALL SELECT idx, '/name', 'error', 'is number, not string' FROM s WHERE idx % 5 > 0 AND idx % 3 = 0
UNION ALL SELECT idx, '/groups', 'error', 'is string, not array' FROM s WHERE idx % 13 = 0 UNION ALL SELECT idx, '/groups/1', 'error', 'is null, not string' FROM s WHERE idx % 13 > 0 AND idx % 2 = 1
UNION ALL SELECT idx, '/id', 'error', 'an earlier entry has ' || key FROM (SELECT *, min(idx) OVER (PARTITION BY key) AS first FROM k) WHERE idx > first""")
def schema_issues(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.expr(_DOC).alias("doc"))
    return documents.validated(entries, documents.RULES["characters"], "id")


@query(f"""WITH e AS (SELECT p_partkey AS idx, {_DOC} AS doc FROM part), s AS (SELECT idx, doc FROM e WHERE idx % 17 > 0 AND idx % 19 > 0), b AS (SELECT s.idx, p_brand, p_type, p_name, doc FROM s JOIN part ON p_partkey = idx)
SELECT idx, nullif(json_extract_string(doc, '$.id'), '') AS id, CASE WHEN idx % 5 > 0 AND idx % 3 > 0 THEN p_name END AS name,
  CASE WHEN idx % 13 > 0 THEN p_brand || CASE WHEN idx % 2 = 0 THEN '|' || p_type ELSE '' END END AS groups FROM b""")
def cleaned_entries(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "part")
    parts = stored.select("p_partkey", "p_name", "p_brand", "p_type", "p_size").repartition(tasks(stored, ENTRIES), "p_partkey")
    entries = parts.select(F.col("p_partkey").alias("idx"), F.expr(_DOC).alias("doc"))
    return documents.cleaned_rows(entries, documents.KEPT["node"]).select("idx", "id", "name", F.array_join("groups", "|").alias("groups"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Sure! ' || props || ' Anything else?' WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN props ELSE 'no idea, ' || event_type END AS reply, props FROM events)
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM r""")
def reply_values(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 4
    reply = (
        F.when(m == 0, F.concat(F.lit("Sure! "), "props", F.lit(" Anything else?"))).when(m == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(m == 2, F.col("props")).otherwise(F.concat(F.lit("no idea, "), "event_type"))
    )
    return table(spark, d, "events").select("event_id", F.try_variant_get(documents.json_reply(reply), "$.k", "long").alias("k"))


_LOG = f"""WITH {NODES_SQL}, {EDGES_SQL}, num AS (SELECT id, tag, substr(id, 2)::INT AS k FROM nodes)
, nl AS (SELECT id, -1 AS seq, 'create' AS op, NULL::VARCHAR AS value FROM num UNION ALL SELECT id, -1, 'set', tag FROM num
  UNION ALL SELECT id, 4000 + k * 10 + 3, 'delete', NULL FROM num WHERE k % 9 = 0 UNION ALL SELECT id, 12000 + k * 10 + 3, 'create', NULL FROM num WHERE k % 18 = 0 UNION ALL SELECT id, k * 20 + 4, 'set', 'S' || k FROM num WHERE k % 6 = 0)
, gone AS (SELECT id, coalesce(max(seq) FILTER (op = 'delete'), -2) AS gone FROM nl GROUP BY id), av AS (SELECT nl.* FROM nl JOIN gone USING (id) WHERE seq > gone)
, lives AS (SELECT id, min(seq) AS made FROM av WHERE op = 'create' GROUP BY id), vals AS (SELECT id, arg_max(value, seq) AS value FROM av JOIN lives USING (id) WHERE op = 'set' AND seq >= made GROUP BY id)
, el AS (SELECT -1 AS seq, 'create' AS op, src, dst, type, NULL::VARCHAR AS nt, strength AS st FROM edges
  UNION ALL SELECT event_ord * 10, CASE event_ord % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'create' ELSE 'update' END, src, dst, type, CASE WHEN event_ord % 5 IN (2, 3) THEN 'U' END, CASE WHEN event_ord % 5 IN (3, 4) THEN 3 END FROM edges WHERE event_ord % 4 > 0
  UNION ALL SELECT event_ord * 10 + 5, 'create', src, dst, type, NULL, 2 FROM edges WHERE event_ord % 3 = 0)
, ok AS (SELECT el.* FROM el JOIN lives a ON a.id = src JOIN lives b ON b.id = dst WHERE seq >= greatest(a.made, b.made))
, g AS (SELECT *, max(seq) FILTER (op = 'delete') OVER (PARTITION BY src, dst, type) AS gone FROM ok), a1 AS (SELECT * FROM g WHERE seq > coalesce(gone, -2))
, m AS (SELECT *, min(seq) FILTER (op = 'create') OVER (PARTITION BY src, dst, type) AS made FROM a1), v AS (SELECT * FROM m WHERE seq >= made AND (op <> 'create' OR seq = made))
, left_ AS (SELECT src, dst, coalesce(arg_max(nt, seq) FILTER (nt IS NOT NULL), type) AS type, arg_max(st, seq) FILTER (st IS NOT NULL) AS strength FROM v GROUP BY src, dst, v.type)"""


def _replayed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    people, links = nodes(spark, d).withColumn("k", F.substring("id", 2, 20).cast("long")), edges(spark, d)
    none = lambda kind: F.lit(None).cast(kind)
    node = lambda some, seq, op, value: some.select(
        seq.cast("long").alias("seq"), F.lit("node").alias("kind"), F.lit(op).alias("op"), "id", F.lit("tag").alias("dim"), value.alias("value"),
        *[none("string").alias(c) for c in ("src", "dst", "type", "new_type")], none("int").alias("strength"),
    )
    k, at, of = F.col("k"), F.col("event_ord"), F.col("event_ord") % 5
    edge = lambda seq, op, new_type, strength: F.struct(seq.cast("long").alias("seq"), op.alias("op"), new_type.alias("new_type"), strength.cast("int").alias("strength"))
    ops = F.array(  # of a relation all at once, so the relations are built once for the log
        F.when(at % 4 > 0, edge(at * 10, F.when(of == 0, "delete").when(of == 1, "create").otherwise("update"), F.when(of.isin(2, 3), "U"), F.when(of.isin(3, 4), 3))),
        F.when(at % 3 == 0, edge(at * 10 + 5, F.lit("create"), none("string"), F.lit(2))),
    )
    log = (
        node(people.filter(k % 9 == 0), 4000 + k * 10 + 3, "delete", none("string"))
        .unionByName(node(people.filter(k % 18 == 0), 12000 + k * 10 + 3, "create", none("string")))
        .unionByName(node(people.filter(k % 6 == 0), k * 20 + 4, "set", F.concat(F.lit("S"), k)))
        .unionByName(
            links.select("src", "dst", "type", F.explode(F.array_compact(ops)).alias("o"))
            .select(F.col("o.seq").alias("seq"), F.lit("edge").alias("kind"), "o.op", *[none("string").alias(c) for c in ("id", "dim", "value")], "src", "dst", "type", "o.new_type", "o.strength")
        )
    )
    return history.replay_log(people.select("id", F.create_map(F.lit("tag"), "tag").alias("attrs")), links, log)


@query(_LOG + """, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM left_ UNION ALL SELECT dst FROM left_) GROUP BY id)
SELECT id, value AS tag, coalesce(degree, 0) AS degree FROM lives LEFT JOIN vals USING (id) LEFT JOIN deg USING (id)""")
def overlay_log_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d)[0].select("id", F.try_element_at("attrs", F.lit("tag")).alias("tag"), "degree")


@query(_LOG + " SELECT src, dst, type, strength FROM left_")
def overlay_log_relations(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d)[1]
