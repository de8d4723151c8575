"""Registered queries of search, evidence, segments and the graph's edits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, history, names, search, segments
from ..sources.tables import EDGES_SQL, NODES_SQL, dealt_texts, edge_tasks, edges, nodes, table
from .text import _LINES, lines, query_into

Q, S = {}, {}
query = query_into(Q, S)

_GRAPH = f"WITH {NODES_SQL}, {EDGES_SQL}"
_SIDES = _GRAPH + ", st AS (SELECT DISTINCT src AS id, dst AS other FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)"


@query(_GRAPH + """, i AS (SELECT 'node' AS kind, id AS key, name, name || chr(10) || brand || ' ' || ptype AS hay FROM nodes
  UNION ALL SELECT DISTINCT 'tag', 'tag=' || tag, 'tag: ' || tag, 'tag ' || tag FROM nodes UNION ALL SELECT DISTINCT 'group', g, g, g FROM (SELECT unnest(groups) AS g FROM nodes)
  UNION ALL SELECT 'edge', src || '|' || dst || '|' || type, a.name || ' ' || type || ' ' || b.name, a.name || ' ' || b.name || ' ' || type || ' s' || strength FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst)
, l AS (SELECT kind, key, name, lower(name) AS n, lower(hay) AS h FROM i)
SELECT kind, key, name, (CASE kind WHEN 'node' THEN 5 WHEN 'group' THEN 3 ELSE 0 END
  + CASE WHEN starts_with(n, 's') THEN 14 WHEN contains(n, 's') THEN 7 ELSE 0 END + CASE WHEN contains(h, 's') THEN 2 ELSE 0 END
  + CASE WHEN starts_with(n, 'r') THEN 14 WHEN contains(n, 'r') THEN 7 ELSE 0 END + CASE WHEN contains(h, 'r') THEN 2 ELSE 0 END)::INT AS score
FROM l WHERE (contains(n, 's') OR contains(h, 's')) AND (contains(n, 'r') OR contains(h, 'r')) ORDER BY score DESC, kind, key LIMIT 50""")
def search_everything(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, tag values, groups and relations that hold both words; the report's top 50."""
    people = nodes(spark, d).select("id", "name", "groups", F.create_map(F.lit("tag"), F.array("tag")).alias("attrs"), F.concat_ws(" ", F.col("groups")[0], F.col("groups")[1]).alias("hay"))
    links = edges(spark, d).select("src", "dst", "type", F.concat(F.lit("s"), "strength").alias("event"))
    return search.ranked(search.search_items(people, links), " S  r ")


@query(f"WITH {NODES_SQL}" + """ SELECT id, name FROM nodes WHERE tag = 'PC' AND brand = 'Brand#11'""")
def facets_every(spark: SparkSession, d: str) -> DataFrame:
    people = nodes(spark, d).withColumn("attrs", F.create_map(F.lit("tag"), F.array("tag"), F.lit("brand"), F.array(F.col("groups")[0])))
    return search.with_facets(people, [("tag", "PC"), ("brand", "Brand#11")], every=True).select("id", "name")


@query(r"""WITH m AS (SELECT doc_id, text, name, pattern, len(regexp_extract_all(text, pattern)) AS hits FROM documents, (VALUES ('number', '[0-9]+'), ('shout', '!!+'), ('address', '[a-z0-9.]+@[a-z0-9.]+')) p(name, pattern))
, h AS (SELECT *, regexp_extract(text, pattern) AS hit, length(string_split_regex(text, pattern)[1]) AS pos FROM m WHERE hits > 0)
, x AS (SELECT name, hits, substr(text, greatest(pos - 30, 0) + 1, pos - greatest(pos - 30, 0) + length(hit) + 30) AS excerpt, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS k FROM h)
SELECT name AS pattern, sum(hits)::BIGINT AS hits, count(*) AS texts, string_agg(excerpt, '|' ORDER BY k) FILTER (k <= 3) AS excerpts FROM x GROUP BY name""")
def lint_excerpts(spark: SparkSession, d: str) -> DataFrame:
    patterns = {"number": "[0-9]+", "shout": "!!+", "address": "[a-z0-9.]+@[a-z0-9.]+"}
    found = search.pattern_hits(dealt_texts(spark, d), "text", "doc_id", patterns)
    return found.select("pattern", "hits", "texts", F.array_join("excerpts", "|").alias("excerpts"))


@query("""WITH h AS (SELECT conv_id % 20 AS file, turn * 1.5 AS s, turn * 1.5 + 1 AS e, text, t AS term FROM conversations, (SELECT unnest(['the', 'und', 'de ']) AS t) WHERE contains(text, t))
, r AS (SELECT *, count(*) OVER w AS hits, row_number() OVER (PARTITION BY file, term ORDER BY s, e, text) AS k FROM h WINDOW w AS (PARTITION BY file, term))
SELECT file, term, hits, greatest(s - 2, 0)::DOUBLE AS clip_start, (e + 2)::DOUBLE AS clip_end, text FROM r WHERE k = 1""")
def first_hits(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "conversations").select((F.col("conv_id") % 20).alias("file"), (F.col("turn") * F.lit(1.5)).alias("s"), (F.col("turn") * F.lit(1.5) + 1).alias("e"), "text")
    return search.first_hits(said, "file", "s", "e", "text", ["the", "und", "de "], 2.0)


@query(r"""WITH sen AS (SELECT lang AS grp, doc_id * 1000 + generate_subscripts(string_split(text, chr(10)), 1) AS no, unnest(string_split(text, chr(10))) AS sentence FROM documents)
, s1 AS (SELECT grp, sentence, min(no) AS no FROM sen GROUP BY ALL), nm AS (SELECT * FROM (VALUES (1, 'en', 'from the'), (1, 'en', 'this'), (2, 'de', 'und'), (3, 'fr', 'les'), (4, 'xx', 'the'), (5, 'en', 'ing'), (6, 'de', 'ä')) v(id, grp, name))
, h AS (SELECT DISTINCT id, no, sentence FROM s1 JOIN nm USING (grp) WHERE contains(sentence, name))
, o AS (SELECT *, contains(sentence, 'license') OR contains(sentence, '!') AS telling FROM h)
, r AS (SELECT *, row_number() OVER w AS place, sum(length(sentence)) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM o WINDOW w AS (PARTITION BY id ORDER BY telling DESC, no, sentence))
SELECT id, place, sentence, telling FROM r WHERE run <= 900""")
def evidence_digest(spark: SparkSession, d: str) -> DataFrame:
    people = spark.createDataFrame([(1, "en", ["from the", "this"]), (2, "de", ["und"]), (3, "fr", ["les"]), (4, "xx", ["the"]), (5, "en", ["ing", ""]), (6, "de", ["ä", None])], "id int, grp string, names array<string>")
    docs = table(spark, d, "documents").select(F.col("lang").alias("grp"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "sentence"))
    return search.evidence(people, docs.select("grp", (F.col("doc_id") * 1000 + F.col("at") + 1).alias("no"), "sentence"), ["license", "!"])


@query(None)  # similarity of matching blocks isn't SQL; tests hold the rule against given lines
def leak_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no piece of a prompt, without repeats, counted for each document."""
    kept = lines(spark, d).filter(~search.is_leak(F.col("line"), "Licensed under the Apache License, Version 2.0."))
    return segments.drop_repeats(kept, "doc_id", "no", "line").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("no").alias("places"))


@query(_SIDES + """, w0 AS (SELECT id AS root, id, NULL::VARCHAR AS parent, []::VARCHAR[] AS chain FROM nodes WHERE id IN ('P1', 'P7', 'P42'))
, w1 AS (SELECT root, other AS id, w0.id AS parent, [w0.id] AS chain FROM w0 JOIN st ON st.id = w0.id WHERE (root, other) NOT IN (SELECT (root, id) FROM w0))
, w2 AS (SELECT root, other AS id, arg_min(w1.id, w1.id) AS parent FROM w1 JOIN st ON st.id = w1.id WHERE (root, other) NOT IN (SELECT (root, id) FROM w0) AND (root, other) NOT IN (SELECT (root, id) FROM w1) GROUP BY root, other)
SELECT root, id, 0 AS dist, parent FROM w0 UNION ALL SELECT root, id, 1, parent FROM w1 UNION ALL SELECT root, id, 2, parent FROM w2""")
def ego_discovery(spark: SparkSession, d: str) -> DataFrame:
    roots = nodes(spark, d).filter(F.col("id").isin("P1", "P7", "P42")).select(F.col("id").alias("root"))
    return graph.discovery(edges(spark, d), roots, 2, edge_tasks(spark, d))


@query(_GRAPH + """, s AS (SELECT src AS id, dst AS other FROM edges WHERE src <> dst UNION ALL SELECT dst, src FROM edges WHERE src <> dst), r AS (SELECT id AS root FROM nodes WHERE id IN ('P1', 'P7', 'P42'))
, one AS (SELECT DISTINCT root, other AS id FROM r JOIN s ON s.id = root)
SELECT root, 1 AS dist, count(*) AS edges FROM r JOIN s ON s.id = root GROUP BY root UNION ALL SELECT root, 2, count(*) FROM one JOIN s USING (id) GROUP BY root""")
def ego_level_edges(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    roots = nodes(spark, d).filter(F.col("id").isin("P1", "P7", "P42")).select(F.col("id").alias("root"))
    n = edge_tasks(spark, d)
    return graph.level_edges(e, graph.breadth_first(e, roots, 1, n), 2, n)


@query(_SIDES + """, n AS (SELECT st.id AS root, other FROM st WHERE st.id IN ('P1', 'P7', 'P42'))
SELECT root, grp, count(*) AS n, grp IN (SELECT unnest(groups) FROM nodes WHERE id = root) AS own FROM (SELECT root, unnest(groups) AS grp FROM n JOIN nodes ON nodes.id = other) GROUP BY root, grp""")
def ego_groups(spark: SparkSession, d: str) -> DataFrame:
    roots = nodes(spark, d).filter(F.col("id").isin("P1", "P7", "P42")).select(F.col("id").alias("root"))
    return graph.ego_groups(nodes(spark, d), edges(spark, d), roots)


@query(f"WITH {NODES_SQL}" + """, m AS (SELECT id AS s, 'P' || (substr(id, 2)::INT - 1) AS t FROM nodes WHERE substr(id, 2)::INT % 10 = 0 AND id <> 'P0')
, p AS (SELECT m.t AS id, n.name, n.id AS s, n.groups, n.tag FROM m JOIN nodes n ON n.id = m.s)
SELECT n.id, n.name, CASE WHEN p.name <> n.name THEN p.name ELSE '' END AS aliases, list_aggregate(list_concat(n.groups, list_filter(coalesce(p.groups, []), lambda g: NOT list_contains(n.groups, g))), 'string_agg', '|') AS groups,
  CASE WHEN p.name IS NULL OR contains(n.name, p.name) OR contains(p.name, n.name) THEN n.name ELSE n.name || chr(10) || chr(10) || '(' || p.name || ')' || chr(10) || p.name END AS note,
  coalesce(CASE WHEN n.tag <> 'NPC' THEN n.tag END, CASE WHEN p.tag <> 'NPC' THEN p.tag END) AS played_by, coalesce(p.s, '') AS merged_from
FROM nodes n LEFT JOIN p ON p.id = n.id WHERE n.id NOT IN (SELECT s FROM m)""")
def node_merge_fields(spark: SparkSession, d: str) -> DataFrame:
    number = F.substring("id", 2, 20).cast("int")
    n = nodes(spark, d)
    merges = n.filter((number % 10 == 0) & (number > 0)).select(F.col("id").alias("src_id"), F.concat(F.lit("P"), number - 1).alias("dst_id"))
    people = n.select("id", "name", F.expr("CAST(array() AS array<string>)").alias("aliases"), "groups", F.expr("CAST(array() AS array<string>)").alias("tags"), F.col("name").alias("note"), F.when(F.col("tag") != "NPC", F.col("tag")).alias("played_by"))
    new = graph.merge_records(people, merges)
    return new.select("id", "name", F.array_join("aliases", "|").alias("aliases"), F.array_join("groups", "|").alias("groups"), "note", "played_by", F.array_join("merged_from", "|").alias("merged_from"))


@query(_GRAPH + """, op AS (SELECT event_ord * 10 AS seq, CASE event_ord % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'create' ELSE 'update' END AS op, src, dst, type,
    CASE WHEN event_ord % 5 IN (2, 3) THEN 'U' END AS nt, CASE WHEN event_ord % 5 IN (3, 4) THEN 3 END AS st FROM edges WHERE event_ord % 4 > 0
  UNION ALL SELECT event_ord * 10 + 5, 'create', src, dst, type, NULL, 2 FROM edges WHERE event_ord % 10 = 0)
, dl AS (SELECT id, 5000 AS seq FROM nodes WHERE substr(id, 2)::INT % 50 = 0), al AS (SELECT id FROM nodes WHERE tag <> 'KP')
, lg AS (SELECT -1 AS seq, 'create' AS op, src, dst, type, NULL::VARCHAR AS nt, strength AS st FROM edges UNION ALL SELECT * FROM op)
, ok AS (SELECT l.* FROM lg l LEFT JOIN dl a ON a.id = src LEFT JOIN dl b ON b.id = dst WHERE l.seq > greatest(coalesce(a.seq, -2), coalesce(b.seq, -2)))
, g AS (SELECT *, max(seq) FILTER (op = 'delete') OVER (PARTITION BY src, dst, type) AS gone FROM ok), a1 AS (SELECT * FROM g WHERE seq > coalesce(gone, -2))
, m AS (SELECT *, min(seq) FILTER (op = 'create') OVER (PARTITION BY src, dst, type) AS made FROM a1), v AS (SELECT * FROM m WHERE seq >= made AND (op <> 'create' OR seq = made))
SELECT src, dst, coalesce(arg_max(nt, seq) FILTER (nt IS NOT NULL), type) AS type, arg_max(st, seq) FILTER (st IS NOT NULL) AS strength FROM v
WHERE src IN (SELECT id FROM al) AND dst IN (SELECT id FROM al) GROUP BY src, dst, v.type""")
def overlay_relations(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    kind = F.when(F.col("event_ord") % 5 == 0, "delete").when(F.col("event_ord") % 5 == 1, "create").otherwise("update")
    ops = e.filter("event_ord % 4 > 0").select(
        (F.col("event_ord") * 10).alias("seq"), kind.alias("op"), "src", "dst", "type",
        F.when((F.col("event_ord") % 5).isin(2, 3), "U").alias("new_type"), F.when((F.col("event_ord") % 5).isin(3, 4), 3).alias("strength"),
    )
    again = e.filter("event_ord % 10 = 0").selectExpr("event_ord * 10 + 5 AS seq", "'create' AS op", "src", "dst", "type", "CAST(NULL AS string) AS new_type", "2 AS strength")
    gone = nodes(spark, d).filter(F.substring("id", 2, 20).cast("int") % 50 == 0).select("id", F.lit(5000).alias("seq"))
    return history.replay_edges(e, ops.unionByName(again), nodes(spark, d).filter("tag <> 'KP'"), gone)


@query("""WITH RECURSIVE c AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS k FROM c)
, f AS (SELECT event_type, day, k, 0::BIGINT AS seg0, 0::BIGINT AS s0, n AS total, (n - 1) // 12 AS cuts FROM o WHERE k = 1
  UNION ALL SELECT event_type, day, k, CASE WHEN rest + n > 10 THEN seg + 1 ELSE seg END, CASE WHEN rest + n > 10 THEN 0 ELSE rest END, CASE WHEN rest + n > 10 THEN n ELSE rest + n END,
    (CASE WHEN rest + n > 10 THEN n ELSE rest + n END - 1) // 12
  FROM (SELECT o.event_type, o.day, o.k, o.n, f.seg0 + f.cuts AS seg, f.total - f.cuts * 12 AS rest FROM f JOIN o ON o.event_type = f.event_type AND o.k = f.k + 1))
, p AS (SELECT *, unnest(range(0, cuts + 1)) AS j FROM f)
SELECT event_type, day::VARCHAR AS day, (seg0 + j)::INT AS segment, greatest(s0, j * 12) - s0 + 1 AS from_line, least(total, (j + 1) * 12) - greatest(s0, j * 12) AS n FROM p""")
def date_segments(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return segments.date_segments(counts, "event_type", "day", "n", 10, 12)


@query("""WITH l AS (SELECT conv_id AS file_ord, turn AS no, CASE WHEN conv_id % 5 > 0 AND turn % 4 < 3 THEN turn * 2.0 END AS s, role FROM conversations)
, e AS (SELECT f.file_ord, arg_max(s + 1, no) FILTER (s IS NOT NULL) AS last_end FROM l f GROUP BY 1)
, o AS (SELECT file_ord, last_end IS NOT NULL AS timed, coalesce(sum(last_end) OVER (ORDER BY file_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM e)
SELECT file_ord, no, (s + off)::DOUBLE AS start_s, (s + 1 + off)::DOUBLE AS end_s, role AS body, timed AND off > 0 AS shifted FROM l JOIN o USING (file_ord) WHERE NOT timed OR s IS NOT NULL""")
def joined_timeline(spark: SparkSession, d: str) -> DataFrame:
    s = F.when((F.col("conv_id") % 5 > 0) & (F.col("turn") % 4 < 3), F.col("turn") * F.lit(2.0))
    said = table(spark, d, "conversations").select(F.col("conv_id").alias("file_ord"), F.col("turn").alias("no"), s.alias("start_s"), (s + 1).alias("end_s"), F.col("role").alias("body"))
    return segments.joined_timeline(said, said.select("file_ord"))


@query("""SELECT CASE WHEN t IN ('act', 'see', 'buy') THEN t ELSE coalesce(m.c, 'other') END AS canon, t AS type_raw, count(*) AS n
FROM (SELECT CASE WHEN value < 5 THEN 'act' ELSE event_type END AS t FROM events) LEFT JOIN (VALUES ('click', 'act'), ('view', 'see'), ('purchase', 'buy')) m(k, c) ON m.k = t GROUP BY ALL""")
def vocab_canonical(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.createDataFrame([("click", "act"), ("view", "see"), ("purchase", "buy")], "raw string, canonical string")
    e = table(spark, d, "events").select(F.when(F.col("value") < 5, "act").otherwise(F.col("event_type")).alias("type_raw"))
    return names.mapped(e, "type_raw", mapping, "other").groupBy("canon", "type_raw").agg(F.count("*").alias("n"))
