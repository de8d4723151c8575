"""Registered queries over the quality filter, calls from outside, merged values, speakers and folder digests, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls, graph, history, quality, reports
from ..sources.tables import EDGES_SQL, NODES_SQL, edges, nodes, table
from .text import _LINES, lines, query_into

Q, S = {}, {}
query = query_into(Q, S)

_PROMPT = "Licensed under the Apache License, Version 2.0."


@query(_LINES + r""", l AS (SELECT *, regexp_replace(line, '[\s，。！？、；：,.!?;:~～…—\-（）()【】\[\]「」『』"''“”‘’]', '', 'g') AS x FROM lines)
, t AS (SELECT *, length(x) >= 4 AND (contains('LicensedundertheApacheLicenseVersion20', x) OR contains(x, 'LicensedundertheApacheLicense') OR contains(x, 'Version2')) AS leak FROM l)
, k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY no) AS b FROM t WHERE NOT leak)
, o AS (SELECT doc_id, no, line, CASE WHEN line <> '' AND line = b THEN 'repeat' ELSE 'kept' END AS o FROM k UNION ALL SELECT doc_id, no, line, 'leak' FROM t WHERE leak)
, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, o ORDER BY no) AS rk FROM o)
SELECT doc_id, count(*) FILTER (o = 'kept') AS kept, count(*) FILTER (o <> 'kept') AS dropped, count(*) FILTER (o = 'leak') AS prompt_leak, count(*) FILTER (o = 'repeat') AS repeat,
  coalesce(string_agg(printf('[%07.2f] ', no::DOUBLE) || line, chr(10) ORDER BY no) FILTER (o = 'kept' AND rk <= 5), '') AS first_kept,
  coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (o = 'leak' AND rk <= 3), '') AS leak_samples FROM r GROUP BY doc_id""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    """What the filter keeps and drops of each document's lines; only pieces of the prompt that stand whole count (similarity of
    matching blocks isn't SQL, ``leak_filter`` has it)."""
    told = quality.outcomes(lines(spark, d), "doc_id", ["no"], "line", _PROMPT, threshold=1.0)
    shown = lambda c: F.array_join(c, "\n").alias(c)
    return quality.report(told, "doc_id", "no", "line").select("doc_id", "kept", "dropped", "prompt_leak", "repeat", shown("first_kept"), shown("leak_samples"))


def _measured(text: str, attempt: int) -> str:
    """A reply that comes late for some texts and is none for others."""
    if attempt <= len(text) % 4:
        raise TimeoutError(f"attempt {attempt}")
    return "-" if len(text) % 10 == 9 else f" {len(text)} characters\n"


@query("""WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n FROM documents)
SELECT doc_id, CASE WHEN n <= 20000 AND n % 4 < 3 AND n % 10 <> 9 THEN n || ' characters' END AS result, CASE WHEN n > 20000 THEN 0 WHEN n % 4 = 3 THEN 3 ELSE n % 4 + 1 END::INT AS attempts,
  CASE WHEN n > 20000 THEN 'ValueError: ' || n || ' characters are more than 20000' WHEN n % 4 = 3 THEN 'TimeoutError: attempt 3' WHEN n % 10 = 9 THEN 'ValueError: the result is no answer: ''-''' END AS error FROM d""")
def called_texts(spark: SparkSession, d: str) -> DataFrame:
    """Replies to all texts by a function that fails at times: what failed for good is told, with the attempts it took."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return calls.called(docs, "text", _measured, 2, (TimeoutError,), 20000, lambda reply: reply == "-").drop("text")


# every tenth node goes into the one before, every eighth of ten into the one after
_MERGES = f"""WITH {NODES_SQL}, num AS (SELECT id, substr(id, 2)::INT AS k FROM nodes), m AS (SELECT id AS src_id, 'P' || CASE WHEN k % 10 = 0 THEN k - 1 ELSE k + 1 END AS dst_id FROM num WHERE k % 10 IN (0, 8))"""


def _merges(spark: SparkSession, d: str) -> DataFrame:
    k = F.substring("id", 2, 20).cast("int")
    return nodes(spark, d).filter((k % 10).isin(0, 8)).select(F.col("id").alias("src_id"), F.concat(F.lit("P"), F.when(k % 10 == 0, k - 1).otherwise(k + 1)).alias("dst_id"))


@query(_MERGES + """, v AS (SELECT id, 'tag' AS dim, tag AS value, 0 AS ord FROM nodes UNION ALL SELECT id, 'group', brand, 0 FROM nodes UNION ALL SELECT id, 'group', ptype, 1 FROM nodes)
, w AS (SELECT coalesce(dst_id, id) AS id, dim, value, src_id AS origin, ord FROM v LEFT JOIN m ON src_id = id)
, r AS (SELECT *, row_number() OVER (PARTITION BY id, dim, value ORDER BY origin NULLS FIRST, ord) AS rk FROM w) SELECT id, dim, value, origin, ord FROM r WHERE rk = 1""")
def node_merge_values(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    tags = n.select("id", F.lit("tag").alias("dim"), F.col("tag").alias("value"), F.lit(0).alias("ord"))
    groups = n.select("id", F.lit("group").alias("dim"), F.posexplode("groups").alias("ord", "value")).select("id", "dim", "value", "ord")
    return graph.merge_values(tags.unionByName(groups), _merges(spark, d), ("dim",))


@query(_MERGES + f", {EDGES_SQL}" + """, e AS (SELECT coalesce(x.dst_id, src) AS a, coalesce(y.dst_id, dst) AS b, type, event_ord, src, dst, x.src_id AS f, y.src_id AS t FROM edges LEFT JOIN m x ON x.src_id = src LEFT JOIN m y ON y.src_id = dst)
, g AS (SELECT *, coalesce(greatest(f, t), f, t) AS late FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY a, b, type ORDER BY late IS NOT NULL, event_ord, src, dst) AS rk FROM g)
, mv AS (SELECT id, count(*) AS moved FROM (SELECT f AS id FROM g WHERE f IS NOT NULL UNION ALL SELECT t FROM g WHERE t IS NOT NULL AND t IS DISTINCT FROM f) GROUP BY id)
, dr AS (SELECT late AS id, count(*) AS dropped FROM r WHERE late IS NOT NULL AND (a = b OR rk > 1) GROUP BY late)
SELECT src_id, dst_id, coalesce(moved, 0) AS moved, coalesce(dropped, 0) AS dropped FROM m LEFT JOIN mv ON mv.id = src_id LEFT JOIN dr ON dr.id = src_id""")
def node_merge_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_counts(edges(spark, d), _merges(spark, d))


@query("""SELECT 'speaker' AS what, user_id::VARCHAR AS key, count(*) AS n, arg_max(event_type, event_id) AS last_name FROM events GROUP BY user_id
UNION ALL SELECT 'type', event_type, count(*), NULL FROM events GROUP BY event_type""")
def talk_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.talk_summary(table(spark, d, "events").withColumn("name", F.col("event_type")), "user_id", "name", "event_type", "event_id")


@query("""WITH sz AS (SELECT source, count(*) AS n FROM documents GROUP BY source), b AS (SELECT d.source, n, doc_id::VARCHAR AS name, sha256(coalesce(text, '')) AS dg,
  CASE WHEN n > 256 THEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % (1::BIGINT << ceil(log2(n / 256))::INT) END AS blk FROM documents d JOIN sz ON d.source IS NOT DISTINCT FROM sz.source)
, p AS (SELECT source, n, blk::VARCHAR AS name, left(sha256(string_agg(name || chr(0) || dg || chr(1), '' ORDER BY name, dg)), 32) AS dg FROM b WHERE blk IS NOT NULL GROUP BY source, n, blk UNION ALL SELECT source, n, name, dg FROM b WHERE blk IS NULL)
SELECT source, n, left(sha256(string_agg(name || chr(0) || dg || chr(1), '' ORDER BY name, dg)), 32) AS digest FROM p GROUP BY source, n""")
def folder_digests(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"))
    return history.folder_digests(docs, "source", "doc_id", "hash", 256)
