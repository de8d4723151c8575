"""Registered queries over texts, chats and event streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import search
from ..operators import segments as seg
from ..operators.names import mapped, normalized
from ..operators.ordered import summed_before
from ..sources import texts
from ..sources.tables import dealt_texts, table

Q, S = {}, {}


def query_into(queries: dict, sqls: dict):
    """A decorator that registers a query with its SQL (None: SQL can't express it)."""

    def query(sql: str | None):
        def add(f):
            queries[f.__name__] = f
            if sql is not None:
                sqls[f.__name__] = sql
            return f

        return add

    return query


query = query_into(Q, S)


def epoch_us(ts: str) -> Column:
    """Microseconds since 1970 of a time stamp without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


_LINES = """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))


@query(_LINES + """, b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY no) AS before FROM lines)
SELECT doc_id, count(*) AS n, sum(no)::BIGINT AS places FROM b WHERE line = '' OR before IS NULL OR line <> before GROUP BY doc_id""")
def repeat_filter(spark: SparkSession, d: str) -> DataFrame:
    return seg.drop_repeats(lines(spark, d), "doc_id", "no", "line").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("no").alias("places"))


@query("""SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def prompt_leak(spark: SparkSession, d: str) -> DataFrame:
    passages = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return search.holding(docs, "text", passages, "passage").select("doc_id", "item_id").distinct()


@query(_LINES + """SELECT doc_id, no // 20 AS chunk, count(*) AS n, 'L' || (min(no) + 1) || '-' || (max(no) + 1) AS label FROM lines GROUP BY ALL""")
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat(F.lit("L"), F.min("no") + 1, F.lit("-"), F.max("no") + 1)
    return lines(spark, d).groupBy("doc_id", F.floor(F.col("no") / 20).alias("chunk")).agg(F.count("*").alias("n"), label.alias("label"))


@query(_LINES + """SELECT t AS term, doc_id, min(no) AS first_line, count(*) AS n FROM lines, (SELECT unnest(['license', 'the and', 'Der ']) AS t) WHERE contains(line, t) GROUP BY ALL""")
def text_grep(spark: SparkSession, d: str) -> DataFrame:
    terms = ["license", "the and", "Der "]
    return search.term_hits(lines(spark, d), "line", terms, ["doc_id", "no"]).groupBy("term", "doc_id").agg(F.min("no").alias("first_line"), F.count("*").alias("n"))


@query(r"""SELECT name, sum(len(regexp_extract_all(text, pattern)))::BIGINT AS hits, count(*) AS docs FROM documents,
(VALUES ('number', '[0-9]+'), ('shout', '!!+'), ('address', '[a-z0-9.]+@[a-z0-9.]+'), ('table', ' \| ')) p(name, pattern) WHERE regexp_matches(text, pattern) GROUP BY name""")
def text_lint(spark: SparkSession, d: str) -> DataFrame:
    patterns = {"number": "[0-9]+", "shout": "!!+", "address": "[a-z0-9.]+@[a-z0-9.]+", "table": r" \| "}
    found = search.pattern_hits(dealt_texts(spark, d), "text", "doc_id", patterns)
    return found.select(F.col("pattern").alias("name"), "hits", F.col("texts").alias("docs"))


@query("""SELECT lang, CASE WHEN length(text) < 40 THEN '<40' WHEN length(text) < 80 THEN '40-80' WHEN length(text) < 130 THEN '80-130' ELSE '>130' END AS bucket, count(*) AS n
FROM documents GROUP BY ALL""")
def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    bucket = F.when(n < 40, "<40").when(n < 80, "40-80").when(n < 130, "80-130").otherwise(">130")
    return table(spark, d, "documents").groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 60 AS t FROM events), w AS (SELECT *, s // 86400 AS win FROM e)
, c AS (SELECT *, (row_number() OVER (PARTITION BY user_id, win ORDER BY s, event_id) - 1) // 3 AS chunk FROM w)
SELECT user_id, win, chunk, count(*) AS n, min(s) AS first_start, arg_max(t, (s, event_id)) AS last_end FROM c GROUP BY ALL""")
def tumbling_segments(spark: SparkSession, d: str) -> DataFrame:
    s = F.floor(epoch_us("ts") / 1_000_000)
    e = table(spark, d, "events").select("user_id", "event_id", s.alias("s"), (s + 60).alias("t"))
    return seg.tumbling(e, "user_id", "s", "t", 86400, 3, ["event_id"])


@query("""WITH f AS (SELECT conv_id, max(turn) + 1 AS len FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(sum(len) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at FROM f""")
def timeline_concat(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).cast("long").alias("len"))
    return summed_before(files, "len", ["conv_id"], name="start_at").select("conv_id", "start_at")


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 3 = 0 THEN ts::DATE END AS day FROM events)
SELECT user_id, event_id, last_value(day IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::VARCHAR AS day FROM e""")
def date_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_id") % 3 == 0, F.to_date("ts")).alias("day"))
    return seg.carried(e, "user_id", ["ts", "event_id"], "day").select("user_id", "event_id", F.col("day").cast("string").alias("day"))


_RANGES = [("spring", "1994-03-01", "1994-06-30"), ("overlap", "1994-06-01", "1994-09-30"), ("late", "1997-01-01", "1997-12-31")]


@query("""WITH r(grp, a, b) AS (VALUES """ + ", ".join(f"('{g}', DATE '{a}', DATE '{b}')" for g, a, b in _RANGES) + """)
SELECT coalesce(grp, 'unclassified') AS grp, count(*) AS n, min(o_orderkey) AS first_key FROM orders LEFT JOIN r ON o_orderdate::DATE BETWEEN a AND b GROUP BY ALL""")
def date_range_split(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    hits = F.filter(F.array(*[F.struct(F.lit(g).alias("g"), day.between(F.lit(a).cast("date"), F.lit(b).cast("date")).alias("on")) for g, a, b in _RANGES]), lambda x: x["on"])
    named = F.when(F.size(hits) > 0, F.transform(hits, lambda x: x["g"])).otherwise(F.array(F.lit("unclassified")))
    return table(spark, d, "orders").select("o_orderkey", F.explode(named).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("""WITH RECURSIVE c AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)
, o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS k FROM c)
, f AS (SELECT event_type, day, n, k, n AS s, 0 AS bin FROM o WHERE k = 1
  UNION ALL SELECT o.event_type, o.day, o.n, o.k, CASE WHEN f.s + o.n <= 20 THEN f.s + o.n ELSE o.n END, CASE WHEN f.s + o.n <= 20 THEN f.bin ELSE f.bin + 1 END
  FROM f JOIN o ON o.event_type = f.event_type AND o.k = f.k + 1)
SELECT event_type, day::VARCHAR AS day, n, bin FROM f""")
def date_binpack(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return seg.bin_consecutive(counts, "event_type", "day", "n", 20)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS s, epoch(ts)::DOUBLE + 600 AS t FROM events)
, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, t) AS k FROM e)
, f AS (SELECT user_id, event_id, k, s AS first, t AS last, t - s AS speech, 0 AS batch FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.event_id, o.k,
    CASE WHEN f.speech + o.t - o.s > 3000 OR o.t - f.first > 259200 OR o.s - f.last > 86400 THEN o.s ELSE f.first END, o.t,
    CASE WHEN f.speech + o.t - o.s > 3000 OR o.t - f.first > 259200 OR o.s - f.last > 86400 THEN o.t - o.s ELSE f.speech + o.t - o.s END,
    f.batch + CASE WHEN f.speech + o.t - o.s > 3000 OR o.t - f.first > 259200 OR o.s - f.last > 86400 THEN 1 ELSE 0 END
  FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, event_id, batch FROM f""")
def batch_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = epoch_us("ts") / 1e6
    e = table(spark, d, "events").select("user_id", "event_id", s.alias("s"), (s + 600).alias("t"))
    return seg.batches(e, "user_id", "s", "t", 3000, 259200, 86400).select("user_id", "event_id", "batch")


@query("""SELECT role, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn, count(DISTINCT conv_id) AS convs, arg_max(length(text), (conv_id, turn)) AS last_length
FROM conversations GROUP BY role""")
def chat_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(
        F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.countDistinct("conv_id").alias("convs"),
        F.max_by(F.length("text"), F.struct("conv_id", "turn")).alias("last_length"),
    )


@query("""WITH m AS (SELECT event_id, ts, 'u' || user_id AS name, props, CASE event_type WHEN 'click' THEN 'audio' WHEN 'purchase' THEN 'reply' WHEN 'view' THEN 'text' ELSE event_type END AS kind FROM events)
SELECT event_id, '[' || strftime(ts, '%m-%d %H:%M') || '] ' || name || ': ' || CASE kind WHEN 'audio' THEN '[语音]' WHEN 'reply' THEN '(回复) ' || props WHEN 'text' THEN props ELSE '(' || kind || ') ' || left(props, 100) END AS line FROM m""")
def message_lines(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "audio").when(F.col("event_type") == "purchase", "reply").when(F.col("event_type") == "view", "text").otherwise(F.col("event_type"))
    line = texts.message_line(kind, F.col("props"), F.concat(F.lit("u"), "user_id"), F.col("ts"))
    return table(spark, d, "events").select("event_id", line.alias("line"))


_ALIASES = [("ring", "R"), ("small", "S"), ("in", "I"), ("steel ring", "SR"), ("brass", "B")]  # in the order of registration


@query("""WITH a(alias, canon, ord) AS (VALUES """ + ", ".join(f"('{a}', '{c}', {i})" for i, (a, c) in enumerate(_ALIASES)) + """), p AS (SELECT DISTINCT p_name AS s FROM part)
, m AS (SELECT s, arg_min(canon, CASE WHEN trim(s) = alias THEN -1 ELSE ord END) AS canon FROM p JOIN a ON contains(s, alias) GROUP BY s)
SELECT s AS raw, coalesce(canon, trim(s)) AS canon, coalesce(canon, trim(s)) <> trim(s) AS changed FROM p LEFT JOIN m USING (s)""")
def alias_normalize(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.createDataFrame([(a, c, i) for i, (a, c) in enumerate(_ALIASES)], "alias string, canonical string, ord int")
    return normalized(table(spark, d, "part").select(F.col("p_name").alias("raw")).distinct(), "raw", aliases)


@query("""SELECT coalesce(m.c, 'other') AS canon, event_type AS type_raw, count(*) AS n, count(*) * 100 // sum(count(*)) OVER () AS percent
FROM events LEFT JOIN (VALUES ('click', 'act'), ('view', 'see'), ('purchase', 'buy')) m(t, c) ON m.t = event_type GROUP BY ALL""")
def vocab_map(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.createDataFrame([("click", "act"), ("view", "see"), ("purchase", "buy")], "raw string, canonical string")
    n = mapped(table(spark, d, "events").select(F.col("event_type").alias("type_raw")), "type_raw", mapping, "other").groupBy("canon", "type_raw").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    return n.join(F.broadcast(total)).select("canon", "type_raw", "n", F.expr("n * 100 div total").alias("percent"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS hits,
count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) > 8 AS refused FROM events""")
def rate_limit_all(spark: SparkSession, d: str) -> DataFrame:
    day = W.partitionBy("user_id").orderBy(epoch_us("ts")).rangeBetween(-86_399_999_999, 0)
    return table(spark, d, "events").select("event_id", F.count("*").over(day).alias("hits")).withColumn("refused", F.col("hits") > 8)


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events)
, f AS (SELECT user_id, event_id, k, true AS accepted, [s] AS recent FROM o WHERE k = 1
  UNION ALL SELECT user_id, event_id, k, len(r) < 8, CASE WHEN len(r) < 8 THEN list_append(r, s) ELSE r END
  FROM (SELECT o.user_id, o.event_id, o.k, o.s, list_filter(f.recent, lambda x: o.s - x < 86400) AS r FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1))
SELECT user_id, event_id, accepted FROM f""")
def rate_limit_accepted(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "events").select("user_id", "event_id", (epoch_us("ts") / 1e6).alias("s"))
    return seg.accepted_hits(hits, "user_id", "s", "event_id", 86400, 8).select("user_id", "event_id", "accepted")


@query("""WITH s AS (SELECT doc_id, source, length(text) AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents)
SELECT source, count(*) AS picked, sum(n)::BIGINT AS chars FROM s WHERE run <= 20000 GROUP BY source""")
def running_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", F.length("text").cast("long").alias("n"))
    run = summed_before(docs, "n", ["doc_id"], ["source"]).filter("before + n <= 20000")
    return run.groupBy("source").agg(F.count("*").alias("picked"), F.sum("n").alias("chars"))


@query("""SELECT q.vec_id, arg_min(c.vec_id, (list_sum(list_transform(range(1, 65), lambda i: abs(q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE))), c.vec_id)) AS nearest
FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id""")
def nearest_pick(spark: SparkSession, d: str) -> DataFrame:
    """The staged picks (a stated query set) against all vectors."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return search.nearest(v.filter("vec_id % 50 = 0"), v, 64)
