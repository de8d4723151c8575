"""Registered queries over edited records, reviews, validation and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import RESERVED_GROUPS, attributes, stripped
from ..operators import names, records
from ..sources.tables import EDGES_SQL, NODES_SQL, edge_tasks, edges, nodes, table
from .changes import _NODE_PATCH, node_patch
from .text import query_into

Q, S = {}, {}
query = query_into(Q, S)

_GRAPH = f"WITH {NODES_SQL}, {EDGES_SQL}"
_PATCH = f"WITH {NODES_SQL}, {_NODE_PATCH}"


@query(_GRAPH + """, u AS (
  SELECT event_ord AS seq, src, dst, CASE WHEN event_ord % 2 = 0 THEN type ELSE 'X' END AS old_type, 'U' AS type, 3 AS strength FROM edges WHERE event_ord % 3 = 0
  UNION ALL SELECT o_orderkey, 'P' || o_custkey, 'P' || (o_custkey - o_custkey % 4 + 1), NULL, 'V', 1 FROM orders WHERE o_orderkey % 5 = 0
), l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY seq DESC, type DESC, old_type DESC NULLS LAST) = 1),
v AS (SELECT * FROM l WHERE src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)),
j AS (SELECT e.*, v.type AS new_type, v.strength AS new_strength, row_number() OVER (PARTITION BY e.src, e.dst ORDER BY e.type IS DISTINCT FROM v.old_type, event_ord, e.type) AS k
      FROM edges e LEFT JOIN v ON e.src = v.src AND e.dst = v.dst)
SELECT src, dst, CASE WHEN k = 1 THEN coalesce(new_type, type) ELSE type END AS type, CASE WHEN k = 1 THEN coalesce(new_strength, strength) ELSE strength END AS strength, event_ord
FROM j WHERE new_type IS NULL OR k = 1 OR type <> new_type
UNION ALL SELECT src, dst, type, strength, seq FROM v WHERE (src, dst) NOT IN (SELECT (src, dst) FROM edges)""")
def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    stored = edges(spark, d)
    old = F.when(F.col("event_ord") % 2 == 0, F.col("type")).otherwise("X")
    changed = stored.filter("event_ord % 3 = 0").select(F.col("event_ord").alias("seq"), "src", "dst", old.alias("old_type"), F.lit("U").alias("type"), F.lit(3).alias("strength"))
    added = table(spark, d, "orders").filter("o_orderkey % 5 = 0").selectExpr(
        "o_orderkey AS seq", "concat('P', o_custkey) AS src", "concat('P', o_custkey - o_custkey % 4 + 1) AS dst", "CAST(NULL AS string) AS old_type", "'V' AS type", "1 AS strength"
    )
    return records.upsert_edges(stored, changed.unionByName(added), nodes(spark, d))


@query(_GRAPH + """, x AS (SELECT src, dst, CASE WHEN event_ord % 2 = 0 THEN 'R' END AS type FROM edges WHERE event_ord % 3 = 0)
SELECT src, dst, type FROM edges e WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.src = e.src AND x.dst = e.dst AND (x.type IS NULL OR x.type = e.type))""")
def edge_delete(spark: SparkSession, d: str) -> DataFrame:
    stored = edges(spark, d)
    deletes = stored.filter("event_ord % 3 = 0").select("src", "dst", F.when(F.col("event_ord") % 2 == 0, "R").alias("type"))
    return records.delete_edges(stored.select("src", "dst", "type"), deletes, edge_tasks(spark, d))


@query("""SELECT o_custkey AS uid, o_orderpriority AS grp, o_orderstatus AS role, min(o_orderkey) AS idx FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) GROUP BY ALL""")
def player_roles(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("uid"))
    updates = table(spark, d, "orders").selectExpr("o_orderkey AS idx", "o_custkey AS uid", "o_orderpriority AS grp", "o_orderstatus AS role")
    return records.add_roles(people, updates)


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_id AS seq", "event_id % 5000 AS idx", "element_at(array('accept', 'reject', 'set'), CAST(event_id % 3 + 1 AS int)) AS action",
        "CASE WHEN event_id % 2 = 0 THEN 'name' ELSE 'id' END AS field", "concat('R', user_id) AS value",
    )


@query(_PATCH + """, de AS (SELECT event_id AS seq, event_id % 5000 AS idx, (['accept', 'reject', 'set'])[event_id % 3 + 1] AS action,
  CASE WHEN event_id % 2 = 0 THEN 'name' ELSE 'id' END AS field, 'R' || user_id AS value FROM events),
l AS (SELECT idx, arg_max(action, seq) FILTER (action <> 'set') AS status, arg_max(value, seq) FILTER (action = 'set' AND field = 'name') AS name,
  arg_max(value, seq) FILTER (action = 'set' AND field = 'id') AS id FROM de GROUP BY idx)
SELECT p.idx, coalesce(l.id, p.id) AS id, coalesce(l.name, p.name) AS name, coalesce(l.status, 'open') AS status
FROM np_out p LEFT JOIN l ON l.idx = p.idx WHERE outcome = 'pending'""")
def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    pending = node_patch(spark, d).filter("NOT coalesce(confirmed, true)").withColumns({c: stripped(c) for c in ("id", "name")})
    return records.decide(pending, decisions(spark, d), ("id", "name"))


@query(_PATCH + """ SELECT id, arg_min(name, idx) FILTER (name <> '') AS name, count(DISTINCT name) FILTER (name <> '') AS names, count(*) AS n
FROM np WHERE id <> '' GROUP BY id""")
def patch_lint(spark: SparkSession, d: str) -> DataFrame:
    return records.lint_nodes(node_patch(spark, d))


@query(_PATCH + """, c AS (SELECT nullif(id, '') AS id, count(*) AS n, count_if(coalesce(name, '') = '') AS m FROM np GROUP BY 1)
SELECT CASE WHEN id IS NULL THEN 'missing id' ELSE 'duplicate id' END AS issue, id, n FROM c WHERE id IS NULL OR n > 1
UNION ALL SELECT 'missing name', id, m FROM c WHERE m > 0""")
def patch_issues(spark: SparkSession, d: str) -> DataFrame:
    return records.issues(node_patch(spark, d))


_KNOWN = ("ring", "small ring", "steel", "g r", "bolt")


@query("""SELECT p_partkey, CASE """ + " ".join(f"WHEN contains(p_name, '{k}') THEN '{k}'" for k in sorted(_KNOWN, key=len, reverse=True)) + """ ELSE p_name END AS grp FROM part""")
def group_assign(spark: SparkSession, d: str) -> DataFrame:
    """The longest known group that a name holds; ties go to the first listed."""
    grp = names.group_of(F.concat("p_name", F.lit(".txt")), known=_KNOWN)
    return table(spark, d, "part").select("p_partkey", grp["grp"].alias("grp"))


@query(_GRAPH + """, c AS (SELECT id FROM nodes WHERE brand = 'Brand#11'), s AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges)
SELECT b AS id, count(*) AS links, count(DISTINCT a) AS inside FROM s WHERE a IN (SELECT id FROM c) AND b NOT IN (SELECT id FROM c) GROUP BY b""")
def core_outside(spark: SparkSession, d: str) -> DataFrame:
    core = nodes(spark, d).filter(F.array_contains("groups", "Brand#11")).select("id")
    e = edges(spark, d)
    sides = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    out = sides.join(core, sides.a == core.id, "left_semi").join(core, sides.b == core.id, "left_anti")
    return out.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("links"), F.countDistinct("a").alias("inside"))


@query(_GRAPH + " SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges) AND id NOT IN (SELECT dst FROM edges)")
def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return nodes(spark, d).select("id").join(e.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_anti")


@query(_GRAPH + """, g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)
SELECT n.id, name, brand = (SELECT brand FROM nodes WHERE id = 'P42') AS same_group, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN g ON g.id = n.id
WHERE n.id <> 'P42' AND (contains(n.id, '4') OR contains(name, 'ring')) ORDER BY same_group DESC, degree, n.id LIMIT 60""")
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What node P42 could be merged with: same group first, fewest relations first, 60 at most (the report's limit)."""
    n = nodes(spark, d)
    degree = edges(spark, d).select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    own = F.broadcast(n.filter("id = 'P42'").select(F.col("groups").alias("own")))  # one row
    found = n.filter((F.col("id") != "P42") & (F.contains("id", F.lit("4")) | F.contains("name", F.lit("ring")))).join(own).join(degree, "id", "left")
    chosen = found.select("id", "name", (F.col("groups")[0] == F.col("own")[0]).alias("same_group"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return chosen.orderBy(F.desc("same_group"), "degree", "id").limit(60)


@query(f"WITH {NODES_SQL} SELECT id, arg_min(g, (h, g)) AS grp FROM (SELECT id, g, list_sum(list_transform(string_split(g, ''), lambda c: ord(c))) % 97 AS h FROM (SELECT id, unnest(groups) AS g FROM nodes)) GROUP BY id")
def primary_group(spark: SparkSession, d: str) -> DataFrame:
    """Each node's first group in the order of a stable hash: no shuffle, the groups stand in its row."""
    points = lambda g: F.aggregate(F.split(g, ""), F.lit(0), lambda a, c: a + F.when(c == "", 0).otherwise(F.ascii(c)))
    hashed = F.transform("groups", lambda g: F.struct((points(g) % 97).alias("h"), g.alias("g")))
    return nodes(spark, d).select("id", F.array_min(hashed)["g"].alias("grp"))


@query(f"WITH {NODES_SQL} SELECT brand AS grp, count_if(tag = 'PC') AS pc, count_if(tag = 'NPC') AS npc, count_if(tag = 'BOSS') AS boss, count_if(tag = 'KP') AS kp, count(*) AS total FROM nodes GROUP BY ALL")
def group_tag_pivot(spark: SparkSession, d: str) -> DataFrame:
    kinds = [F.count_if(F.col("tag") == t).alias(t.lower()) for t in ("PC", "NPC", "BOSS", "KP")]
    return nodes(spark, d).groupBy(F.col("groups")[0].alias("grp")).agg(*kinds, F.count("*").alias("total"))


@query("SELECT event_type, count_if(event_id % 3 = 0) AS pending, count_if(event_id % 3 = 1) AS approved, count_if(event_id % 3 = 2) AS rejected FROM events GROUP BY ALL")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    of = lambda i: F.count_if(F.col("event_id") % 3 == i)
    return table(spark, d, "events").groupBy("event_type").agg(of(0).alias("pending"), of(1).alias("approved"), of(2).alias("rejected"))


@query(f"WITH {NODES_SQL} SELECT tag AS value, count(*) AS n, min(id) AS first_id FROM nodes WHERE tag IN ('PC', 'NPC', 'BOSS', 'KP') GROUP BY tag")
def dirty_groups(spark: SparkSession, d: str) -> DataFrame:
    """Values that stand in a group list without being groups."""
    each = nodes(spark, d).select("id", F.explode(F.array_append("groups", F.col("tag"))).alias("value"))
    return each.filter(F.col("value").isin(*RESERVED_GROUPS)).groupBy("value").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"""WITH {NODES_SQL} SELECT brand AS grp, count(*) AS n, count_if(price > 1500) * 100 // count(*) AS percent,
count_if(contains(name, 'ring')) AS ring, count_if(contains(name, 'small')) AS small FROM nodes WHERE tag <> 'KP' GROUP BY ALL""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    clues = [F.count_if(F.contains("name", F.lit(w))).alias(w) for w in ("ring", "small")]
    percent = F.expr("count_if(price > 1500) * 100 DIV count(*)")
    return nodes(spark, d).filter("tag <> 'KP'").groupBy(F.col("groups")[0].alias("grp")).agg(F.count("*").alias("n"), percent.alias("percent"), *clues)


@query("""SELECT p_partkey, 'brand' AS dim, unnest([p_brand, 'x']) AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part""")
def attribute_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("brand: "), "p_brand", F.lit("、x\n type : "), "p_type", F.lit("\nsize:\nno attribute"))
    return table(spark, d, "part").select("p_partkey", F.explode(attributes(text)).alias("dim", "values")).select("p_partkey", "dim", F.explode("values").alias("value"))


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR ORDER BY ts DESC, event_id DESC LIMIT 24")
def recent_first(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    newest = F.broadcast(e.agg(F.max("ts").alias("newest")))  # one row
    return e.join(newest, F.expr("ts >= newest - INTERVAL 24 HOURS")).orderBy(F.desc("ts"), F.desc("event_id")).limit(24).select("event_id", "user_id")


@query("""SELECT coalesce(a.v, b.v) AS value, CASE WHEN b.v IS NULL THEN 'extra' WHEN a.v IS NULL THEN 'missing' ELSE 'known' END AS side
FROM (SELECT DISTINCT event_type AS v FROM events) a FULL JOIN (VALUES ('click'), ('purchase'), ('trade')) b(v) ON a.v = b.v""")
def vocab_coverage(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "events").select(F.col("event_type").alias("value")).distinct().withColumn("found", F.lit(True))
    canon = spark.createDataFrame([("click", True), ("purchase", True), ("trade", True)], "value string, canon boolean")
    side = F.when(F.col("canon").isNull(), "extra").when(F.col("found").isNull(), "missing").otherwise("known")
    return found.join(canon, "value", "full").select("value", side.alias("side"))
