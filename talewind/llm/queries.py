"""The subpackage's registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_pack, byte_bpe, chat_format, kd_shards, merkle_manifest, minhash_join, pareto_mix, periodic_runs, piece_lm, pigeonhole_join, prefix_forest, style_tree, toxicity
from .common import WORD, held_out, table

CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "toxicity.*")


def op2_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack.pack(table(spark, sf_dir, "documents"))


def op3_piece_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return piece_lm.predict(docs, piece_lm.fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.*")


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pareto_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), measured AS (SELECT *, (length(bin(size)) + 8)::BIGINT AS measure FROM sizes
), sources AS (
  SELECT source, source_size, source_size * 3 AS most, sum(source_size) OVER ()::BIGINT AS total,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source)
), leveled AS (
  SELECT *, row_number() OVER o AS place,
         ((total - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)))::DOUBLE AS level
  FROM sources
  WINDOW o AS (ORDER BY most / weight, source NULLS LAST),
         b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         coalesce(least(most::DOUBLE, (SELECT arg_min(level, place) FROM leveled WHERE level <= most / weight) * weight), most::DOUBLE) AS target
  FROM leveled
), parts AS (
  SELECT m.source, measure, words, target, words * measure AS weight, words * 3 AS most
  FROM (SELECT source, measure, sum(size)::BIGINT AS words FROM measured GROUP BY ALL HAVING sum(size) > 0) m
  JOIN targets t ON m.source IS NOT DISTINCT FROM t.source
), part_levels AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY most / weight, measure) AS place,
         ((target - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER (PARTITION BY source) - coalesce(sum(weight) OVER b, 0)))::DOUBLE AS level
  FROM parts
  WINDOW b AS (PARTITION BY source ORDER BY most / weight, measure ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), found AS (
  SELECT source, arg_min(level, place) AS level FROM part_levels WHERE level <= most / weight GROUP BY source
), copies AS (
  SELECT p.source, measure, least(coalesce(least(most::DOUBLE, f.level * weight), most::DOUBLE) / words, 3.0) AS copies
  FROM part_levels p LEFT JOIN found f ON p.source IS NOT DISTINCT FROM f.source
), drawn AS (
  SELECT m.doc_id, m.source, m.size, t.source_size, t.target, floor(coalesce(c.copies, 0))::BIGINT AS certain,
         coalesce(c.copies, 0) - floor(coalesce(c.copies, 0)) AS chance,
         (('0x' || substr(md5('mix:' || coalesce(m.doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM measured m JOIN targets t ON m.source IS NOT DISTINCT FROM t.source
  LEFT JOIN copies c ON m.source IS NOT DISTINCT FROM c.source AND m.measure = c.measure AND m.size > 0
), ordered AS (
  SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS ord,
         target - sum(certain * size) OVER (PARTITION BY source)::DOUBLE AS open
  FROM drawn
)
SELECT doc_id, size, source_size, target,
       (certain + CASE WHEN chance > 0 AND coalesce(sum(CASE WHEN chance > 0 THEN size ELSE 0 END) OVER w, 0) + size / 2 <= open
                       THEN 1 ELSE 0 END) * size AS taken
FROM ordered
WINDOW w AS (PARTITION BY source ORDER BY ord NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""


def op5_pigeonhole_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pigeonhole_join.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op6_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return prefix_forest.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


OP5_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a), least_id AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) AS kept
FROM embeddings v LEFT JOIN counted c ON c.a = v.vec_id LEFT JOIN least_id l ON l.a = v.vec_id
"""


def op7_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    return conversation_digest(chat_format.format_conversations(turns.unionByName(extra)))


def losses(examples: DataFrame) -> DataFrame:
    """Length and digest of each conversation's trainable text, its examples in order; fails on a context that doesn't hold
    the turns it should."""
    starts = F.regexp_count("context", F.lit(chat_format.START.replace("|", r"\|")))
    header = F.endswith("context", F.lit(f"{chat_format.START}{chat_format.TRAINABLE}\n"))
    reply = F.when(header & (starts == F.col("context_turns") + 1), F.col("reply")).otherwise(F.raise_error(F.lit("a context lacks turns")))
    each = examples.select("conv_id", F.struct("example", reply.alias("reply")).alias("e"))
    loss = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: chat_format.unescape(e["reply"])), "")
    return each.groupBy("conv_id").agg(loss.alias("loss")).select("conv_id", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"))


def conversation_digest(formatted: DataFrame) -> DataFrame:
    # both sides are digests when they meet, so no text is moved again
    trained = losses(chat_format.expand_targets(formatted)).withColumnRenamed("conv_id", "of")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = chat_format.read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), "formatted_chars"
    )
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return back.join(trained, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.coalesce("loss_chars", F.lit(0).cast("long")).alias("loss_chars"),
        F.coalesce("loss_sha256", nothing).alias("loss_sha256"),
        "formatted_chars",
    )


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), escaped AS (
  SELECT *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n|'))
            + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op9_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=0.85)


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_chars = F.when(_crc("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    proved = merkle_manifest.manifest(table(spark, sf_dir, "documents"), {"n_chars": n_chars})
    root = merkle_manifest.folded(F.col("now"), F.col("path"))
    found = proved.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = """
WITH RECURSIVE bits AS (
  SELECT doc_id, doc_id::VARCHAR AS s, 0 AS i, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, s, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT doc_id, s, i, CASE WHEN i % 8 = 0 THEN xor(c, ascii(s[i // 8 + 1])::BIGINT) ELSE c END AS x FROM bits WHERE i < 8 * length(s))
), crcs AS (SELECT doc_id, xor(c, 4294967295::BIGINT) AS crc FROM bits WHERE i = 8 * length(s)
), texts AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail, n_chars,
         n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS changed
  FROM documents LEFT JOIN crcs USING (doc_id)
), hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(changed::VARCHAR) || ':' || changed::VARCHAR, '-') || tail) AS now
  FROM texts
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM hashed
), nodes AS (
  SELECT tree, 0 AS level, place, leaf AS node, n FROM numbered
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2
), subroots AS (SELECT tree, node, level AS height, count(*) OVER () AS trees FROM nodes WHERE n = 1
), top AS (
  SELECT 0 AS level, tree AS place, node, trees AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, place // 2
), fold AS (
  SELECT doc_id, tree, place, level, 0 AS part, leaf, now AS node, '' AS proof, 0 AS open_ FROM (SELECT *, 0 AS level FROM numbered)
  UNION ALL
  SELECT f.doc_id, f.tree, CASE WHEN f.part = 0 AND s.height = f.level THEN f.tree ELSE f.place // 2 END,
         CASE WHEN f.part = 0 AND s.height = f.level THEN 0 ELSE f.level + 1 END,
         CASE WHEN f.part = 0 AND s.height = f.level THEN 1 ELSE f.part END, f.leaf,
         CASE WHEN f.part = 0 AND s.height = f.level THEN f.node
              WHEN f.place % 2 = 0 THEN sha256(f.node || coalesce(a.node, b.node, '')) ELSE sha256(coalesce(a.node, b.node, '') || f.node) END,
         f.proof || CASE WHEN f.part = 0 AND s.height = f.level THEN '' ELSE coalesce(a.node, b.node, '') END, 0
  FROM fold f JOIN subroots s USING (tree)
  LEFT JOIN nodes a ON f.part = 0 AND s.height > f.level AND a.tree = f.tree AND a.level = f.level AND a.place = xor(f.place, 1)
  LEFT JOIN top b ON f.part = 1 AND b.level = f.level AND b.place = xor(f.place, 1)
  WHERE f.part = 0 OR f.level < (SELECT max(level) FROM top)
)
SELECT f.doc_id, f.leaf, s.node AS subroot, t.node AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = t.node AS verified
FROM fold f JOIN subroots s USING (tree) JOIN top t ON t.n = 1 WHERE f.part = 1 AND f.level = t.level
"""


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), back="decoded")
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id and text; in every tenth document, by its checksum, the words from some place on repeat with some period."""
    h = _crc("doc_id")
    g = F.floor(h / 10).cast("long")
    words = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)).alias("words"))
    placed = words.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", at(i).cast("int")))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(repeating(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "periodic.*")
    line = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    digests = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("f"), F.sha2(line.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")
    )
    milli = F.expr("(f.less * -1000) div f.period")
    return digests.select("doc_id", "n_runs", "f.start", (-F.col("f.less")).alias("length"), "f.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_best_fit_pack, op3_piece_lm, op4_pareto_mix, op5_pigeonhole_join, op6_prefix_forest, op7_style_tree, op8_prefix_targets, op9_minhash_join, op10_kd_shards, op11_merkle_manifest, op12_byte_bpe, op13_periodic_runs)}
SQL = {"op4_pareto_mix": OP4_SQL, "op5_pigeonhole_join": OP5_SQL, "op8_prefix_targets": OP8_SQL, "op11_merkle_manifest": OP11_SQL}
