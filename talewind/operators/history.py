"""Versions: manifests of files, revision logs with retention and rollback, overlays of operations in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import combined_digest
from ..sources.durable import durable
from .graph import degree


def manifest_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """path, hash, status (new, changed, unchanged), first_seen: ``current`` (path, hash, seen) against ``previous``
    (path, hash, first_seen)."""
    before = previous.select("path", F.col("hash").alias("old"), F.col("first_seen").alias("since"))
    status = F.when(F.col("since").isNull(), "new").when(F.col("old").eqNullSafe(F.col("hash")), "unchanged").otherwise("changed")
    return current.join(before, "path", "left").select("path", "hash", status.alias("status"), F.coalesce("since", "seen").alias("first_seen"))


def revisions(log: DataFrame, key: str, rev: str, body: str) -> DataFrame:
    """The rows of ``log`` that change their key's body; a write of what is there makes no revision."""
    before = F.lag(body).over(W.partitionBy(key).orderBy(rev))
    first = F.row_number().over(W.partitionBy(key).orderBy(rev)) == 1
    return log.withColumn("keep_", first | ~before.eqNullSafe(F.col(body))).filter("keep_").drop("keep_")


def latest(log: DataFrame, key: str, rev: str, body: str) -> DataFrame:
    """key, rev, body of each key's newest revision; combined before the shuffle, so a hot key costs nothing."""
    return log.groupBy(key).agg(F.max(rev).alias(rev), F.max_by(body, rev).alias(body))


def retained(log: DataFrame, rev: str, newest: int) -> DataFrame:
    """The rows whose revision is above the greatest less ``newest``."""
    return log.join(F.broadcast(log.agg((F.max(rev) - newest).alias("floor_"))), F.col(rev) > F.col("floor_")).drop("floor_")  # one row


def rollback(log: DataFrame, key: str, rev: str, body: str, to: int) -> DataFrame:
    """key, body of the new revisions that bring every key back to its body at ``to``: none where nothing differs, and none
    for keys that weren't there then."""
    then = latest(log.filter(F.col(rev) <= to), key, rev, body).select(key, F.col(body).alias("then"))
    now = latest(log, key, rev, body)
    return now.join(then, key).filter(~F.col(body).eqNullSafe(F.col("then"))).select(key, F.col("then").alias(body))


def _lived(nodes: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, made) of the nodes that exist in the end, with the operation that made them last (-1: stored), and their values
    (id, dim, value)."""
    start = nodes.select("id", F.lit(-1).cast("long").alias("seq"), F.lit("create").alias("op"), F.lit(None).cast("string").alias("dim"), F.lit(None).cast("string").alias("value"))
    old = nodes.select("id", F.lit(-1).cast("long").alias("seq"), F.lit("set").alias("op"), F.explode("attrs").alias("dim", "value"))
    log = start.unionByName(old).unionByName(ops.select("id", F.col("seq").cast("long").alias("seq"), "op", "dim", "value"))
    gone = log.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("op") == "delete", F.col("seq"))), F.lit(-2)).alias("gone"))
    alive = log.join(gone, "id").filter("seq > gone")
    made = alive.filter("op = 'create'").groupBy("id").agg(F.min("seq").alias("made"))
    # what was set before the node was made again found no node
    last = alive.filter("op = 'set'").join(made, "id").filter("seq >= made").groupBy("id", "dim").agg(F.max_by("value", "seq").alias("value"))
    return made, last.filter("value IS NOT NULL")


def replay(nodes: DataFrame, ops: DataFrame) -> DataFrame:
    """id, attrs after ``ops`` (seq, id, op, dim, value), in order: ``create`` an absent id, ``set`` a dimension (a null value
    removes it), ``delete`` the node. ``nodes`` has id and attrs (a map).

    Only what comes after a node's last deletion counts, and of each dimension the last value, so no fold over the log is
    needed: a hot node's operations are combined before the shuffle.
    """
    made, values = _lived(nodes, ops)
    return _with_attrs(made.select("id"), values)


def _with_attrs(ids: DataFrame, values: DataFrame) -> DataFrame:
    attrs = values.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dim", "value")))).alias("attrs"))
    return ids.join(attrs, "id", "left").withColumn("attrs", F.coalesce("attrs", F.expr("CAST(map() AS map<string,string>)")))


def replay_log(nodes: DataFrame, edges: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, attrs, degree) and (src, dst, type, strength) after one log of nodes and relations in order.

    ``log`` has seq (each once), kind (``node`` or ``edge``), op, id, dim, value as :func:`replay` takes them, and src, dst, type,
    new_type, strength as :func:`replay_edges` does. A deleted node takes its relations; a relation can be made only while
    both its ends exist, so of its operations those count that come after both ends were made for the last time. Degrees are
    counted anew, a loop counts twice.
    """
    made, values = _lived(nodes, log.filter("kind = 'node'").select("id", "seq", "op", "dim", "value"))
    lives = durable(made)
    stored = edges.select(F.lit(-1).cast("long").alias("seq"), F.lit("create").alias("op"), "src", "dst", "type", F.lit(None).cast("string").alias("new_type"), "strength")
    every = stored.unionByName(log.filter("kind = 'edge'").select(F.col("seq").cast("long").alias("seq"), "op", "src", "dst", "type", "new_type", "strength"))
    end = lambda side: lives.select(F.col("id").alias(side), F.col("made").alias(f"{side}_made"))
    # the log is dealt by its last join's end, which holds a relation's operations together too
    late = every.join(end("dst"), "dst").join(end("src"), "src").filter("seq >= greatest(src_made, dst_made)")
    left = _edges_after(late)
    return _with_attrs(lives.select("id"), values).join(degree(left), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), left


def replay_edges(edges: DataFrame, ops: DataFrame, alive: DataFrame, deletions: DataFrame) -> DataFrame:
    """src, dst, type, strength after ``ops`` (seq, op, src, dst, type, new_type, strength) in order: ``create``, ``update`` (a
    null keeps what is there), ``delete``. ``edges`` has src, dst, type, strength; ``alive`` the ids that exist in the end,
    ``deletions`` (id, seq) when nodes were deleted, which takes their edges then.

    A relation is known by its ends and the type it came with, as operations name it; of each the operations
    before its last deletion, or that of an end, don't count, and of the others the last values do.
    """
    stored = edges.select(F.lit(-1).cast("long").alias("seq"), F.lit("create").alias("op"), "src", "dst", "type", F.lit(None).cast("string").alias("new_type"), "strength")
    log = stored.unionByName(ops.select(F.col("seq").cast("long").alias("seq"), "op", "src", "dst", "type", "new_type", "strength"))
    ends = lambda side: deletions.groupBy(F.col("id").alias(side)).agg(F.max("seq").alias(f"{side}_gone"))
    known = log.join(ends("src"), "src", "left").join(ends("dst"), "dst", "left")
    late = known.filter(F.col("seq") > F.greatest(F.coalesce("src_gone", F.lit(-2)), F.coalesce("dst_gone", F.lit(-2))))
    ids = lambda side: alive.select(F.col("id").alias(side)).distinct()
    return _edges_after(late.join(ids("src"), "src", "left_semi").join(ids("dst"), "dst", "left_semi"))


def _edges_after(log: DataFrame) -> DataFrame:
    """The relations that a log of operations leaves, of each the last values."""
    key = ("src", "dst", "type")
    each = W.partitionBy(*key)  # one deal of the log; a relation's operations spill where they are many
    open_ = log.withColumn("gone", F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(each)).filter("gone IS NULL OR seq > gone")
    valid = open_.withColumn("made", F.min(F.when(F.col("op") == "create", F.col("seq"))).over(each)).filter("seq >= made AND (op <> 'create' OR seq = made)")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    values = valid.groupBy(*key).agg(last("new_type").alias("new_type"), last("strength").alias("strength"))
    return values.select("src", "dst", F.coalesce("new_type", "type").alias("type"), "strength")


def folder_digests(entries: DataFrame, folder: str, name: str, digest: str, most: int = 4096) -> DataFrame:
    """folder, n, digest: one digest of each folder's entries, whatever their order.

    Up to ``most`` entries it is :func:`talewind.functions.text.combined_digest` of them. A folder with more is dealt into a power of
    two of blocks by its names' digests, until a block has no more than ``most`` on average; the blocks' digests, named by
    their numbers, take the place of the entries, so no folder is ever one array. Repeated entries count as often as they stand;
    a null digest or name is empty text.
    """
    none = F.lit("")
    rows = entries.select(F.col(folder).alias("f_"), F.coalesce(F.col(name).cast("string"), none).alias("name"), F.coalesce(digest, none).alias("digest"))
    sizes = durable(rows.groupBy("f_").agg(F.count("*").alias("n")))
    counts = sizes.withColumn("left_", F.col("n"))
    bits = lambda c: F.when(F.col(c) <= most, 0).otherwise(F.ceil(F.log2(F.col(c) / most))).cast("int")
    while (counts.agg(F.max("left_")).first()[0] or 0) > most:
        dealt = rows.join(counts.select(F.col("f_").alias("g_"), bits("left_").alias("bits_")), F.col("f_").eqNullSafe(F.col("g_")))
        block = F.conv(F.substring(F.sha2("name", 256), 1, 8), 16, 10).cast("long") % F.expr("shiftleft(1L, bits_)")
        whole = dealt.filter("bits_ = 0").select("f_", "name", "digest")
        parts = dealt.filter("bits_ > 0").groupBy("f_", block.alias("block_")).agg(combined_digest(F.collect_list(F.struct("name", "digest"))).alias("digest"))
        rows = durable(whole.unionByName(parts.select("f_", F.col("block_").cast("string").alias("name"), "digest")))
        counts = rows.groupBy("f_").agg(F.count("*").alias("left_"))
    one = rows.groupBy("f_").agg(combined_digest(F.collect_list(F.struct("name", "digest"))).alias("digest"))
    return sizes.join(one.withColumnRenamed("f_", "g_"), F.col("f_").eqNullSafe(F.col("g_"))).select(F.col("f_").alias(folder), "n", "digest")
