"""The driver's tables, and the archive that stands on them: parts are entities, consecutive order lines relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import packed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, groups, tag, price."""
    tags = F.array(*[F.lit(t) for t in ("PC", "NPC", "BOSS", "KP")])
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey")).alias("id"),
        F.col("p_name").alias("name"),
        F.array("p_brand", "p_type").alias("groups"),
        F.element_at(tags, (F.col("p_size") % 4 + 1).cast("int")).alias("tag"),
        F.col("p_retailprice").alias("price"),
    )


#: Rows of one task where a table is dealt by its size.
TASK_ROWS = 250_000


def tasks(rows: DataFrame, most: int | None = None) -> int:
    """How many tasks a stored table (its files tell the number of rows) is dealt to, with so many rows each (``TASK_ROWS``)."""
    return -(-max(rows.count(), 1) // (most or TASK_ROWS))


#: Texts of one task: a stored file may be a single group of rows, which Spark reads in one task.
TASK_TEXTS = 5_000


def dealt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text of the documents, dealt to tasks for work that reads every character."""
    stored = table(spark, sf_dir, "documents").select("doc_id", "text")
    return stored.repartition(tasks(stored, TASK_TEXTS), "doc_id")


def edge_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks :func:`edges` are dealt to."""
    return tasks(table(spark, sf_dir, "lineitem"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, type, strength (3 strong, 2 medium, 1 weak), event_ord: one row per (src, dst, type).

    Lines and relations are dealt to tasks by their number, so what one task sorts and holds doesn't grow with the table.
    """
    line = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    stored = table(spark, sf_dir, "lineitem")
    n = tasks(stored)
    lines = (
        stored.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
        .repartition(n, "l_orderkey")
        .select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", F.lead("l_partkey").over(line).alias("next"))
    )
    strength = F.when(F.max("l_quantity") >= 50, 3).when(F.max("l_quantity") >= 49, 2).otherwise(1)
    return (
        lines.filter("next IS NOT NULL")
        .repartition(n, "l_partkey", "next", "l_returnflag")  # few lines share a relation, so none are combined before
        .groupBy("l_partkey", "next", "l_returnflag")
        .agg(strength.alias("strength"), F.min("l_orderkey").alias("event_ord"))
        .select(F.concat(F.lit("P"), F.col("l_partkey")).alias("src"), F.concat(F.lit("P"), F.col("next")).alias("dst"), F.col("l_returnflag").alias("type"), "strength", "event_ord")
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, l_partkey of the lines, as numbers: those of an order in one task, in their order.

    They are dealt packed, and sorted by Spark: an order may have any number of lines.
    """
    names = ["l_orderkey", "l_linenumber", "l_partkey"]
    n = edge_tasks(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("long").alias(c) for c in names])
    dealt = lines.mapInArrow(lambda rows: packed.sent(rows, n), packed.SENT).repartitionById(n, F.col("task"))
    lines = dealt.mapInArrow(lambda rows: packed.received(rows, names), ", ".join(f"{c} long" for c in names))
    return lines.sortWithinPartitions(*[F.asc_nulls_last(c) for c in names])


def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: of :func:`order_lines`, in a task, the parts of a line and of the next of its order, where both are there and differ.
    They are the relations without their loops, once for each line that makes one."""
    before = None
    for batch in batches:
        order, _, part = batch.columns
        rows = [packed.values(order), order.is_valid().to_numpy(zero_copy_only=False), packed.values(part), part.is_valid().to_numpy(zero_copy_only=False)]
        if before is not None:
            rows = [np.concatenate([x, y]) for x, y in zip(before, rows, strict=True)]
        before = [x[-1:] for x in rows]
        o, o_there, p, p_there = rows
        follow = (o[1:] == o[:-1]) & (o_there[1:] == o_there[:-1]) & p_there[1:] & p_there[:-1] & (p[1:] != p[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(p[:-1][follow]), pa.array(p[1:][follow])], names=["a", "b"])


#: The same tables for an independent engine.
NODES_SQL = """nodes AS (
  SELECT 'P' || p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS ptype, [p_brand, p_type] AS groups,
         (['PC', 'NPC', 'BOSS', 'KP'])[p_size % 4 + 1] AS tag, p_retailprice AS price FROM part)"""
EDGES_SQL = """lines AS (
  SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt FROM lineitem
), edges AS (
  SELECT 'P' || l_partkey AS src, 'P' || nxt AS dst, l_returnflag AS type,
         CASE WHEN max(l_quantity) >= 50 THEN 3 WHEN max(l_quantity) >= 49 THEN 2 ELSE 1 END AS strength, min(l_orderkey) AS event_ord
  FROM lines WHERE nxt IS NOT NULL GROUP BY ALL)"""
