"""Positions and running sums in an order, whatever the groups' sizes: no window ever holds a whole group.

Rows are dealt by ranges of (group, order), sorted and cut from their lineage, so that every row's partition and place are
fixed. What a partition holds of a group is one row of counts; sums over these (as many for a group as it has partitions) say
what lies before a partition, the place inside it says the rest. A value that is shared by many rows is dealt over several
partitions too, as the rows' own places are the last part of the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.durable import durable

#: Bits of a row's number inside its partition.
_INSIDE = 33


def _dealt(rows: DataFrame, order: Sequence[str | Column], within: Sequence[str]) -> DataFrame:
    """``rows`` in order with at_ (rises with the order) and part_ (the partition)."""
    numbered = rows.withColumn("tie_", F.monotonically_increasing_id())
    keys = [*within, *order, "tie_"]
    placed = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at_", F.monotonically_increasing_id()).drop("tie_")
    return durable(placed).withColumn("part_", F.shiftright("at_", _INSIDE))


def _with_parts(dealt: DataFrame, parts: DataFrame, within: Sequence[str]) -> DataFrame:
    of = parts.withColumnsRenamed({c: f"{c}_of" for c in ("part_", *within)})
    same = dealt["part_"] == of["part__of"]
    for c in within:
        same = same & dealt[c].eqNullSafe(of[f"{c}_of"])
    return dealt.join(of, same).drop("part__of", *[f"{c}_of" for c in within])


def placed(rows: DataFrame, order: Sequence[str | Column], within: Sequence[str] = (), position: str = "position", size: str = "size") -> DataFrame:
    """``rows`` with their ``position`` (from 0) in their group and its ``size``.

    Groups are told by the columns ``within`` (null is a value; none: all rows are one group), ``order`` is columns or sort
    expressions. Rows that tie are numbered in any order, so an order that tells rows apart gives the same numbers in every run.
    An empty table gives none. The names tie_, at_, part_, first_, n_, before_ are used inside.
    """
    dealt = _dealt(rows, order, within)
    counts = dealt.groupBy("part_", *within).agg(F.count("*").alias("n_"), F.min("at_").alias("first_"))
    group = W.partitionBy(*(within or [F.lit(0)]))
    before = F.coalesce(F.sum("n_").over(group.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = counts.select("part_", *within, "first_", before.alias("before_"), F.sum("n_").over(group).alias(size))
    return _with_parts(dealt, parts, within).withColumn(position, F.col("at_") - F.col("first_") + F.col("before_")).drop("at_", "part_", "first_", "before_")


def summed_before(rows: DataFrame, value: str, order: Sequence[str | Column], within: Sequence[str] = (), name: str = "before") -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before each in its group (0 for the first; nulls add nothing).

    As :func:`placed` otherwise. The rows of a group that one partition holds are summed by a window, which spills.
    """
    dealt = _dealt(rows, order, within)
    whole = dealt.groupBy("part_", *within).agg(F.coalesce(F.sum(value), F.lit(0)).alias("n_"))
    earlier = W.partitionBy(*(within or [F.lit(0)])).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    parts = whole.select("part_", *within, F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("part_", *within).orderBy("at_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return _with_parts(dealt.withColumn("inside_", inside), parts, within).withColumn(name, F.col("before_") + F.col("inside_")).drop("at_", "part_", "before_", "inside_")


def last_before(rows: DataFrame, value: Column, own: str, order: Sequence[str | Column], within: Sequence[str] = (), name: str = "before") -> DataFrame:
    """``rows`` with ``value`` as ``own`` and, as ``name``, the last value that isn't null before each in its group (null: none is).

    As :func:`placed` otherwise; the value is computed where the rows were dealt to. A partition's first rows of a group take the
    last value of the partitions before that hold the group; that is one row for each of a group's partitions.
    """
    dealt = _dealt(rows, order, within).withColumn(own, value)
    last = dealt.groupBy("part_", *within).agg(F.max_by(own, F.when(F.col(own).isNotNull(), F.col("at_"))).alias("last_"))
    earlier = F.last("last_", True).over(W.partitionBy(*(within or [F.lit(0)])).orderBy("part_").rowsBetween(W.unboundedPreceding, -1))
    parts = last.select("part_", *within, earlier.alias("before_"))
    inside = F.last(own, True).over(W.partitionBy("part_", *within).orderBy("at_").rowsBetween(W.unboundedPreceding, -1))
    met = _with_parts(dealt.withColumn("inside_", inside), parts, within)
    return met.withColumn(name, F.coalesce("inside_", "before_")).drop("at_", "part_", "before_", "inside_")
