"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talewind.sources.durable import durable, shared_folder

__all__ = ["HOT", "WORD", "durable", "held_out", "join_counted", "shared_folder", "table", "text_group", "word_count"]

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of ``text`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: A key with more than this part of all rows is hot, so there are fewer hot keys than this.
HOT = 512


def join_counted(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with the one row of ``facts`` for their key; ``n`` there is how many of the ``total`` rows have it.

    The facts are computed once, and which keys are hot is asked once; where none is, this is a plain join. Else rows of hot keys
    stay where they lie and meet a broadcast of fewer than ``HOT`` facts; all others are dealt by key. Null keys join with nothing.
    """
    facts = durable(facts)
    hot = [r[0] for r in facts.filter((F.col("n") * HOT > F.lit(total)) & F.col(key).isNotNull()).select(key).collect()]  # fewer than HOT
    if not hot:
        return rows.join(facts, key)
    is_hot = F.col(key).isin(hot)
    return rows.filter(is_hot).join(F.broadcast(facts.filter(is_hot)), key).unionByName(rows.filter(~is_hot).join(facts.filter(~is_hot), key))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text has remainder 2 by 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def text_group(text: Column) -> Column:
    """Key that equal texts share: a 128-bit digest (null and empty text are one group)."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))
