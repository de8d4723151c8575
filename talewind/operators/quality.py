"""What a transcript's quality filter keeps and drops, line by line, and its report for each file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import stamp
from ..sources.durable import durable
from .ordered import last_before
from .search import is_leak

KEPT, LEAK, REPEAT = "kept", "leak", "repeat"


def outcomes(lines: DataFrame, key: str, order: Sequence[str], text: str, prompt: str, threshold: float = 0.8) -> DataFrame:
    """``lines`` with outcome: ``leak`` for a piece of the prompt, ``repeat`` for a text equal to the last kept one of its key,
    else ``kept``.

    A leak doesn't change what was kept last. A repeat equals it, so the line before among those that are no leak tells, and
    no fold is needed. A null text is empty; empty lines are kept and stand between repeats. Lines that tie in ``order`` come
    in any order. An empty table gives none; a null key is a key. said_, line_ and last_kept_ are used inside.
    """
    said = F.coalesce(text, F.lit(""))
    told = F.when(said == "", F.lit(b"")).otherwise(F.unhex(F.sha2(said, 256)))
    leak = F.coalesce(is_leak(F.col(text), prompt, threshold), F.lit(False))
    cut = durable(lines.withColumn("said_", F.when(~leak, told)).withColumn("line_", F.monotonically_increasing_id()))
    # digests alone are put in order; the texts meet what was told of them once
    narrow = last_before(cut.select(*dict.fromkeys([key, *order, "said_", "line_"])), F.col("said_"), "said_", list(order), [key], "last_kept_")
    repeat = (F.col("said_") != F.lit(b"")) & F.col("said_").eqNullSafe(F.col("last_kept_"))
    found = narrow.select("line_", F.when(F.col("said_").isNull(), LEAK).when(repeat, REPEAT).otherwise(KEPT).alias("outcome"))
    return cut.drop("said_").join(found, "line_").drop("line_")


def report(told: DataFrame, key: str, start: str, text: str, heads: int = 5, samples: int = 3) -> DataFrame:
    """key, kept, dropped, prompt_leak, repeat, kept_ratio (four decimals), first_kept (the first ``heads`` lines kept, with their
    stamps) and leak_samples (the first ``samples`` texts of leaks) of ``told`` (:func:`outcomes`).

    ``start`` is the seconds a line starts at; lines that start together are ordered by their texts. The first lines are limited
    before the shuffle, so a file of any length sends a few rows from each task.
    """
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    counts = told.groupBy(key).agg(n(KEPT).alias("kept"), (n(LEAK) + n(REPEAT)).alias("dropped"), n(LEAK).alias("prompt_leak"), n(REPEAT).alias("repeat"), F.bround(n(KEPT) / F.count("*"), 4).alias("kept_ratio"))

    def first(outcome: str, most: int, shown, name: str) -> DataFrame:
        some = told.filter(F.col("outcome") == outcome).select(F.col(key).alias("key_"), F.col(start).alias("start_"), F.coalesce(text, F.lit("")).alias("text_"))
        ranked = some.withColumn("rank_", F.row_number().over(W.partitionBy("key_").orderBy("start_", "text_"))).filter(F.col("rank_") <= most)
        return ranked.withColumn("shown_", shown).groupBy("key_").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_", "shown_"))), lambda x: x["shown_"]).alias(name))

    line = F.concat(F.lit("["), stamp(F.col("start_").cast("double")), F.lit("] "), "text_")
    out = counts
    for few in (first(KEPT, heads, line, "first_kept"), first(LEAK, samples, F.col("text_"), "leak_samples")):
        out = out.join(few, F.col(key).eqNullSafe(F.col("key_")), "left").drop("key_")
    none = F.expr("CAST(array() AS array<string>)")
    return out.withColumns({c: F.coalesce(c, none) for c in ("first_kept", "leak_samples")})
