"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words by weight, at most ``MOST`` times its own words. Inside a source a document's expected
copies grow with its measure (8 plus the binary digits of its size), at most ``MOST``; the whole part is taken for
certain, and one more copy goes to documents in Pareto order: the random odds u/(1-u) divided by the odds of the wanted
fraction, smallest first, until the source's words come nearest to what is still open. Random numbers come from a digest
of the id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable, word_count

MOST = 3
SEED = "mix"
#: Words are summed over steps of the order first: about so many rows in one, at least so many steps. Only the speed depends
#: on them.
_STEP_ROWS, _LEAST_STEPS = 10_000, 1024


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1 that only the id and the seed decide."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def fill(parts: DataFrame, by: list[str], name: str, weight: str, cap: str, total: str, out: str) -> DataFrame:
    """Shares of ``total`` in proportion to ``weight``, none above ``cap``, the excess reshared by weight.

    In the order of cap / weight the full parts come first; the first that isn't full tells the level of all others.
    """
    whole = W.partitionBy(*by, F.lit(0))
    order = whole.orderBy(F.col(cap) / F.col(weight), F.col(name).asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col(total) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0)))
    found = F.min(F.when(F.col("level") <= F.col(cap) / F.col(weight), F.struct("place", "level"))).over(whole)["level"]
    share = F.coalesce(F.least(F.col(cap).cast("double"), found * F.col(weight)), F.col(cap).cast("double"))
    return parts.withColumns({"level": level, "place": F.row_number().over(order)}).withColumn(out, share).drop("level", "place")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: weights 1, 2, 3, 1, ... in the order of the sources' code points, null last."""
    everything = W.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source",
        "source_size",
        (place % 3 + 1).cast("long").alias("weight"),
        (F.col("source_size") * MOST).alias("most"),
        F.sum("source_size").over(everything).alias("total"),
    )
    return fill(weighed, [], "source", "weight", "most", "total", "target").select("source", "source_size", "target")


def expected_copies(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, measure, copies: the expected copies of a document, so that the source's words meet its target."""
    parts = (
        sizes.groupBy("source", "measure")
        .agg(F.sum("size").alias("words"))
        .filter("words > 0")
        .join(targets.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")))
        .select("source", "measure", "words", "target", (F.col("words") * F.col("measure")).alias("weight"), (F.col("words") * MOST).alias("most"))
    )
    return fill(parts, ["source"], "measure", "weight", "most", "target", "share").select(
        "source", "measure", F.least(F.col("share") / F.col("words"), F.lit(float(MOST))).alias("copies")
    )


def mix(docs: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies (0 to 3) of every row, and the columns named in ``kept``.

    Null or empty texts have size 0 and no copies; null is a source of its own; rows that repeat a doc_id share its random
    number and are ordered by size; a table without rows gives none, one without words targets of 0. Other columns are
    ignored.
    """
    sizes = durable(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *kept).withColumn("measure", (F.length(F.bin("size")) + 8).cast("long"))
    )
    targets = source_targets(sizes)
    copies = expected_copies(sizes, targets)
    to = targets.withColumnRenamed("source", "source_")
    per = copies.withColumnsRenamed({"source": "source__", "measure": "measure_"})
    drawn = (
        sizes.join(to, F.col("source").eqNullSafe(F.col("source_")))
        .join(per, F.col("source").eqNullSafe(F.col("source__")) & (F.col("measure") == F.col("measure_")), "left")
        .drop("source_", "source__", "measure_", "measure")
        .withColumn("copies", F.when(F.col("size") > 0, F.coalesce("copies", F.lit(0.0))).otherwise(0.0))
        .withColumn("certain", F.floor("copies").cast("long"))
        .withColumn("chance", F.col("copies") - F.col("certain"))
    )
    u = uniform(F.col("doc_id"))
    odds = (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))
    drawn = drawn.withColumn("order", F.when(F.col("chance") > 0, odds))
    # bins by the logarithm, so that words before a document are summed over bins first and inside its bin then
    steps = max(_LEAST_STEPS, -(-sizes.count() // _STEP_ROWS))
    bin_ = F.least(F.greatest(F.floor((F.log("order") + 40) / 80 * steps), F.lit(0)), F.lit(steps - 1)).cast("int")
    drawn = durable(drawn.withColumn("bin", F.when(F.col("chance") > 0, bin_)))
    open_words = drawn.groupBy("source").agg((F.max("target") - F.sum(F.col("certain") * F.col("size"))).alias("open"))
    earlier = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = (
        drawn.filter("bin IS NOT NULL")
        .groupBy("source", "bin")
        .agg(F.sum("size").alias("words"))
        .select("source", "bin", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before_bin"))
    )
    start = (
        bins.join(open_words.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")))
        .select(F.col("source").alias("source_"), F.col("bin").alias("bin_"), "open", "before_bin")
    )
    inside = W.partitionBy("source", "bin").orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    more = F.col("before_bin") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2 <= F.col("open")
    return (
        drawn.join(start, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bin") == F.col("bin_")), "left")
        .withColumn("one_more", F.when(F.col("bin").isNotNull() & more, 1).otherwise(0))
        .select("doc_id", "size", "source_size", "target", (F.col("certain") + F.col("one_more")).cast("long").alias("copies"), *kept)
    )
