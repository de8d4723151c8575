"""Cutting ordered streams into segments; the recurrences that no window frame says run as a fold over sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from .ordered import summed_before


def drop_repeats(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Lines that are empty or differ from the line before; those dropped equal the last kept, so one lag tells."""
    before = F.lag(text).over(W.partitionBy(key).orderBy(order))
    return lines.withColumn("before", before).filter((F.length(text) == 0) | F.col("before").isNull() | (F.col(text) != F.col("before"))).drop("before")


def tumbling(rows: DataFrame, key: str, start: str, end: str, window_s: int, most: int, order: list[str]) -> DataFrame:
    """key, win, chunk, n, first_start, last_end: windows of ``window_s`` cut into at most ``most`` lines; the end is the last
    line's, not the greatest."""
    win = F.floor(F.col(start) / window_s)
    at = F.row_number().over(W.partitionBy(key, "win").orderBy(start, *order))
    cut = rows.withColumn("win", win).withColumn("chunk", F.floor((at - 1) / most))
    by = F.struct(start, *order)
    return cut.groupBy(key, "win", "chunk").agg(F.count("*").alias("n"), F.min_by(start, by).alias("first_start"), F.max_by(end, by).alias("last_end"))


def carried(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``value`` of the last row that had one; null before the first."""
    frame = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(frame))


def folded(rows: DataFrame, key: str, order: list[str], needs: list[str], field: StructField, start: Callable[[], list], step: Callable) -> DataFrame:
    """``rows`` with ``field``: what ``step(state, *needs)`` returns for each row of a key in order, with a state of its own.

    Rows are dealt by key, sorted by Spark (which spills) and read in batches; only the state is carried from one batch to the
    next, so a key of any size runs in bounded memory.
    """
    kind = to_arrow_type(field.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            out = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *needs)), strict=True):
                if k != last:
                    last, state = k, start()
                out.append(step(state, *values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, field.name])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, StructType([*rows.schema.fields, field]))


def bin_consecutive(counts: DataFrame, key: str, order: str, n: str, most: int) -> DataFrame:
    """``counts`` with bin: consecutive rows of a key share a bin while their sum stays within ``most``; a row above it
    stands alone."""

    def step(state: list, size: int) -> int:
        if state[1] and state[1] + size > most:
            state[0], state[1] = state[0] + 1, 0
        state[1] += size
        return state[0]

    rows = counts.select(key, order, n)
    return folded(rows, key, [order], [n], StructField("bin", IntegerType()), lambda: [0, 0], step)


def date_segments(counts: DataFrame, key: str, order: str, n: str, merge: int, most: int) -> DataFrame:
    """key, order, segment, from_line, n: consecutive rows (dates with their numbers of lines) share a segment while their sum
    stays within ``merge`` and ``most`` (merge 0: none do); a segment above ``most`` is cut, and its rest goes on absorbing."""
    limit = min(merge, most)

    def step(state: list, size: int) -> list[dict]:
        at = 1
        out = []
        if state[1] and state[1] + size > limit:
            state[0], state[1] = state[0] + 1, 0
        while state[1] + size > most:
            part = most - state[1]
            out.append({"segment": state[0], "from_line": at, "n": part})
            state[0], state[1], size, at = state[0] + 1, 0, size - part, at + part
        state[1] += size
        out.append({"segment": state[0], "from_line": at, "n": size})
        return out

    piece = StructType([StructField("segment", IntegerType()), StructField("from_line", LongType()), StructField("n", LongType())])
    cut = folded(counts.filter(F.col(n) > 0).select(key, order, n), key, [order], [n], StructField("pieces", ArrayType(piece)), lambda: [0, 0], step)
    return cut.select(key, order, F.explode("pieces").alias("p")).select(key, order, "p.*")


def batches(rows: DataFrame, key: str, start: str, end: str, cap: float, span: float, gap: float) -> DataFrame:
    """``rows`` (key, start, end) with batch: a row opens a new one when speech would exceed ``cap``, the time from the
    batch's start to the row's end ``span``, or the silence before it ``gap``."""

    def step(state: list, s: float, e: float) -> int:
        batch, first, last, speech = state
        if batch < 0 or speech + (e - s) > cap or e - first > span or s - last > gap:
            batch, first, speech = batch + 1, s, 0.0
        state[:] = batch, first, e, speech + (e - s)
        return batch

    return folded(rows, key, [start, end], [start, end], StructField("batch", IntegerType()), lambda: [-1, 0.0, 0.0, 0.0], step)


def accepted_hits(hits: DataFrame, key: str, ts: str, order: str, window_s: float, limit: int) -> DataFrame:
    """``hits`` with accepted: a hit is refused if ``limit`` accepted ones lie within the last ``window_s`` seconds."""

    def step(recent: list, t: float) -> bool:
        recent[:] = [x for x in recent if t - x < window_s]
        if len(recent) < limit:
            recent.append(t)
            return True
        return False

    return folded(hits, key, [ts, order], [ts], StructField("accepted", BooleanType()), list, step)


def joined_timeline(lines: DataFrame, files: DataFrame) -> DataFrame:
    """file_ord, no, start_s, end_s, body, shifted: lines on one time axis. ``lines`` (file_ord, no, start_s, end_s, body; no times
    where a line has no stamp), ``files`` (file_ord) all files.

    A timed file begins where the timed files before it end (the end of their last stamped lines); its lines without a stamp
    are left out. A file without any stamp keeps its lines.
    """
    ends = lines.filter("start_s IS NOT NULL").groupBy("file_ord").agg(F.max_by("end_s", "no").alias("last_end"))
    every = summed_before(files.select("file_ord").distinct().join(ends, "file_ord", "left"), "last_end", ["file_ord"], name="offset")
    offsets = every.select("file_ord", F.col("last_end").isNotNull().alias("timed"), F.col("offset").cast("double").alias("offset"))
    placed = lines.join(offsets, "file_ord").filter(~F.col("timed") | F.col("start_s").isNotNull())
    return placed.select("file_ord", "no", (F.col("start_s") + F.col("offset")).alias("start_s"), (F.col("end_s") + F.col("offset")).alias("end_s"), "body", (F.col("timed") & (F.col("offset") > 0)).alias("shifted"))
