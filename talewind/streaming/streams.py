"""Structured Streaming forms: tumbling counts with watermarks, and per-key state for what no window says."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType


def windowed_counts(stream: DataFrame, ts: str, key: str, window: str, late: str) -> DataFrame:
    """window_start, key, n of tumbling windows; rows later than ``late`` behind the newest are left out."""
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), key, "n")


def distinct_lines(stream: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Rows of a stream whose text is empty or differs from the last accepted one of their key; a key's rows are taken in
    ``order`` inside a batch. The state is one text for each key."""

    def step(_key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        keep = []
        for t in rows[text]:
            keep.append(not t or t != last)
            last = t if keep[-1] else last
        state.update((last,))
        yield rows[keep]

    return stream.groupBy(key).applyInPandasWithState(step, stream.schema, "last string", "append", GroupStateTimeout.NoTimeout)


def accepted_hits(stream: DataFrame, key: str, ts: str, window_s: float, limit: int) -> DataFrame:
    """Rows of a stream with accepted: refused if ``limit`` accepted ones lie within the last ``window_s`` seconds. The state
    is at most ``limit`` times for each key."""

    def step(_key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(ts, kind="stable")
        out = []
        for t in rows[ts]:
            recent = [x for x in recent if t - x < window_s]
            out.append(len(recent) < limit)
            if out[-1]:
                recent.append(float(t))
        state.update((recent,))
        yield rows.assign(accepted=out)

    schema = StructType([*stream.schema.fields, StructField("accepted", BooleanType())])
    return stream.groupBy(key).applyInPandasWithState(step, schema, "recent array<double>", "append", GroupStateTimeout.NoTimeout)
