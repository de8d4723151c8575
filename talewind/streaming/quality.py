"""The quality filter as one stream: leaks by their text alone, repeats by the last kept text of a key, nothing lost silently."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.quality import KEPT, LEAK, REPEAT
from ..operators.search import is_leak

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastKept(StatefulProcessor):
    """The text a key kept last."""

    def __init__(self, order: str, text: str, expires_ms: int | None):
        self.order, self.text, self.expires_ms = order, text, expires_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("text", StringType())]), self.expires_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        told = []
        for leak, text in zip(batch["leak_"], batch[self.text], strict=True):
            said = text if isinstance(text, str) else ""
            told.append(LEAK if leak else REPEAT if said and said == last else KEPT)
            last = said if told[-1] == KEPT else last
        if last is not None:
            self.last.update((last,))
        yield batch.drop(columns="leak_").assign(outcome=told)

    def close(self) -> None:
        pass


def told_lines(stream: DataFrame, key: str, order: str, text: str, prompt: str, threshold: float = 0.8, expires_ms: int | None = None) -> DataFrame:
    """Every row of a stream with outcome, as :func:`talewind.operators.quality.outcomes` tells it, in one pass.

    A key's rows are taken in ``order`` inside a batch, and batches as they come. The state is one text for each key; with
    ``expires_ms`` it goes when a key was silent for so long. What a key sends in one batch is held by one task, so the source's
    limit for a batch (``maxFilesPerTrigger``) bounds the memory.
    """
    leaks = stream.withColumn("leak_", F.coalesce(is_leak(F.col(text), prompt, threshold), F.lit(False)))
    schema = StructType([*stream.schema.fields, StructField("outcome", StringType())])
    return leaks.groupBy(key).transformWithStateInPandas(_LastKept(order, text, expires_ms), schema, "Append", "None" if expires_ms is None else "ProcessingTime")


def write_told(stream: DataFrame, folder: str, checkpoint: str, **filtering) -> StreamingQuery:
    """Starts the filter over what is there and writes it to ``folder``/batch=N/outcome=...: kept lines beside those dropped.

    A batch that runs again after a lost job replaces its own folder, so no line is written twice. The state lies in RocksDB.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)

    def written(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").partitionBy("outcome").parquet(f"{folder}/batch={no}")

    return told_lines(stream, **filtering).writeStream.foreachBatch(written).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
