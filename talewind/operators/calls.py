"""A function from outside, mapped over rows: what fails is tried again, what fails for good is a row, not the end of a job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def called(
    rows: DataFrame, value: str, work: Callable[[str, int], str], retries: int = 2, retried: tuple[type[Exception], ...] = (Exception,),
    most_chars: int | None = None, refused: Callable[[str], bool] | None = None, threads: int = 1,
) -> DataFrame:
    """``rows`` with result, error and attempts of ``work(value, attempt)``, attempts counted from 1.

    An error among ``retried`` is tried again up to ``retries`` times, any other isn't. A value of more than ``most_chars``
    characters is an error without an attempt, an empty result or one that ``refused`` says is junk an error without
    another. Results are trimmed. A null value is given as empty text. Rows keep their order in a partition; ``threads`` calls of a task wait
    side by side. Every use of the frame calls again, so write it first; :func:`left_over` leaves out what is written. Input
    columns named result, error or attempts are refused.
    """
    if clash := {"result", "error", "attempts"} & set(rows.columns):
        raise ValueError(f"rows already have {sorted(clash)}")

    def one(text: str | None) -> tuple[str | None, str | None, int]:
        given = text if isinstance(text, str) else ""
        if most_chars is not None and len(given) > most_chars:
            return None, f"ValueError: {len(given)} characters are more than {most_chars}", 0
        for attempt in range(1, retries + 2):
            try:
                got = (work(given, attempt) or "").strip()
            except Exception as e:  # noqa: BLE001
                if isinstance(e, retried) and attempt <= retries:
                    continue
                return None, f"{type(e).__name__}: {e}", attempt
            if not got or (refused is not None and refused(got)):
                return None, f"ValueError: the result is no answer: {got[:80]!r}", attempt
            return got, None, attempt
        raise AssertionError("unreachable")

    def mapped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for part in parts:
                told = list(pool.map(one, part[value])) if threads > 1 else [one(x) for x in part[value]]
                result, error, attempts = zip(*told, strict=True) if told else ((), (), ())
                yield part.assign(result=pd.Series(result, part.index, object), error=pd.Series(error, part.index, object), attempts=pd.Series(attempts, part.index, "int32"))

    schema = StructType([*rows.schema.fields, StructField("result", StringType()), StructField("error", StringType()), StructField("attempts", IntegerType())])
    return rows.mapInPandas(mapped, schema)


def left_over(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key has no result in ``done`` (key, result) yet; those with an error come again, as do null keys."""
    return rows.join(done.filter("result IS NOT NULL").select(key).distinct(), key, "left_anti")
