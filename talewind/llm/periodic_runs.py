"""Periodic runs of words by bit-parallel lags.

A text's words are numbered, and each bit of the numbers is one long integer over the text (a bit plane). For a lag the planes
are XORed with themselves shifted, and the mismatches ORed: a stretch of zeros of length L is a run of L + lag words that
repeat at that lag. ANDs of shifted copies, each shift twice the last, leave only stretches of the length asked, so most lags
end after a few operations on a plane or two; only where something is left are the other planes taken. A run is told by the
least of its periods: as a run holds four periods, any smaller one divides it and has been seen as the very same stretch.

In long texts a lag from ``THIN`` on is looked at only if every ``lag // 8``-th place of some stretch of the length asked
matches and one of these isn't explained by a run found before. No run is lost: its places all match, and runs of smaller
periods that divide the lag overlap it, or one another, by less than the sum of two periods, so between the places that they
explain a sixth of the lag stays open. A text of n words so costs about n log n, not n * n.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: A run has so many words at least, and so many periods.
LEAST, PERIODS = 6, 4
#: Planes that are compared before the first look.
FIRST = 2
#: Lags, and words of a text, from which on a few places are compared first.
THIN, LONG = 64, 1 << 16
_WORDS = re.compile(WORD)
_GRID = 8


def bit_planes(words: Sequence[str]) -> tuple[list[int], np.ndarray]:
    """The planes of the words' numbers, low bit first, and the numbers."""
    known: dict[str, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    bits = max(1, (len(known) - 1).bit_length())
    packed = np.packbits((numbers[None] >> np.arange(bits)[:, None] & 1).astype(np.uint8), axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed], numbers


def long_stretches(ones: int, least: int) -> int:
    """The bits at which ``least`` ones or more in a row begin."""
    have = 1
    while have < least and ones:
        step = min(have, least - have)
        ones &= ones >> step
        have += step
    return ones


def places(bits: int, size: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little"))


def thinly(numbers: np.ndarray, lag: int, least: int, known: np.ndarray) -> bool:
    """Whether some stretch of ``least`` places may match at ``lag`` that isn't one of the ``known`` runs, by every
    ``lag // 8``-th place."""
    step = lag // _GRID
    some = numbers[: len(numbers) - lag : step] == numbers[lag::step][: -(-(len(numbers) - lag) // step)]
    misses = np.concatenate(([-1], np.flatnonzero(~some), [len(some)]))
    long = np.diff(misses) > least // step  # so many places of the grid lie in any such stretch
    if not long.any():
        return False
    start, length, period = known
    of = lag % period == 0
    edge = np.zeros(len(some) + 1, np.int64)
    np.add.at(edge, -(-start[of] // step), 1)
    np.add.at(edge, -(-(start + length - lag)[of] // step), -1)
    open_ = np.append(0, np.cumsum(some & (np.cumsum(edge[:-1]) == 0)))
    return bool((long & (open_[misses[1:]] > open_[misses[:-1] + 1])).any())


def runs(words: Sequence[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    n, found, seen = len(words), [], set()
    if n < LEAST:
        return []
    planes, numbers = bit_planes(words)
    full, known, taken = (1 << n) - 1, np.zeros((3, 0), np.int64), 0
    for lag in range(1, n // PERIODS + 1):
        least = max(LEAST - lag, (PERIODS - 1) * lag)
        if lag >= THIN and n >= LONG:
            if len(found) > taken:
                known, taken = np.hstack([known, np.array(found[taken:], np.int64).T]), len(found)
            if known.size:
                known = known[:, known[1] > lag]
            if not thinly(numbers, lag, least, known):
                continue
        within, differ, left = full >> lag, 0, 0
        for some in (planes[:FIRST], planes[FIRST:]):
            for plane in some:
                differ |= plane ^ plane >> lag
            if not (left := long_stretches(within & ~differ, least)):
                break
        if left:
            first, last = places(left & ~(left << 1), n), places(left & ~(left >> 1), n)
            for start, end in zip(first.tolist(), last.tolist(), strict=True):
                if (start, length := end - start + least + lag) not in seen:
                    seen.add((start, length))
                    found.append((start, length, lag))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence[str], found: Sequence[tuple[int, int, int]]) -> str:
    """The words without those that a run holds after its first period, joined by single spaces."""
    if not found:
        return " ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    start, length, period = np.array(found).T
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return " ".join(words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist())


def find_runs(docs: DataFrame, text: str = "text", name: str = "periodic") -> DataFrame:
    """``docs`` and a struct ``name``: runs (array of start, length, period; by start and period) and collapsed (the text without
    what repeats).

    A run is a stretch of consecutive words with a smallest period q that has at least 6 words and 4 q, and that no neighbouring
    word extends keeping the period. A null or empty text has no runs and collapses to the empty text. Texts are read whole,
    each by itself; repeated rows fare alike; an empty table gives none. Other columns are kept; ``name`` must be a new one.
    """
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")

    @F.pandas_udf("runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def searched(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found, rest = [], []
            for t in part:
                words = _WORDS.findall(t or "")
                every = runs(words)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in every])
                rest.append(collapsed(words, every))
            yield pd.DataFrame({"runs": pd.Series(found, dtype=object), "collapsed": pd.Series(rest, dtype=object)})

    return docs.withColumn(name, searched(text))
