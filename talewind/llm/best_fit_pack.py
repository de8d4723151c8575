"""Best-fit packing of documents into sequences of several permitted lengths.

A document is its words and one end mark. What is longer than the longest length is cut into pieces of it, so no text is
dropped. Pieces are dealt by a hash of the document into groups of about ``GROUP_TOKENS`` tokens; a group is packed in one
task: longest piece first, into the open bin with the least room that holds it, else into a new bin. A new bin's length is
the one of least cost per token if it were filled from the pieces still to come, largest first, and then downsized. At the
end each bin is downsized to the least length that holds its contents. Opening all bins with one and the same length is
tried as well, and the packing of least total cost is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, word_count

LENGTHS = (512, 1024, 2048, 4096)
GROUP_TOKENS = 2_000_000
#: Tokens that opening a bin costs besides its length (batching, padding to a kernel's tile), and the length at which the
#: attention inside a sequence costs as much again as its tokens.
OPENING, DOUBLE = 16, 65_536


def bin_cost(length: int) -> float:
    return OPENING + length + length * length / DOUBLE


def cheapest_opening(n: int, left: list[int], present: int, lengths: Sequence[int]) -> int:
    """The length of least cost per token for a bin that begins with a piece of ``n`` tokens: filled with the largest pieces
    that fit, ``left[s]`` of size s (bit s of ``present``: there are some), and downsized."""
    best, choice = float("inf"), lengths[-1]
    for i, length in enumerate(lengths):
        if length < n:
            continue
        room, some, taken = length - n, present, 0
        while some := some & ((1 << room + 1) - 1):
            size = some.bit_length() - 1
            many = min(left[size], room // size)
            room -= many * size
            taken += many * size
            some ^= 1 << size
        used = n + taken
        cost = bin_cost(next(x for x in lengths[: i + 1] if x >= used)) / used
        if cost < best:
            best, choice = cost, length
    return choice


def best_fit(sizes: np.ndarray, lengths: Sequence[int], opening: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and bin's length of each piece; ``sizes`` fall. ``opening``: a new bin's length if the piece fits it; None:
    each bin's own least cost."""
    lengths = sorted(lengths)
    rooms: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # bins by the room that is left
    some = 0  # bit r: a bin has room r
    left = np.bincount(sizes, minlength=lengths[-1] + 1).tolist() if opening is None else []
    present = sum(1 << s for s, many in enumerate(left) if many)
    used: list[int] = []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, n in enumerate(sizes.tolist()):
        if opening is None:
            left[n] -= 1
            if not left[n]:
                present ^= 1 << n
        if above := some >> n:
            room = n + (above & -above).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                some ^= 1 << room
        else:
            wanted = cheapest_opening(n, left, present, lengths) if opening is None else opening
            room = wanted if wanted >= n else next(x for x in lengths if x >= n)
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if rest := room - n:
            if not rooms[rest]:
                some |= 1 << rest
            rooms[rest].append(b)
    fitted = np.asarray(lengths)[np.searchsorted(lengths, used)] if used else np.empty(0, np.int64)
    return bins, offsets, fitted


def pack_group(sizes: np.ndarray, lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packing of least cost: each bin's own length, or one length for all."""
    return min((best_fit(sizes, lengths, o) for o in (None, *sorted(lengths, reverse=True))), key=lambda p: sum(bin_cost(int(n)) for n in p[2]))


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bin_id, bin_length, bin_offset.

    Null or empty texts are their end mark alone; a null doc_id and repeated rows are packed like any other, rows alike in
    id and tokens dealt over all groups; an empty table gives no rows; other columns are ignored. Ties in length go by
    doc_id and piece.
    """
    longest = max(lengths)
    sized = durable(docs.select("doc_id", (word_count(F.col("text")) + 1).alias("tokens")).groupBy("doc_id", "tokens").agg(F.count("*").alias("rows")))
    total = sized.agg(F.sum(F.col("tokens") * F.col("rows"))).first()[0] or 0
    groups = -(-total // group_tokens) or 1
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(longest).cast("long")))
    pieces = (
        sized.select("doc_id", "tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row"))
        .select("doc_id", "row", "tokens", starts.alias("start"))
        .select(
            "doc_id",
            "row",
            (F.col("start") / longest).cast("int").alias("piece"),
            "start",
            F.least(F.lit(longest), F.col("tokens") - F.col("start")).cast("int").alias("n_tokens"),
        )
        .withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(groups)))
    )

    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins, offsets, fitted = pack_group(part.n_tokens.to_numpy(), lengths)
        return part[["doc_id", "piece", "start", "n_tokens"]].assign(bin_id=(int(key[0]) << 32) + bins, bin_length=fitted[bins], bin_offset=offsets)

    schema = "doc_id long, piece int, start long, n_tokens int, bin_id long, bin_length long, bin_offset long"
    return pieces.groupBy("bin_group").applyInPandas(packed, schema)
