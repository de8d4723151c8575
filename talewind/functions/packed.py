"""Rows of whole numbers as a few bytes each, for shuffles: sorted for their task, differences, byte by byte, compressed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows, or what comes of them, that a task packs or combines at once.
MOST = 1 << 21

#: What is sent: each row holds many, for a task (for ``repartitionById``).
SENT = "task int, kind int, data binary"
_SENT = pa.schema([("task", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, best small ones, as bytes: the first byte of each number, then the second..., each compressed by itself."""
    head, planes = [len(columns)], []
    for c in (c.astype(np.int64) for c in columns):
        c = (c << 1) ^ (c >> 63)
        width = -(-int(c.view(np.uint64).max(initial=0)).bit_length() // 8)
        head += [len(c), width]
        for plane in c.view(np.uint8).reshape(-1, 8)[:, :width].T:
            plane = plane.tobytes()
            small = min(plane, pa.compress(plane, codec="zstd", asbytes=True), key=len)  # of the same length: as it is
            planes.append(small)
            head.append(len(small))
    return np.array([len(head), *head], dtype=np.int32).tobytes() + b"".join(planes)


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, dtype=np.int32, count=1)[0])
    head = iter(np.frombuffer(data, dtype=np.int32, count=n + 1)[1:].tolist())
    at, columns = 4 * (n + 1), []
    for _ in range(next(head)):
        size, width = next(head), next(head)
        c = np.zeros((size, 8), dtype=np.uint8)
        for i in range(width):
            length = next(head)
            plane = data[at : at + length]
            c[:, i] = np.frombuffer(plane if length == size else pa.decompress(plane, size, codec="zstd", asbytes=True), dtype=np.uint8)
            at += length
        c = c.reshape(-1).view(np.uint64)
        columns.append((c >> np.uint64(1)).view(np.int64) ^ -(c & np.uint64(1)).view(np.int64))
    return columns


def mixed(ids: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """31 bits of each number, or pair of numbers."""
    out = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if more is not None:
        out += more.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (out >> np.uint64(33)).view(np.int64)


def task(ids: np.ndarray, tasks: int) -> np.ndarray:
    return mixed(ids) % tasks


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def runs(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    at = starts(keys).tolist()
    for i, j in zip(at, [*at[1:], len(keys)], strict=True):
        yield int(keys[i]), slice(i, j)


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_SENT.types)], schema=_SENT)


def chunks(batches: Iterator[pa.RecordBatch], most: int = MOST) -> Iterator[pa.Table]:
    """The rows, about so many at once."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def values(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Whole numbers of a column; 0 where there is none."""
    return (column.fill_null(0) if column.null_count else column).to_numpy()


def sent(batches: Iterator[pa.RecordBatch], tasks: int, most: int = MOST // 2) -> Iterator[pa.RecordBatch]:
    """Rows of whole numbers (any may be missing) packed for tasks by the first."""
    for rows in chunks(batches, most):
        columns = [values(c) for c in rows.columns]
        there = sum((c.is_valid().to_numpy().astype(np.int64) << i for i, c in enumerate(rows.columns) if c.null_count), np.zeros(rows.num_rows, dtype=np.int64))
        there |= sum(1 << i for i, c in enumerate(rows.columns) if not c.null_count)
        order = np.argsort(columns[0])
        to = task(columns[0][order], tasks)
        by_task = np.argsort(to.astype(np.uint16) if tasks <= 1 << 16 else to, kind="stable")
        order, to = order[by_task], to[by_task]
        yield batch([(t, 0, pack(np.diff(columns[0][order[s]], prepend=0), *(c[order[s]] for c in columns[1:]), there[order[s]])) for t, s in runs(to)])


def received(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """What :func:`sent` packed, as rows again."""
    for b in batches:
        for data in b.column("data").to_pylist():
            first, *rest, there = unpack(data)
            columns = [np.cumsum(first), *rest]
            yield pa.RecordBatch.from_arrays([pa.array(c, mask=(there >> i) & 1 == 0) for i, c in enumerate(columns)], names=names)
