"""Nodes that both ends of a pair are linked to, counted over links between numbers that travel packed."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packed

#: Flags of a link: a relation, a pair that is asked for.
RELATION, ASKED = 1, 2

#: Nodes that are put in order by how much they are linked: so many at most, or the root of the number of links if that is more.
LISTED = 100_000

_FOUND = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64())])
_OWN, _REST = 0, 1


def _once(order: np.ndarray, u: np.ndarray, v: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links in the given order, each once with all of its flags."""
    u, v, f = u[order], v[order], f[order]
    at = packed.starts(u, v)
    return u[at], v[at], np.bitwise_or.reduceat(f, at) if len(at) else f


class _Places:
    """The order of nodes: those that are listed by their place there, after all others, which are ordered by number."""

    def __init__(self, listed: np.ndarray):
        self.by_id = np.argsort(listed)
        self.ids = listed[self.by_id]

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(len(ids), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, self.by_id[at] + 1, 0)


def _turned(batches: Iterator[pa.RecordBatch], places: _Places, tasks: int, most: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b, f; without f all are relations and asked for) turned to the end that comes first, packed for that end's task."""
    for rows in packed.chunks(batches, most):
        a, b, *f = map(packed.values, rows.columns)
        f = f[0] if f else np.full(len(a), RELATION | ASKED)
        p, q = places(a), places(b)
        turn = (p > q) | ((p == q) & (a > b))
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        u, v, f = _once(np.lexsort((b, a, packed.task(a, tasks))), a, b, f)
        yield packed.batch([(t, _OWN, packed.pack(np.diff(u[s], prepend=0), v[s] - u[s], f[s])) for t, s in packed.runs(packed.task(u, tasks))])


def _links(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    columns = [packed.unpack(b) for b in blobs]
    u = np.concatenate([np.cumsum(c[0]) for c in columns])
    return u, u + np.concatenate([c[1] for c in columns]), np.concatenate([c[2] for c in columns])


def _rests(batches: Iterator[pa.RecordBatch], places: _Places, tasks: int, most: int) -> Iterator[pa.RecordBatch]:
    """For each node's task its own links, and for each of its neighbours' tasks the node's links that come after that one."""
    blobs = [x for b in batches for x in b.column("data").to_pylist()]
    if not blobs:
        return
    u, v, f = _links(blobs)
    del blobs
    u, v, f = _once(np.lexsort((v, places(v), u)), u, v, f)
    at = packed.task(u, tasks)
    order = np.argsort(at, kind="stable")
    yield packed.batch([(t, _OWN, packed.pack(np.diff(u[order[s]], prepend=0), v[order[s]] - u[order[s]], f[order[s]])) for t, s in packed.runs(at[order])])
    first = packed.starts(u)
    rest = np.repeat(np.append(first[1:], len(u)), np.diff(np.append(first, len(u)))) - np.arange(len(u)) - 1
    asking = np.flatnonzero(rest)
    step = np.diff(v, prepend=0)
    ends = np.cumsum(rest[asking])
    i = 0
    while i < len(asking):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        some = asking[i:j]
        to = packed.task(v[some], tasks)
        order = np.lexsort((v[some], to))
        some, to = some[order], to[order]
        upto = np.cumsum(rest[some])
        after = np.arange(upto[-1]) + np.repeat(some + 1 - (upto - rest[some]), rest[some])
        rows = []
        for t, s in packed.runs(to):
            x, w = some[s], after[upto[s.start] - rest[some[s.start]] : upto[s.stop - 1]]
            rows.append((t, _REST, packed.pack(np.diff(v[x], prepend=0), u[x] - v[x], f[x], rest[x], step[w], f[w])))
        yield packed.batch(rows)
        i = j


def _closed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """x, y, n: what the links of a task's nodes close with the rests that come after them; a triangle counts for each of its
    links that is asked for and whose other two are relations."""
    own, index, held, n = [], None, [], 0

    def summed() -> pa.RecordBatch:
        x, y, k = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((y, x))
        x, y, k = x[order], y[order], k[order]
        at = packed.starts(x, y)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (x[at], y[at], np.add.reduceat(k, at))], schema=_FOUND)

    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if kind == _OWN:
                own.append(data)
                continue
            if index is None:
                if not own:
                    continue  # what is sent is read to its end
                u, v, f = _links(own)
                (firsts, a), (seconds, b) = np.unique(u, return_inverse=True), np.unique(v, return_inverse=True)
                keys = a * len(seconds) + b
                order = np.argsort(keys)
                shift = max(0, 31 - (16 * len(u)).bit_length())
                maybe = np.zeros((1 << 31) >> shift, dtype=bool)  # most links that aren't there are told by a look at this
                maybe[packed.mixed(u, v) >> shift] = True
                index = firsts, seconds, keys[order], f[order], maybe, shift
            firsts, seconds, keys, flags, maybe, shift = index
            v, u, f, rest, step, g = packed.unpack(data)
            v = np.cumsum(v)
            u = u + v
            begin = np.cumsum(rest) - rest
            w = np.cumsum(step)
            w += np.repeat(v - (w[begin] - step[begin]), rest)
            of = np.repeat(np.arange(len(v)), rest)
            hit = np.flatnonzero(maybe[packed.mixed(v[of], w) >> shift])
            of, w, g = of[hit], w[hit], g[hit]
            u, v, f = u[of], v[of], f[of]
            a = np.minimum(np.searchsorted(firsts, v), len(firsts) - 1)
            b = np.minimum(np.searchsorted(seconds, w), len(seconds) - 1)
            key = a * len(seconds) + b
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            there = (keys[at] == key) & (firsts[a] == v) & (seconds[b] == w)
            u, v, w, f, g, h = u[there], v[there], w[there], f[there], g[there], flags[at[there]]
            for x, y, asked, one, two in ((u, v, f, g, h), (u, w, g, f, h), (v, w, h, f, g)):
                counts = np.flatnonzero((asked & ASKED) & ((one & two & RELATION) << 1))
                if len(counts):
                    held.append((x[counts], y[counts], np.ones(len(counts), dtype=np.int64)))
                    n += len(counts)
            if n >= most:
                yield summed()
                held, n = [], 0
    if held:
        yield summed()


def _often(batches: Iterator[pa.RecordBatch], least: float, most: int) -> Iterator[pa.RecordBatch]:
    for rows in packed.chunks(batches, most):
        ids, n = np.unique(packed.values(rows.column(0)), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids[n >= least]), pa.array(n[n >= least])], names=["id", "n"])


def listed(ids: DataFrame, total: int, most: int = packed.MOST) -> np.ndarray:
    """Those numbers of ``ids`` (one column, ``total`` rows) that are there most, the rarest first: as many as the root of
    ``total`` or ``LISTED`` at most.

    Only what is frequent in some part of a task's rows is counted, so what is listed may be there more often than was
    counted, and what isn't listed, up to twice as often as asked for.
    """
    often = total / max(math.isqrt(total), LISTED)
    ids = ids.select(F.col(ids.columns[0]).cast("long").alias("id")).filter("id IS NOT NULL")
    least = often / (ids.rdd.getNumPartitions() + total // most)
    counts = ids.mapInArrow(lambda rows: _often(rows, least, most), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") > often).toArrow()
    ids, n = (found.column(i).to_numpy() for i in range(2))
    return ids[np.lexsort((ids, n))]


def common(rows: DataFrame, order: np.ndarray, tasks: int, links: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter, most: int = packed.MOST) -> DataFrame:
    """x, y, common: of the links that are asked for, how many nodes both ends have a relation with, if any.

    ``links`` makes links (a, b, f: two different numbers and flags, in any direction and any number of times) of a task's
    ``rows``, where they aren't links already. ``order`` lists the nodes of many links, the rarest first.

    A node keeps its links to those that come after it: the listed ones come last, so if they are those with more links than
    the root of their number, none keeps more than about that. What it keeps after a neighbour is sent to the neighbour, which
    knows its own; each triangle is found once. Links are sent as differences of numbers, a few bytes each.
    """
    places = _Places(order)
    turned = rows.mapInArrow(lambda b: _turned(links(b), places, tasks, most), packed.SENT)
    rests = turned.repartitionById(tasks, F.col("task")).mapInArrow(lambda b: _rests(b, places, tasks, most), packed.SENT)
    closed = rests.repartitionById(tasks, F.col("task")).sortWithinPartitions("kind").mapInArrow(lambda b: _closed(b, most), "x long, y long, n long")
    return closed.repartition(tasks, "x", "y").groupBy("x", "y").agg(F.sum("n").alias("common"))
