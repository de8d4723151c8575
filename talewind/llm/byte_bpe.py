"""Byte-level BPE by longest matches and backtracking.

Bytes are written as Latin-1 characters, so one Aho-Corasick automaton over the whole vocabulary reads a piece once and gives
the longest token that begins at each of its bytes. From left to right the longest token is taken that may follow the last one
taken; where none may, the last is given up for a shorter one, and its end is never tried again. Two tokens may stand side by
side if undoing their merges, the youngest first, never comes upon a pair across their border that would have been merged
before: then the merges of both in a row are the merges of the whole, so tokens that fit pair by pair are the very ones that
merging by rank gives. Each place is left at most once and the answers for pairs are kept, so a piece of any length takes time
in proportion to it.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces that a worker remembers before it forgets those that it hasn't met since; pairs before it starts anew.
PIECES, PAIRS = 150_000, 1 << 17
_NEVER = 1 << 62


class Pairs:
    """Whether two tokens may stand side by side; ``fits`` remembers it for ``left << 32 | right``."""

    def __init__(self, size: int) -> None:
        self.older: list[tuple[int, int]] = [(-1, -1)] * size
        self.merged: dict[int, int] = {}
        self.fits: dict[int, bool] = {}

    def ask(self, pair: int) -> bool:
        if len(self.fits) > PAIRS:
            self.fits.clear()
        self.fits[pair] = fits = self.apart(pair >> 32, pair & 0xFFFFFFFF)
        return fits

    def apart(self, left: int, right: int) -> bool:
        before = _NEVER  # a merge across the border counts if it is older than this
        while self.merged.get(left << 32 | right, _NEVER) >= before:
            end, begin = self.older[left][1], self.older[right][0]
            if end >= 0 and (left > right or begin < 0):
                before, left = left, end
            elif begin >= 0:
                before, right = right + 1, begin
            else:
                return True
        return False


def tokens(ranks: bytes) -> list[bytes]:
    """The tokens of a file of ranks, by rank."""
    rows = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, ranks.splitlines()))
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError("ranks must be 0, 1, 2, ... without a gap")
    return [t for _, t in rows]


class Vocabulary(dict):
    """The tokens of a file of ranks; as a dictionary, the packed ids of a piece of text, found when first asked."""

    def __init__(self, ranks: bytes) -> None:
        import ahocorasick

        names = [t.decode("latin-1") for t in tokens(ranks)]
        self.ids = {name: i for i, name in enumerate(names)}
        self.sizes = [len(name) for name in names]
        #: The longest other token that a token begins with (-1: none).
        self.shorter = [next((self.ids[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in self.ids), -1) for name in names]
        self.pairs = Pairs(len(names))
        for i, name in enumerate(names):
            self._undo(i, name)
        if any(chr(b) not in self.ids for b in range(256)):
            raise ValueError("the vocabulary lacks a byte")
        self.automaton = ahocorasick.Automaton()
        for i, name in enumerate(names):
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.earlier: dict[str, bytes] = {}

    def _undo(self, i: int, name: str) -> None:
        """Which two older tokens a token is merged from: those that would stand side by side without it."""
        first = self.shorter[i]
        while first >= 0:
            second = self.ids.get(name[self.sizes[first] :], i)
            if first < i and second < i and self.pairs.apart(first, second):
                self.pairs.older[i], self.pairs.merged[first << 32 | second] = (first, second), i
                return
            first = self.shorter[first]
        if len(name) > 1:
            raise ValueError(f"no merges make token {i}")

    def __missing__(self, piece: str) -> bytes:
        if (packed := self.earlier.get(piece)) is None:
            packed = array("I", self.encode(piece.encode("utf-8").decode("latin-1"))).tobytes()
        if len(piece) < 256:
            if len(self) >= PIECES:
                self.earlier = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, piece: str) -> list[int]:
        """The ids of a piece, its bytes written as Latin-1."""
        if not piece or (whole := self.ids.get(piece)) is not None:
            return [whole] if piece else []
        fits, ask = self.pairs.fits.get, self.pairs.ask
        # the longest tokens one after another are the ids, if they fit
        row = [token for _, token in self.automaton.iter_long(piece)]
        last = row[0] << 32
        for token in row[1:]:
            fit = fits(last | token)
            if not (ask(last | token) if fit is None else fit):
                return self._backtrack(piece)
            last = token << 32
        return row

    def _backtrack(self, piece: str) -> list[int]:
        sizes, shorter, fits, ask = self.sizes, self.shorter, self.pairs.fits.get, self.pairs.ask
        longest = [-1] * len(piece)
        for end, token in self.automaton.iter(piece):
            longest[end + 1 - sizes[token]] = token  # of one beginning the longest comes last
        given_up, out, at, token, size = bytearray(len(piece) + 1), [], 0, longest[0], len(piece)
        while at < size:
            if out:
                last = out[-1] << 32
                while token >= 0:
                    if not given_up[at + sizes[token]]:
                        fit = fits(last | token)
                        if ask(last | token) if fit is None else fit:
                            break
                    token = shorter[token]
            else:
                while token >= 0 and given_up[at + sizes[token]]:
                    token = shorter[token]
            if token >= 0:
                out.append(token)
                at += sizes[token]
                if at < size:
                    token = longest[at]
            else:  # never at the beginning, as every byte is a token
                given_up[at] = 1
                token = out.pop()
                at -= sizes[token]
        return out


@lru_cache(2)
def vocabulary(ranks: bytes) -> Vocabulary:
    return Vocabulary(ranks)


@lru_cache(2)
def known_tokens(ranks: bytes) -> list[bytes]:
    return tokens(ranks)


def decode(packed: bytes, known: list[bytes]) -> bytes:
    """The bytes that packed ids stand for."""
    return b"".join(map(known.__getitem__, array("I", packed)))


def _ranks(path: str | None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        return file.read()


def _pattern(pattern: str | None) -> str:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return pattern


def encode(docs: DataFrame, text: str = "text", name: str = "ids", path: str | None = None, pattern: str | None = None, back: str | None = None) -> DataFrame:
    """``docs`` and a column ``name``: the ids of the whole text, each four bytes, low byte first; with ``back`` also a column of
    that name: the bytes that :func:`decode` makes of these ids, in the same pass.

    The text is cut into the matches of ``pattern``, each encoded by itself. Null and empty texts give no ids; special tokens are
    ordinary text; repeated rows fare alike; an empty table gives none. ``path`` names a file of ranks that the driver can read
    (by default a public one that is installed); it is sent to the executors once. Other columns are kept; the new names must be
    new ones.
    """
    if taken := {name, back} & set(docs.columns):
        raise ValueError(f"there is a column {taken.pop()} already")
    sent, pattern = docs.sparkSession.sparkContext.broadcast(_ranks(path)), _pattern(pattern)  # as large as the vocabulary's file

    def packed(parts: Iterator[pd.Series]) -> Iterator[list[bytes]]:
        import regex

        pieces, words = vocabulary(sent.value), regex.compile(pattern)
        for part in parts:
            yield [b"".join(map(pieces.__getitem__, words.findall(t))) if t else b"" for t in part]

    @F.pandas_udf("binary")
    def encoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in packed(parts):
            yield pd.Series(ids, dtype=object)

    @F.pandas_udf("ids binary, back binary")
    def there_and_back(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = known_tokens(sent.value)
        for ids in packed(parts):
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "back": pd.Series([decode(x, known) for x in ids], dtype=object)})

    if back is None:
        return docs.withColumn(name, encoded(text))
    both = "both_" + "_".join(docs.columns)
    return docs.withColumn(both, there_and_back(text)).select(*docs.columns, F.col(f"{both}.ids").alias(name), F.col(f"{both}.back").alias(back))


def decoded(docs: DataFrame, ids: str = "ids", path: str | None = None) -> Column:
    """The bytes that packed ids stand for (null: null); an id that isn't in the vocabulary is an error."""
    sent = docs.sparkSession.sparkContext.broadcast(_ranks(path))

    @F.pandas_udf("binary")
    def joined(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = known_tokens(sent.value)
        for part in parts:
            yield pd.Series([None if x is None else decode(x, known) for x in part], dtype=object)

    return joined(ids)
