"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. For each language, expectation maximisation over the words of labelled
texts gives every piece a probability; a word's likelihood is the sum over all its segmentations into pieces, by a forward
recursion over the whole word, a text's that of its words. Words are scored once for each task and all languages together,
many words of one length at a time; long words are summed in logarithms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, held_out

#: The classifier is fitted on about so many texts of each language at most, drawn by a hash of the id.
FIT_TEXTS = 3_000
ROUNDS = 3
#: Words of so many letters and more are summed in logarithms, as their sums leave the range of numbers.
LOG_FROM = 60
UNDETERMINED = "und"
#: A word: letters with their marks, by Unicode category. Digits, fractions, numerals in circles and the like are none.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Each letter of a piece multiplies its probability by this, so that long words don't underflow; taken back in the logarithm.
_GAIN = 256.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_START = "▁"  # the vocabulary's sign for the start of a word


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of a sentencepiece model (by default a public one that is installed), lower case, no control pieces."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    n = model.get_piece_size()
    pieces = {model.id_to_piece(i).lower() for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return sorted(p for p in pieces if _LETTERS.fullmatch(p.replace(_START, "", 1) or "a"))


def words_of(text: str) -> list[str]:
    """The words of a text: its runs of letters and their marks in lower case, marked at their start."""
    return [_START + w for w in _LETTERS.findall(text.lower())]


class Pieces:
    """Looks up the pieces of many words of one length at once, by rolling hashes. A letter that is no piece is the last id."""

    COMMON = 8  # longer pieces are looked up only where so many letters begin one

    def __init__(self, pieces: list[str]) -> None:
        self.n = len(pieces)
        hashes, lengths = np.array([self._hash(p) for p in pieces], dtype=np.uint64), np.array([len(p) for p in pieces], dtype=np.int64)
        self.by_length = {int(n): (pd.Index(hashes[lengths == n]), np.append(np.flatnonzero(lengths == n), -1)) for n in np.unique(lengths)}
        self.beginnings = pd.Index(np.unique(np.array([self._hash(p[: self.COMMON]) for p in pieces if len(p) > self.COMMON], dtype=np.uint64)))

    def _hash(self, piece: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * _BASE + np.uint64(ord(c) + 1)
        return h

    def lookup(self, words: list[str]) -> dict[int, np.ndarray]:
        """Length of a piece: ids (words, starts) of the pieces of that length, -1 where none is."""
        codes = np.array([[ord(c) for c in w] for w in words], dtype=np.uint64) + np.uint64(1)
        size = codes.shape[1]
        sums = np.zeros((len(words), size + 1), np.uint64)
        for j in range(size):
            sums[:, j + 1] = sums[:, j] * _BASE + codes[:, j]
        hashed = lambda n: sums[:, n:] - sums[:, : size + 1 - n] * _BASE ** np.uint64(n)
        out, begin = {}, None
        for n, (index, ids) in self.by_length.items():
            if n > size:
                break
            if n <= self.COMMON:
                out[n] = ids[index.get_indexer(hashed(n).ravel())].reshape(len(words), size + 1 - n)
                continue
            if begin is None:
                begin = np.nonzero(self.beginnings.get_indexer(hashed(self.COMMON).ravel()).reshape(len(words), -1) >= 0)
            row, start = (x[begin[1] <= size - n] for x in begin)
            if row.size:
                out[n] = np.full((len(words), size + 1 - n), -1)
                out[n][row, start] = ids[index.get_indexer(sums[row, start + n] - sums[row, start] * _BASE ** np.uint64(n))]
        one = out.get(1, np.full((len(words), size), -1))
        out[1] = np.where(one < 0, self.n, one)
        return out

    def spans(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, ids) for all spans of words of one length that are pieces, by end; -1 for words where they aren't."""
        found = [(n, ids, (ids >= 0).any(axis=0)) for n, ids in sorted(self.lookup(words).items(), reverse=True)]
        for end in range(1, len(words[0]) + 1):
            for n, ids, some in found:
                if n <= end and some[end - n]:
                    yield end - n, end, ids[:, end - n]


def forward(spans: list[tuple[int, int, np.ndarray]], p: np.ndarray, n: int, size: int) -> np.ndarray:
    """Sums over the segmentations of each prefix: (words, size + 1, languages); ``p``: (pieces + 2, languages), last row 0."""
    a = np.zeros((n, size + 1, p.shape[1]))
    a[:, 0] = 1
    for start, end, ids in spans:
        a[:, end] += a[:, start] * p[ids]
    return a


def log_forward(spans: list[tuple[int, int, np.ndarray]], log_p: np.ndarray, n: int, size: int) -> np.ndarray:
    """As :func:`forward`, of logarithms."""
    a = np.full((n, size + 1, log_p.shape[1]), -np.inf)
    a[:, 0] = 0
    for start, end, ids in spans:
        a[:, end] = np.logaddexp(a[:, end], a[:, start] + log_p[ids])
    return a


def scaled(p: np.ndarray, pieces: list[str]) -> np.ndarray:
    """Probabilities by id with the gain for each letter; id -1 (the last row) is no piece."""
    gain = _GAIN ** np.array([len(x) for x in pieces] + [1])
    return np.vstack([p * gain[:, None], np.zeros((1, p.shape[1]))])


def by_length(words: list[str], most: int = 20_000) -> Iterator[tuple[np.ndarray, list[str]]]:
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for k in range(0, len(at), most):
            some = at[k : k + most]
            yield some, [words[i] for i in some]


def word_scores(words: list[str], lookup: Pieces, p: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word in each language."""
    out = np.empty((len(words), p.shape[1]))
    for at, some in by_length(words):
        size, spans = len(some[0]), lookup.spans(some)
        if size < LOG_FROM:
            whole = np.log(np.maximum(forward(spans, p, len(some), size)[:, size], 1e-300))
        else:
            with np.errstate(divide="ignore"):
                whole = log_forward(spans, np.log(p), len(some), size)[:, size]
        out[at] = whole - size * np.log(_GAIN)
    return out


class Places(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    p: np.ndarray  # (pieces + 1, languages): the last row is a letter that is no piece
    prior: np.ndarray


def _fit_texts(docs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, FIT_TEXTS / n))]), F.col("lang")) if sizes else F.lit(0.0)
    u = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return known.filter(u < share).select("lang", "text"), sizes


def _expect_long(spans: list[tuple[int, int, np.ndarray]], p: np.ndarray, n: np.ndarray, size: int, out: np.ndarray) -> None:
    """Adds the expected counts of the pieces of long words, ``n`` times each."""
    with np.errstate(divide="ignore"):
        log_p = np.log(p)
    a = log_forward(spans, log_p, len(n), size)[:, :, 0]
    b = np.full_like(a, -np.inf)
    b[:, size] = 0
    for start, end, ids in reversed(spans):
        b[:, start] = np.logaddexp(b[:, start], b[:, end] + log_p[ids, 0])
    for start, end, ids in spans:
        use = n * np.exp(a[:, start] + log_p[ids, 0] + b[:, end] - a[:, size])
        out += np.bincount(ids[ids >= 0], use[ids >= 0], minlength=len(out))


def fit(docs: DataFrame, path: str | None = None) -> Model:
    """Piece probabilities of every language that texts outside the held-out quarter are labelled with."""
    texts, sizes = _fit_texts(docs)
    languages, pieces = sorted(sizes), vocabulary(path)
    number = {x: i for i, x in enumerate(languages)}

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found: Counter = Counter()
            for lang, text in zip(part.lang, part.text, strict=True):
                for w, n in Counter(words_of(text)).items():
                    found[number[lang], w] += n
            if not found:
                continue
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["lang", "word", "n"]).astype({"lang": "int32", "n": "float64"})

    words = durable(texts.mapInPandas(counted, "lang int, word string, n double").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    lengths = np.array([len(x) for x in pieces] + [1])
    p = np.repeat((1e-3 ** np.minimum(lengths, 3.0))[:, None], max(1, len(languages)), axis=1)

    def expected(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup, q = Pieces(pieces), scaled(p, pieces)
        out = np.zeros((len(pieces) + 1, len(languages)))
        for part in parts:
            for lang, of in part.groupby("lang"):
                n = of.n.to_numpy()
                for at, some in by_length(list(of.word)):
                    size, spans = len(some[0]), list(lookup.spans(some))
                    one = q[:, [lang]]
                    if size >= LOG_FROM:
                        _expect_long(spans, one, n[at], size, out[:, lang])
                        continue
                    a = forward(spans, one, len(some), size)[:, :, 0]
                    b = np.zeros_like(a)
                    b[:, size] = 1
                    weight = n[at] / np.maximum(a[:, size], 1e-300)
                    for start, end, ids in reversed(spans):
                        b[:, start] += b[:, end] * one[ids, 0]
                    for start, end, ids in spans:
                        use = a[:, start] * one[ids, 0] * b[:, end] * weight
                        out[:, lang] += np.bincount(ids[ids >= 0], use[ids >= 0], minlength=len(out))
        at, lang = np.nonzero(out > 1e-9)
        yield pd.DataFrame({"piece": at, "lang": lang, "n": out[at, lang]})

    for _ in range(ROUNDS if languages else 0):
        # as many rows as pieces and languages, whatever the texts
        rows = words.mapInPandas(expected, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full_like(p, 0.05)
        np.add.at(counts, (rows.piece.to_numpy(), rows.lang.to_numpy()), rows.n.to_numpy())
        p = counts / counts.sum(axis=0)
    total = sum(sizes.values())
    return Model(languages, pieces, p, np.log(np.array([sizes[x] for x in languages]) / max(1, total)))


def predict(docs: DataFrame, model: Model, name: str = "language") -> DataFrame:
    """``docs`` and a struct ``name``: lang_pred, score (0 to 1) of every row.

    A null text, one without letters (by Unicode category: ``½`` and ``②`` are none), or a model without languages gives ``und`` and 0. Texts are read whole; repeated rows
    score alike; ties go to the first language by name; an empty table gives no rows. Other columns are kept as they are;
    ``name`` must be a new one.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lookup, q, k = Pieces(model.pieces), scaled(model.p, model.pieces), len(model.languages)
        places, table = Places(), np.zeros((0, k))
        nothing = np.zeros(0, np.int64)
        for part in parts:
            langs, scores = [], []
            for chunk in _chunks(part):
                if len(places) > 300_000:
                    places, table = Places(), table[:0]
                found = [np.fromiter(map(places.__getitem__, _LETTERS.findall(t.lower())), np.int64) if t and k else nothing for t in chunk]
                if len(places) > len(table):
                    table = np.vstack([table, word_scores([_START + w for w in islice(places, len(table), None)], lookup, q)])
                for at in found:
                    if not at.size:
                        langs.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    total = table[at].sum(axis=0)
                    fit_ = total + model.prior
                    best = int(fit_.argmax())
                    # the posterior of a text of at most 20 words as sure as this one on average
                    odds = np.exp((fit_ - fit_[best]) * min(1.0, 20 / at.size))
                    langs.append(model.languages[best])
                    scores.append(float(1 / odds.sum()))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn(name, predicted("text"))


def _chunks(part: pd.Series, letters: int = 2_000_000) -> Iterator[list]:
    """Rows of a part, about so many letters at a time."""
    some, size = [], 0
    for text in part:
        some.append(text)
        size += len(text or "")
        if size > letters:
            yield some
            some, size = [], 0
    if some:
        yield some
