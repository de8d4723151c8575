"""Toxicity: Levenshtein automata run over a lexicon trie, hits weighed by the window of words around them.

The lexicon is learned from labelled rows: words, and stems that many words share, which stand in toxic texts far more
often than in clean ones, in several families of texts (near copies are one family, so a copied text doesn't make its
words toxic). A word that isn't in the lexicon is run as a Levenshtein automaton over the trie of its terms: one error for
terms of ``LEAST`` letters, two for those of ``LONG``. What a near miss of a term is worth starts from a prior for its number
of errors and moves with the labelled rows that hold near misses of that term, and with those that hold this very word; so
a misspelling that was never seen counts, unless the term's neighbours turn up in clean texts. A hit in quotation marks or
beside a word of reporting counts less, one beside a second person in full. A text's score is the noisy-or of its hits.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, held_out

#: The classifier is fitted on at most so many labelled rows of each class, drawn by a hash of the id.
FIT_TOXIC, FIT_CLEAN = 20_000, 40_000
#: What a term needs: share of toxic texts, families of toxic texts; a stem also needs so many words.
PRECISION, FAMILIES, STEM_WORDS = 0.85, 3, 4
STEMS = (4, 8)
#: Letters of a term that may be misspelled, and misspelled twice; log-likelihood ratio that a learned term needs.
LEAST, LONG, EVIDENCE = 5, 9, 12.0
#: Share of toxic texts among those with a near miss, by its errors, before any was seen; as sure as so many texts.
NEAR, NEAR_TEXTS = {1: 0.85, 2: 0.8}, 2
#: A near miss whose share is below this is no hit.
LEAST_NEAR = 0.8
THRESHOLD = 0.3
#: Words on each side of a hit that are its context.
WINDOW = 6
QUOTED, REPORTED, ADDRESSED = 0.4, 0.6, 1.6
#: Score of a text without hits.
NOTHING = 0.02

# Words of reporting and address.
_REPORTING = "said says wrote quote quoted quotes called term word slur sagte nannte zitierte wort dit cita mot appelé dijo citó palabra llamó"
_SECOND_PERSON = "you your you're u du dich dir ihr euch dein tu te toi vous votre tú ti usted ustedes vosotros"
REPORTING, SECOND_PERSON = (frozenset(x.split()) for x in (_REPORTING, _SECOND_PERSON))
_QUOTES = frozenset("\"“”„«»‹›")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")


def plain(word: str) -> str:
    """A lower-case word without anything but letters and digits."""
    return word if word.isalnum() else _INNER.sub("", word)


def trie(terms: Iterable[str]) -> dict:
    root: dict = {}
    for t in terms:
        node = root
        for c in t:
            node = node.setdefault(c, {})
        node[""] = t
    return root


def near_terms(word: str, node: dict, read: int = 0, edits: int = 1, late: int = 0) -> Iterator[tuple[str, int]]:
    """The terms below ``node`` within ``edits`` (1 or 2) errors of ``word``, whose first ``read`` letters led to the node.

    Run along the trie's edges is the word's automaton, bit-parallel: bit i of ``none``, ``one`` or ``two`` says that i
    letters of the word are read with so many errors (a letter too many, too few, another one), bit i of ``swapped`` (after
    none or one) that the letter after the i-th came first. A branch ends where no state is left. Second errors are
    only looked for from the depth ``late`` on.
    """
    masks: dict[str, int] = {}
    for i, c in enumerate(word):
        masks[c] = masks.get(c, 0) | 1 << i
    whole = 1 << len(word)
    most = 2 * whole - 1
    twice = edits > 1
    stack = [(node, read, 1 << read, 2 << read, 4 << read if twice and late <= read else 0, 0, 0)]
    while stack:
        node, depth, none, one, two, swapped, swapped_one = stack.pop()
        depth += 1
        for c, below in node.items():
            if not c:
                if (none | one | two) & whole:
                    yield below, 0 if none & whole else 1 if one & whole else 2
                continue
            mask = masks.get(c, 0)
            none_ = (none & mask) << 1
            one_ = (one & mask) << 1 | none | none << 1 | none_ << 1 | (swapped & mask) << 2
            two_ = (two & mask) << 1 | one | one << 1 | one_ << 1 | (swapped_one & mask) << 2 if twice and depth >= late else 0
            swapped_, swapped_one_ = none & mask >> 1, one & mask >> 1 if twice else 0
            if (none_ | one_ | two_ | swapped_ | swapped_one_) & most:
                stack.append((below, depth, none_, one_, two_, swapped_, swapped_one_))


def _below(letters: str, node: dict | None, n: int) -> dict | None:
    for c in letters[:n]:
        if node is None:
            return None
        node = node.get(c)
    return node


class Speller:
    """Finds the terms that a word misspells."""

    def __init__(self, terms: Iterable[str]) -> None:
        terms = [t for t in terms if len(t) >= LEAST]
        # one error leaves one half of a term as it is: descend by that half, run the automaton on the rest
        self.forward, self.backward = trie(terms), trie(t[::-1] for t in terms)
        self.whole = frozenset(terms)
        self.halves = sorted({len(t) // 2 for t in terms} | {len(t) - len(t) // 2 for t in terms})
        self.longest = max(map(len, terms), default=0)
        long_ = [t for t in terms if len(t) >= LONG]
        self.long_forward, self.long_backward = trie(long_), trie(t[::-1] for t in long_)

    def near(self, word: str) -> dict[str, int]:
        """The terms within one error, or two for long ones, with their errors; no others are that near."""
        found: dict[str, int] = {}
        if not LEAST - 1 <= len(word) <= self.longest + 2:
            return found
        middle = len(word) // 2
        for n in {middle, len(word) - middle}:  # a swap across the middle alters both halves
            if (swapped := word[: n - 1] + word[n : n + 1] + word[n - 1] + word[n + 1 :]) in self.whole:
                found[swapped] = 1
        for letters, node, step in ((word, self.forward, 1), (word[::-1], self.backward, -1)):
            at = 0
            for n in self.halves:
                while at < n and at < len(letters) and (node := node.get(letters[at])) is not None:
                    at += 1
                if at < n or node is None:
                    break
                for t, e in near_terms(letters, node, n):
                    if len(t) // 2 == n or len(t) - len(t) // 2 == n:
                        found[t[::step]] = e
        if self.long_forward and len(word) >= LONG - 2:
            # two errors leave the first or the last third as it is, or stand one each before and after two thirds
            third = LONG // 3
            for letters, root, step in ((word, self.long_forward, 1), (word[::-1], self.long_backward, -1)):
                if node := _below(letters, root, third):
                    for t, e in near_terms(letters, node, third, 2):
                        found[t[::step]] = min(e, found.get(t[::step], 2))
            for t, e in near_terms(word, self.long_forward, 0, 2, 2 * third):
                found[t] = min(e, found.get(t, 2))
        return found


@dataclass
class Lexicon:
    """Terms and stems with their shares of toxic texts; what near misses are worth, by term and errors, and by words seen."""

    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    near: dict[str, dict[int, float]] = field(default_factory=dict)
    variants: dict[str, float] = field(default_factory=dict)

    def known(self, word: str) -> float | None:
        if (p := self.terms.get(word)) is not None:
            return p
        for n in range(STEMS[0], min(STEMS[1], len(word)) + 1):
            if (p := self.stems.get(word[:n])) is not None:
                return p
        return None


class Matcher(dict):
    """Raw word: share of toxic texts that its match stands for, 0 if none, and whether the automaton found it. Forgets all
    when it grows large."""

    def __init__(self, lexicon: Lexicon, most: int = 400_000) -> None:
        super().__init__()
        self.lexicon, self.most = lexicon, most
        self.speller = Speller(lexicon.near)

    def __missing__(self, raw: str) -> tuple[float, bool]:
        if len(self) >= self.most:
            self.clear()
        self[raw] = found = self.match(plain(raw))
        return found

    def match(self, word: str) -> tuple[float, bool]:
        lexicon = self.lexicon
        if (p := lexicon.known(word)) is not None:
            return p, False
        if (p := lexicon.variants.get(word)) is None:
            p = max((lexicon.near[t].get(e, 0.0) for t, e in self.speller.near(word).items() if e), default=0.0)
        return (p, True) if p >= LEAST_NEAR else (0.0, False)


def _in_quotes(words: list[str], i: int) -> bool:
    """Whether the nearest quotation marks on both sides, within the window, enclose word i."""
    own = words[i]
    before = own[:1] in _QUOTES or any(w[:1] in _QUOTES for w in words[max(0, i - WINDOW) : i])
    after = any(c in _QUOTES for c in own[-2:]) or any(any(c in _QUOTES for c in w[-2:]) for w in words[i + 1 : i + 1 + WINDOW])
    return before and after


def score_text(text: str, matcher: Matcher) -> tuple[float, int, int]:
    """Score of a whole text, its number of hits, and how many of them are misspelled."""
    words = text.lower().split()
    clean, quoted, hits, near = 1.0, 0.0, 0, 0
    for i in [i for i, w in enumerate(words) if matcher[w][0]]:
        p, misspelled = matcher[words[i]]
        hits, near = hits + 1, near + misspelled
        around = {plain(w) for w in (*words[max(0, i - WINDOW) : i], *words[i + 1 : i + 1 + WINDOW])}
        in_quotes, reported = _in_quotes(words, i), bool(around & REPORTING)
        weight = (QUOTED if in_quotes else 1.0) * (REPORTED if reported else 1.0)
        if around & SECOND_PERSON:
            weight = min(1.0, weight * ADDRESSED)
        if in_quotes:
            quoted = max(quoted, p * weight)  # a quotation doesn't grow worse by its length
        else:
            clean *= 1 - min(p * weight, 0.999)
    return max(NOTHING, 1 - clean * (1 - quoted)), hits, near


def _fit_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, weight of the rows to learn from: at most the bound of each class, so their ids can be broadcast."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    share = {t: min(1.0, n / max(1, sizes.get(t, 0))) for t, n in ((True, FIT_TOXIC), (False, FIT_CLEAN))}
    toxic, u = F.col("toxic") > 0, F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # the hash may draw a few more than the bound; the broadcast stays within a twentieth of it
    drawn = known.filter(u < F.when(toxic, share[True]).otherwise(share[False]))
    weight = F.when(toxic, 1 / share[True]).otherwise(1 / share[False])
    return docs.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id", toxic.alias("toxic"), weight.alias("weight"))), "doc_id").select("text", "toxic", "weight")


def _counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """word, n and k (weights of all and of toxic texts with it), rows and toxic_rows (texts drawn that have it, unweighted),
    families (a bit for each of 63 groups of toxic texts)."""
    for part in parts:
        n: Counter = Counter()
        k: Counter = Counter()
        rows: Counter = Counter()
        toxic_rows: Counter = Counter()
        families: dict[str, int] = {}
        for text, toxic, weight in zip(part.text, part.toxic, part.weight, strict=True):
            words = {plain(w) for w in (text or "").lower().split()}
            words.discard("")
            if not words:
                continue
            for w in words:
                n[w] += weight
            rows.update(words)
            if toxic:
                toxic_rows.update(words)
                bit = 1 << min(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words) % 63
                for w in words:
                    k[w] += weight
                    families[w] = families.get(w, 0) | bit
        if not n:
            continue
        counts = {"word": list(n), "n": list(n.values()), "k": [float(k[w]) for w in n], "rows": [rows[w] for w in n], "toxic_rows": [toxic_rows[w] for w in n]}
        yield pd.DataFrame({**counts, "families": [families.get(w, 0) for w in n]}).astype({"n": "float64", "rows": "int64", "toxic_rows": "int64", "families": "int64"})


def _smoothed(k, n, rows, toxic: float, all_: float):
    """Share of toxic texts, k of n by weight, as ``rows`` drawn rows tell it beside ``toxic`` of ``all_`` assumed ones.

    Weights say what the share is, never how sure it is: one row that stands for a hundred is still one row.
    """
    return (k / n * rows + toxic) / (rows + all_)


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon that the labelled rows outside the held-out quarter teach.

    Where rows are drawn, shares are those of all rows (by weight); what is rare, apart or evident counts the rows drawn.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "k", "rows", "toxic_rows")] + [F.bit_or("families").alias("families")]
    words = _fit_rows(docs, labels).mapInPandas(_counted, "word string, n double, k double, rows long, toxic_rows long, families long")
    words = durable(words.groupBy("word").agg(*sums))
    base = _fit_rows(docs, labels).agg(F.avg(F.when(F.col("toxic"), 1.0).otherwise(0.0))).first()[0] or 0.1
    base = min(max(base, 0.01), 0.5)
    share = _smoothed(F.col("k"), F.col("n"), F.col("rows"), 0.2, 1)
    support = F.bit_count("families")
    drawn = (F.col("toxic_rows") + 0.2) / (F.col("rows") + 1)
    evidence = F.col("toxic_rows") * F.log(drawn / base) + (F.col("rows") - F.col("toxic_rows")) * F.log((1 - drawn) / (1 - base))
    # so many independent texts fall into so many of the 63 families on average; copies of one text into far fewer
    apart = support >= 0.5 * 63 * (1 - F.pow(F.lit(62 / 63), F.col("toxic_rows")))
    strong = words.filter((share >= PRECISION) & (support >= FAMILIES) & apart & (evidence >= EVIDENCE)).select("word", share.alias("p"))
    lexicon = Lexicon()
    # as many terms, stems and near misses as the rows drawn hold, whose number is bounded
    lexicon.terms = {r.word: r.p for r in strong.collect() if len(r.word) > 2}
    stem = F.explode(F.transform(F.sequence(F.lit(STEMS[0]), F.least(F.lit(STEMS[1]), F.length("word"))), lambda n: F.substring("word", F.lit(1), n))).alias("stem")
    stems = (
        words.filter(F.length("word") >= STEMS[0])
        .select(stem, "n", "k", "rows", "toxic_rows", "families")
        .groupBy("stem")
        .agg(*sums, F.sum(F.when(F.col("k") > 0, 1).otherwise(0)).alias("words"))
        .filter((F.col("k") >= 0.9 * F.col("n")) & (F.bit_count("families") >= 2 * FAMILIES) & (F.col("words") >= STEM_WORDS))
        .select("stem", share.alias("p"))
        .collect()
    )
    for r in sorted(stems, key=lambda r: (len(r.stem), r.stem)):  # the shortest stem stands for all that begin with it
        if not any(r.stem[:n] in lexicon.stems for n in range(STEMS[0], len(r.stem))):
            lexicon.stems[r.stem] = r.p
    # a term whose stem is known needs no spelling: what begins like it is found already, and its other neighbours are many
    spelled = [t for t in lexicon.terms if len(t) >= LEAST and not any(t[:n] in lexicon.stems for n in range(STEMS[0], STEMS[1] + 1))]

    def misses(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speller, known = Speller(spelled), Lexicon(lexicon.terms, lexicon.stems).known
        for part in parts:
            out = []
            for w, n, k, rows in zip(part.word, part.n, part.k, part.rows, strict=True):
                if known(w) is None:
                    out += [(w, t, e, n, k, rows) for t, e in speller.near(w).items() if e]
            if out:
                yield pd.DataFrame(out, columns=["word", "term", "errors", "n", "k", "rows"])

    near = durable(words.mapInPandas(misses, "word string, term string, errors int, n double, k double, rows long"))
    seen = {(r.term, r.errors): r for r in near.groupBy("term", "errors").agg(*[F.sum(c).alias(c) for c in ("n", "k", "rows")]).collect()}
    worth: dict[str, dict[int, float]] = {t: {} for t in spelled}
    for t in spelled:
        for e in (1, 2) if len(t) >= LONG else (1,):
            r = seen.get((t, e))
            p = _smoothed(r.k if r else 0, r.n if r else 1, r.rows if r else 0, NEAR[e] * NEAR_TEXTS, NEAR_TEXTS)
            worth[t][e] = min(p, worth[t].get(1, p))  # more errors are never worth more
    lexicon.near = {t: by for t, by in worth.items() if max(by.values()) >= LEAST_NEAR}
    for r in near.groupBy("word").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.first("rows").alias("rows"), F.collect_list(F.struct("term", "errors")).alias("of")).collect():
        prior = max(worth[t][e] for t, e in r.of)
        lexicon.variants[r.word] = _smoothed(r.k, r.n, r.rows, prior * NEAR_TEXTS, NEAR_TEXTS)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, name: str = "toxicity") -> DataFrame:
    """``docs`` and a struct ``name``: score (0 to 1), hits, near (hits that are misspelled), predicted (1 if the score
    reaches the threshold) of every row.

    Null and empty texts score as a text without hits; texts are read whole; repeated rows score alike; an empty table
    gives no rows. Other columns are kept as they are; ``name`` must be a new one. Without labelled rows the lexicon is
    empty.
    """

    @F.pandas_udf("score double, hits int, near int, predicted int")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for part in parts:
            found = pd.DataFrame([score_text(t or "", matcher) for t in part], columns=["score", "hits", "near"])
            yield found.assign(predicted=(found.score >= THRESHOLD).astype("int32"))

    return docs.withColumn(name, scored("text"))
