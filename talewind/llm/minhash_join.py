"""MinHash near-dedup by an inverted join of signature coordinates.

A text's set of word shingles has a signature of ``COORDINATES`` minima. Each coordinate with its value is a posting; texts
whose sets are as similar as asked agree in at least ``threshold_matches`` coordinates. Ordered from rare to frequent,
two such texts share a posting among the first ``COORDINATES - matches + 1`` of each (values that one text alone has
stand first and need no list), so only these prefixes are merged; the lists of frequent values are skipped and their
collisions counted from the signatures. Pairs above the match threshold are confirmed on the full sets.

Equal sets are one node. Members of a short list meet pair by pair; those of a long one meet a few pivots first. As links
within one component add nothing, only members of components that are still apart meet then: a list is cut into chunks of
bounded size, two chunks are compared in a task, a pair only in the first list that both its texts are in, and the task
returns which components became one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import floor, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, join_counted
from .components import components, roots, unite

COORDINATES = 32
#: Members of a list that meet pair by pair at once.
SHORT = 12
#: Pivots that all members of a longer list meet first.
PIVOTS = 3
#: Members of a list in one chunk, and shingles of them all on average; a task compares two chunks.
CHUNK, CHUNK_SHINGLES = 1024, 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SEEDS = np.arange(1, COORDINATES + 1, dtype=np.uint64) * _MIX[0]


def threshold_matches(similarity: float) -> int:
    """Coordinates in which texts of this similarity agree but for 7 pairs in a million at 0.8, 19 at 0.85."""
    mean = COORDINATES * similarity
    return max(1, floor(mean - 4.5 * sqrt(mean * (1 - similarity))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word shingles; words are runs of anything but ASCII white space, A-Z in lower case."""

    def __init__(self, words: int, most: int = 400_000) -> None:
        self.words, self.most, self.known = words, most, {}

    def _word(self, w: bytes) -> int:
        self.known[w] = h = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return h

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingles; a text of fewer words is one shingle, one without words none."""
        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        # bytes lower and split know ASCII alone, as the words are defined
        hashes = [known[w] if w in known else self._word(w) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]
        if not hashes:
            return np.empty(0, np.uint64)
        h = np.array(hashes, dtype=np.uint64)
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, np.uint64(len(h) if n < self.words else 0))
        for k in range(n):
            out = _mixed(out * _MIX[0] + h[k : k + len(out)])
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least mixed value of each coordinate, 32 bits."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), 4096):
        low = np.minimum(low, _mixed(shingles[None, k : k + 4096] + _SEEDS[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, sig of every row; no digest and sig without words."""

    @F.pandas_udf("n_shingles long, digest binary, sig array<int>")
    def sign(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for part in parts:
            sets = [shingler.shingles(t) for t in part]
            yield pd.DataFrame(
                {
                    "n_shingles": [len(s) for s in sets],
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "sig": [signature(s) if len(s) else None for s in sets],
                }
            )

    return docs.select("doc_id", sign("text").alias("s")).select("doc_id", "s.*")


def matches(a: Column, b: Column) -> Column:
    """Coordinates in which two signatures agree."""
    return reduce(lambda x, y: x + y, [F.when(a[i] == b[i], 1).otherwise(0) for i in range(COORDINATES)])


def postings(nodes: DataFrame, least: int) -> DataFrame:
    """token, id: the prefix of each node (id, sig); tokens that one node alone has are left out."""
    each = nodes.select("id", F.posexplode("sig").alias("i", "v")).select("id", F.xxhash64("i", "v").alias("token"))
    shared = each.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    ordered = join_counted(each, shared, "token", nodes.count() * COORDINATES).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    # values that no other node has fill the first places
    left = F.lit(COORDINATES - least + 1) - (F.lit(COORDINATES) - F.size("tokens"))
    return ordered.filter(left > 0).select("id", F.explode(F.slice("tokens", F.lit(1), left)).alias("t")).select("id", F.col("t.token").alias("token"))


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough: 100 times intersection and union are compared as integers."""
    least = round(similarity * 100)
    texts = docs.select("doc_id", "text")
    both = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, last, one = Shingler(words), None, None
        for part in parts:
            keep = []
            for a, text_a, text_b in zip(part.a, part.text_a, part.text_b, strict=True):
                if a != last:
                    last, one = a, shingler.shingles(text_a)
                two = shingler.shingles(text_b)
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= least * (len(one) + len(two) - common))
            yield part.loc[keep, ["a", "b"]]

    return both.select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


def joined_lists(members: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of component ids that links join; ``members`` (token, id, c, size) are long lists of several components."""
    percent = round(similarity * 100)
    chunks = members.groupBy("token").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("size") / CHUNK_SHINGLES)).cast("int").alias("chunks"), F.count("*").alias("n"))
    lists = members.groupBy("id").agg(F.collect_list("token").alias("lists"))  # at most a prefix each
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    tile = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda x: F.struct(F.least(x, F.col("chunk")).alias("i"), F.greatest(x, F.col("chunk")).alias("j"), F.when(F.col("chunk") <= x, 0).otherwise(1).alias("side")),
    )
    placed = join_counted(members, chunks, "token", members.count()).join(lists, "id").withColumn("chunk", chunk).select("token", "id", "c", "lists", F.explode(tile).alias("t"))
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    rows = placed.select("token", "id", "c", "lists", "t.*").join(texts, "id")

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        token, i, j = int(key[0]), int(key[1]), int(key[2])
        part = part.sort_values(["id", "side"], kind="stable").reset_index(drop=True)
        shingler = Shingler(words)
        left, right = np.flatnonzero(part.side == 0), np.flatnonzero(part.side == (0 if i == j else 1))
        ids, c = part.id.to_numpy(), part.c.to_numpy()
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        sets = [shingler.shingles(t) for t in part.text]
        size = np.array([len(x) for x in sets])
        earlier = sorted({t for x in part.lists for t in x if t < token})
        member = np.array([[t in x for t in earlier] for x in map(set, part.lists)], dtype=np.float32).reshape(len(part), len(earlier))
        vocabulary, at = np.unique(np.concatenate([sets[r] for r in right]), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size[right])[:-1]])
        _, parent = np.unique(c, return_inverse=True)  # trees of components, not of texts
        of = parent.copy()
        parent = np.arange(parent.max() + 1)
        for a in left:
            open_ = (c[right] != c[a]) & (100 * np.minimum(size[right], size[a]) >= percent * np.maximum(size[right], size[a]))
            if i == j:
                open_ &= ids[right] > ids[a]
            if earlier:
                open_ &= member[right] @ member[a] == 0
            if not open_.any():
                continue
            flags = np.zeros(len(vocabulary), np.int32)
            place = np.searchsorted(vocabulary, sets[a])
            place[place == len(vocabulary)] = 0
            flags[place[vocabulary[place] == sets[a]]] = 1
            common = np.add.reduceat(flags[at], starts)
            linked = right[open_ & (100 * common >= percent * (size[right] + size[a] - common))]
            unite(parent, np.full(len(linked), of[a]), of[linked])
        root = roots(parent, np.arange(len(parent)))
        names = np.unique(c)
        moved = root != np.arange(len(root))
        return pd.DataFrame({"a": names[moved], "b": names[root[moved]]})

    return rows.groupBy("token", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), kept, for every row.

    Null texts and texts without words have no shingles and link with nothing, nor does a row without doc_id; texts of
    fewer words than a shingle are one shingle; texts are read whole; rows that repeat a doc_id are one node; an empty
    table gives no rows; other columns are ignored.
    """
    least = threshold_matches(similarity)
    rows = durable(signed(docs, words))
    inside = rows.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    sets = inside.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"))
    sets = durable(sets)
    lists = durable(postings(sets.select("id", "sig"), least))
    sizes = lists.groupBy("token").agg(F.count("*").alias("n"), *[F.min_by("id", F.xxhash64(F.lit(r), "id")).alias(f"pivot{r}") for r in range(PIVOTS)])
    total = lists.count()
    sized = join_counted(lists, sizes.filter("n > 1"), "token", total)
    known = sets.select("id", "sig", "size")
    alike = lambda p: (  # noqa: E731  pairs (a, b) above the match threshold and near in size
        p.join(known.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"), F.col("size").alias("size_a")), "a")
        .join(known.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("size").alias("size_b")), "b")
        .filter(F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * round(similarity * 100))
        .filter(matches(F.col("sig_a"), F.col("sig_b")) >= least)
        .select("a", "b")
    )
    short = sized.filter(F.col("n") <= SHORT)
    met = short.select("token", F.col("id").alias("a")).join(short.select("token", F.col("id").alias("b")), "token").filter("a < b").select("a", "b")
    long_ = sized.filter(F.col("n") > SHORT)
    stars = long_.select(F.explode(F.array(*[f"pivot{r}" for r in range(PIVOTS)])).alias("a"), F.col("id").alias("b")).filter("a <> b")
    linked = durable(confirmed(durable(alike(met.unionByName(stars).distinct())), docs, words, similarity))
    # two rows may carry one id with different sets: the id joins them
    same = inside.join(sets.select("digest", "id"), "digest").filter("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    reached = durable(components(linked))
    apart = long_.join(reached.withColumnRenamed("component", "c"), "id", "left").select("token", "id", F.coalesce("c", "id").alias("c"))
    mixed = apart.groupBy("token").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("n")).filter("least <> most").select("token", "n")
    more = durable(joined_lists(durable(join_counted(apart, mixed, "token", total).select("token", "id", "c").join(known.select("id", "size"), "id")), docs, words, similarity))
    classes = components(linked.unionByName(more).unionByName(same.select("a", "b"))).withColumnsRenamed({"id": "doc_id", "component": "component_id"})
    out = rows.select("doc_id", "n_shingles").join(classes, "doc_id", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
