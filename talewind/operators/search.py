"""Searching texts and graphs: ranked search, facets, terms in lines, patterns with excerpts, evidence about names, leaked prompts."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import squeezed, squeezed_plain
from ..sources.durable import durable

#: What an item of a kind has before any term is found; a term at a name's beginning, inside it, and in all its text.
BONUS = {"node": 5, "group": 3}
STARTS, INSIDE, ANYWHERE = 14, 7, 2


def search_items(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, key, name, hay: everything that can be found. ``nodes`` (id, name, groups, attrs: a map of arrays, hay), ``edges``
    (src, dst, type, event). Each value of an attribute and each group is an item once."""
    people = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("key"), "name", F.concat_ws("\n", "name", "hay").alias("hay"))
    pairs = nodes.select(F.explode("attrs").alias("dim", "values")).select("dim", F.explode("values").alias("value")).filter("value <> ''").distinct()
    tags = pairs.select(F.lit("tag").alias("kind"), F.concat_ws("=", "dim", "value").alias("key"), F.concat_ws(": ", "dim", "value").alias("name"), F.concat_ws(" ", "dim", "value").alias("hay"))
    groups = nodes.select(F.explode("groups").alias("key")).distinct().select(F.lit("group").alias("kind"), "key", F.col("key").alias("name"), F.col("key").alias("hay"))
    end = lambda side: nodes.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"))
    both = edges.join(end("src"), "src").join(end("dst"), "dst")
    relations = both.select(
        F.lit("edge").alias("kind"),
        F.concat_ws("|", "src", "dst", "type").alias("key"),
        F.concat("src_name", F.lit(" "), "type", F.lit(" "), "dst_name").alias("name"),
        F.concat_ws(" ", "src_name", "dst_name", "type", "event").alias("hay"),
    )
    return people.unionByName(tags).unionByName(groups).unionByName(relations)


def ranked(items: DataFrame, query: str, most: int = 50) -> DataFrame:
    """kind, key, name, score of the ``most`` best items that hold every word of the query; ties by kind and key."""
    terms = query.lower().split()
    name, hay = F.lower("name"), F.lower("hay")
    score = F.coalesce(*[F.when(F.col("kind") == k, b) for k, b in BONUS.items()], F.lit(0))
    every = F.lit(bool(terms))
    for t in map(F.lit, terms):
        score = score + F.when(F.startswith(name, t), STARTS).when(F.contains(name, t), INSIDE).otherwise(0) + F.when(F.contains(hay, t), ANYWHERE).otherwise(0)
        every = every & (F.contains(name, t) | F.contains(hay, t))
    return items.filter(every).select("kind", "key", "name", score.cast("int").alias("score")).orderBy(F.desc("score"), "kind", "key").limit(most)


def facet_counts(nodes: DataFrame) -> DataFrame:
    """dim, value, n of ``nodes`` (attrs: a map of arrays)."""
    each = nodes.select(F.explode("attrs").alias("dim", "values")).select("dim", F.explode("values").alias("value"))
    return each.groupBy("dim", "value").agg(F.count("*").alias("n"))


def facet_hits(wanted: Sequence[tuple[str, str]]) -> Column:
    """How many of the wanted values (dimension, value) the column attrs (a map of arrays) has."""
    return F.size(F.filter(F.array(*[F.coalesce(F.array_contains(F.try_element_at("attrs", F.lit(d)), v), F.lit(False)) for d, v in wanted]), lambda x: x))


def with_facets(nodes: DataFrame, wanted: Sequence[tuple[str, str]], every: bool) -> DataFrame:
    """``nodes`` (attrs) that have one of the wanted values (dimension, value), or all."""
    return nodes.filter(facet_hits(wanted) == len(wanted) if every else facet_hits(wanted) > 0)


def term_hits(lines: DataFrame, line: str, terms: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``keys`` and term of every line that holds one of the given terms."""
    hit = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col(line), t))
    return lines.select(*keys, F.explode(hit).alias("term"))


def first_hits(lines: DataFrame, file: str, start: str, end: str, text: str, terms: Sequence[str], pad: float) -> DataFrame:
    """file, term, hits, clip_start, clip_end, text of each term's first line in a file, ``pad`` seconds wider on both sides."""
    each = term_hits(lines, text, terms, [file, start, end, text])
    first = F.min(F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(text).alias("t"))).alias("f")
    found = each.groupBy(file, "term").agg(F.count("*").alias("hits"), first)
    return found.select(file, "term", "hits", F.greatest(F.col("f.s") - pad, F.lit(0.0)).alias("clip_start"), (F.col("f.e") + pad).alias("clip_end"), F.col("f.t").alias("text"))


def pattern_hits(texts: DataFrame, text: str, key: str, patterns: Mapping[str, str], around: int = 30, shown: int = 3) -> DataFrame:
    """pattern, hits, texts, excerpts: how often each pattern is found, in how many texts, and the first ``shown`` of them by key
    with ``around`` code points on both sides of their first hit."""
    one = lambda name, p: F.struct(F.lit(name).alias("pattern"), F.regexp_count(F.col(text), F.lit(p)).alias("hits"))
    each = texts.select(key, text, F.explode(F.array(*[one(n, p) for n, p in patterns.items()])).alias("m")).filter("m.hits > 0")
    # where the first hit stands: what the pattern finds first is also where that very text stands first or later, so its
    # place is looked for from the text before it
    of = lambda find: F.coalesce(*[F.when(F.col("m.pattern") == n, find(p)) for n, p in patterns.items()])
    hit = of(lambda p: F.regexp_substr(F.col(text), F.lit(p)))
    at = of(lambda p: F.length(F.regexp_extract(F.col(text), f"(?s)^(.*?)(?:{p})", 1)))
    first = F.row_number().over(W.partitionBy("pattern").orderBy(key))
    begin = F.greatest(at - around, F.lit(0))
    cut = each.select("m.pattern", "m.hits", F.col(key), F.substring(F.col(text), begin + 1, at - begin + F.length(hit) + around).alias("excerpt"))
    counts = each.groupBy("m.pattern").agg(F.sum("m.hits").alias("hits"), F.count("*").alias("texts"))
    some = cut.withColumn("place", first).filter(F.col("place") <= shown)
    return counts.join(some.groupBy("pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "excerpt"))), lambda s: s["excerpt"]).alias("excerpts")), "pattern", "left")  # each has some; left, so nobody ranks them who doesn't ask for excerpts


#: Names of so many bytes in all are sent to every task; of a longer list each group's names are dealt in parts of as many, and
#: its lines in blocks of so many characters.
NAMES_BYTES, BLOCK_CHARS = 8 << 20, 64 << 20


def _automaton(rows: Iterable[tuple[str, list]]):
    """One automaton over (name, groups)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for name, groups in rows:
        found.add_word(name, (name, frozenset(groups)))
    found.make_automaton()
    return found


def _found(automaton, grp: str | None, line: str | None) -> list[str]:
    return sorted({name for _, (name, groups) in automaton.iter(line) if grp in groups}) if line else []


def names_in(lines: DataFrame, names: DataFrame, line: str = "sentence", names_bytes: int = NAMES_BYTES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """grp, the line and name for every line of ``lines`` (grp, line) and every one of its group's ``names`` (grp, name) that
    stands anywhere in it, once; no blanks are needed around a name.

    A line is read once by an automaton over all names, whatever their number. The names are broadcast up to ``names_bytes``;
    beyond that those of a group meet only its own lines, in parts of that size. Null and empty names and lines are in nothing;
    a null group is a group; repeated lines and names count once.
    """
    spark, of = lines.sparkSession, lines.select("grp", F.col(line).alias("line_")).filter("line_ <> ''").distinct()
    known = names.select("grp", "name").filter("name <> ''").distinct()
    size = known.agg(F.sum(F.octet_length("name") + 16)).first()[0] or 0
    schema = "grp string, line_ string, name string"
    if size <= names_bytes:
        sent = spark.sparkContext.broadcast([(r.name, r.groups + [None] * r.no_group) for r in known.groupBy("name").agg(F.collect_list("grp").alias("groups"), F.max(F.col("grp").isNull().cast("int")).alias("no_group")).collect()])

        def searched(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = _automaton(sent.value) if sent.value else None
            for part in parts:
                rows = [(g, x, n) for g, x in zip(part.grp.astype(object).where(part.grp.notna(), None), part.line_, strict=True) for n in (_found(automaton, g, x) if automaton else ())]
                yield pd.DataFrame(rows, columns=["grp", "line_", "name"], dtype=object)

        found = of.mapInPandas(searched, schema)
    else:
        group = F.coalesce(F.concat(F.lit("."), "grp"), F.lit(""))
        parts = known.groupBy(group.alias("g_")).agg(F.ceil(F.sum(F.octet_length("name") + 16) / names_bytes).cast("int").alias("parts_"))
        blocks = of.groupBy(group.alias("g_")).agg(F.ceil(F.sum(F.length("line_")) / block_chars).cast("int").alias("blocks_"))
        counts = durable(parts.join(blocks, "g_"))
        deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = known.withColumn("g_", group).join(counts, "g_").withColumn("part_", deal("parts_", "name")).withColumn("block_", every("blocks_"))
        right = of.withColumn("g_", group).join(counts, "g_").withColumn("block_", deal("blocks_", "line_")).withColumn("part_", every("parts_"))

        def met(some: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
            rows = []
            if not some.empty and not texts.empty:
                automaton = _automaton((n, [None]) for n in some.name)
                g = None if pd.isna(texts.grp.iloc[0]) else texts.grp.iloc[0]
                rows = [(g, x, n) for x in texts.line_ for n in _found(automaton, None, x)]
            return pd.DataFrame(rows, columns=["grp", "line_", "name"], dtype=object)

        key = ["g_", "part_", "block_"]
        left, right = left.select(*key, "name"), right.select(*key, "grp", "line_")
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(met, schema)
    return found.withColumnRenamed("line_", line)


def evidence(people: DataFrame, sentences: DataFrame, words: Sequence[str], most: int = 900) -> DataFrame:
    """id, place, sentence, telling: what a group's sentences say of its people, within ``most`` characters each.

    ``people`` has id, grp and names (array), ``sentences`` grp, no and sentence. A sentence in which one of a person's names
    stands, with or without blanks around it, is a hit, once; those with one of ``words`` come first (telling), the pick ends
    before the first that doesn't fit. As each has a character at least, no more than ``most`` of a person's are sorted.
    """
    names = people.select("id", "grp", F.explode("names").alias("name")).filter("name <> ''").distinct()
    once = sentences.groupBy("grp", "sentence").agg(F.min("no").alias("no"))
    met = names_in(once, names).withColumnsRenamed({"grp": "g_", "sentence": "s_", "name": "n_"})
    hits = met.join(once, F.col("g_").eqNullSafe(F.col("grp")) & (F.col("s_") == F.col("sentence"))).select("g_", "n_", "no", "sentence")
    hits = hits.join(names, F.col("g_").eqNullSafe(F.col("grp")) & (F.col("n_") == F.col("name")))
    telling = F.lit(False)
    for w in words:
        telling = telling | F.contains(F.col("sentence"), F.lit(w))
    each = hits.select("id", "no", "sentence").distinct().withColumn("telling", telling)
    order = W.partitionBy("id").orderBy(F.desc("telling"), "no", "sentence")
    first = each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    run = F.sum(F.length("sentence")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return first.withColumn("run", run).filter(F.col("run") <= most).select("id", "place", "sentence", "telling")


def holding(docs: DataFrame, text: str, passages: DataFrame, passage: str, names_bytes: int = NAMES_BYTES) -> DataFrame:
    """The columns of ``docs`` and ``passages`` for every text that holds a passage.

    A text is read once by an automaton over all passages, where it lies; of a list beyond ``names_bytes`` the texts are
    dealt as :func:`names_in` deals them. Every text holds an empty passage, no text a null.
    """
    spark = docs.sparkSession
    known = passages.select(F.col(passage).alias("name")).filter("name <> ''").distinct()
    size = known.agg(F.sum(F.octet_length("name") + 16)).first()[0] or 0
    if size <= names_bytes:
        sent = spark.sparkContext.broadcast([r.name for r in known.collect()])

        @F.pandas_udf("array<string>")
        def held(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            automaton = _automaton((n, [None]) for n in sent.value) if sent.value else None
            for part in parts:
                yield pd.Series([_found(automaton, None, x) if automaton else [] for x in part], index=part.index, dtype=object)

        found = docs.withColumn("held_", F.explode(held(F.col(text))))
    else:
        lines = docs.select(F.lit("").alias("grp"), F.col(text).alias("line_"))
        met = names_in(lines, known.withColumn("grp", F.lit("")), "line_", names_bytes).select("line_", F.col("name").alias("held_"))
        found = docs.join(met, F.col(text) == F.col("line_")).drop("line_")
    some = found.join(passages, F.col("held_") == passages[passage]).drop("held_")
    return some.unionByName(docs.join(passages.filter(F.col(passage) == ""), F.contains(F.col(text), F.col(passage))))


#: Picks and vectors of one comparison.
PICKS, VECTORS = 8192, 8192


def _components(column: pa.ChunkedArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``dims`` components of each vector, and which of them are there."""
    lists = pa.concat_arrays(column.chunks)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    row, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = at < dims
    values, there = np.zeros((len(sizes), dims)), np.zeros((len(sizes), dims), dtype=bool)
    values[row[first], at[first]] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)[first]
    there[row[first], at[first]] = flat.is_valid().to_numpy(zero_copy_only=False)[first]
    return values, there


def nearest(picks: DataFrame, vectors: DataFrame, dims: int, most_picks: int = PICKS, most_vectors: int = VECTORS) -> DataFrame:
    """vec_id, nearest: for each of ``picks`` (vec_id, embedding) the other of ``vectors`` (vec_id, embedding) with the least sum
    of absolute differences over ``dims`` components, in double precision and in their order; ties to the smaller vec_id.

    Components that either lacks add nothing; a sum that isn't a number is beyond all others, one of nothing beyond that. Both
    sides are dealt in chunks, each of the one meets each of the other, and of a meeting only each pick's best is left: as
    many pairs as asked are computed, none is stored.
    """
    parts, blocks = -(-max(picks.count(), 1) // most_picks), -(-max(vectors.count(), 1) // most_vectors)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = picks.filter("vec_id IS NOT NULL").select("vec_id", "embedding", deal(parts).alias("part_"), every(blocks).alias("block_"))
    right = vectors.filter("vec_id IS NOT NULL").select("vec_id", "embedding", deal(blocks).alias("block_"), every(parts).alias("part_"))
    schema = pa.schema([("vec_id", pa.int64()), ("level", pa.int32()), ("gap", pa.float64()), ("other", pa.int64())])

    def met(some: pa.Table, others: pa.Table) -> pa.Table:
        if not some.num_rows or not others.num_rows:
            return schema.empty_table()
        others = others.sort_by("vec_id")
        q, ids = some["vec_id"].to_numpy(), others["vec_id"].to_numpy()
        (a, a_there), (b, b_there) = _components(some["embedding"], dims), _components(others["embedding"], dims)
        whole, b, b_there = a_there.all() and b_there.all(), np.ascontiguousarray(b.T), np.ascontiguousarray(b_there.T)
        found = []
        for i in range(0, len(q), 16):
            gap, diff = np.zeros((len(q[i : i + 16]), len(ids))), np.empty((len(q[i : i + 16]), len(ids)))
            counted = np.zeros(gap.shape, dtype=bool)
            with np.errstate(all="ignore"):
                for k in range(dims):
                    np.abs(np.subtract(a[i : i + 16, k, None], b[k], out=diff), out=diff)
                    if not whole:
                        both = a_there[i : i + 16, k, None] & b_there[k]
                        diff[~both] = 0
                        counted |= both
                    gap += diff
            level = np.isnan(gap).astype(np.int32)
            if not whole:
                level[~counted] = 2
            level[q[i : i + 16, None] == ids] = 3
            least = level.min(axis=1)
            best = np.where(level == least[:, None], np.where(level > 0, 0.0, gap), np.inf)
            low = best.min(axis=1)
            at = ((level == least[:, None]) & (best == low[:, None])).argmax(axis=1)  # the first is the smallest vec_id
            found.append(pa.table([q[i : i + 16], least, low, ids[at]], schema=schema).filter(pa.array(least < 3)))
        return pa.concat_tables(found)

    key = ("part_", "block_")
    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(met, "vec_id long, level int, gap double, other long")
    return best.groupBy("vec_id").agg(F.min(F.struct("level", "gap", "other")).alias("b")).select("vec_id", F.col("b.other").alias("nearest"))


def is_leak(text: Column, prompt: str, threshold: float = 0.8) -> Column:
    """Whether a line is a piece of the prompt: inside it, holding or inside one of its clauses of at least five characters, or
    as similar to one as ``threshold``; lines of less than four characters never are. Blanks and punctuation don't count."""
    whole = squeezed_plain(prompt)
    pieces = [p for p in map(squeezed_plain, re.split(r"[，。！？；,;.!?]", prompt)) if len(p) >= 5]

    @F.pandas_udf("boolean")
    def leaks(lines: pd.Series) -> pd.Series:
        def one(x: str) -> bool:
            if len(x) < 4:
                return False
            if x in whole or any(p in x or x in p for p in pieces):
                return True
            for p in pieces:
                if 2 * min(len(x), len(p)) >= threshold * (len(x) + len(p)):
                    m = difflib.SequenceMatcher(None, x, p)
                    if m.quick_ratio() >= threshold and m.ratio() >= threshold:
                        return True
            return False

        return pd.Series([one(x) for x in lines], dtype=bool)

    if not whole:
        return F.lit(False)
    return leaks(squeezed(F.coalesce(text, F.lit(""))))
