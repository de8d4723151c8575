"""Names: aliases, vocabularies, groups, prefixes, labels, and who a term means."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import real_groups
from .graph import dealt

#: Shorter aliases only count where they are the whole name.
LEAST_ALIAS = 2


#: A name of more rows than this is told where its rows lie; there are at most so many times fewer of them than rows.
HOT = 100_000


def normalized(values: DataFrame, column: str, aliases: DataFrame, tasks: int | None = None) -> DataFrame:
    """``values`` with canon and changed; ``aliases`` (alias, canonical, ord) in the order of registration.

    A whole alias gives its canonical name; else the first registered alias of at least two characters that the name holds;
    else the name trimmed. Null and blank names stay as they are. What a name holds is found by joining its pieces of the
    aliases' few lengths, so names never meet all aliases. What the names of more than ``HOT`` rows mean is sent to all tasks;
    their rows and those without a name are dealt by all they hold, the others by name, to ``tasks`` if that is given.
    """
    known = aliases.groupBy("alias").agg(F.max_by("canonical", "ord").alias("canonical"), F.min("ord").alias("ord")).filter("alias <> ''")
    lengths = sorted(r.n for r in known.select(F.length("alias").alias("n")).distinct().collect() if r.n >= LEAST_ALIAS)
    name = F.trim(F.col(column))
    distinct = values.select(name.alias("name_")).filter("name_ <> ''").groupBy("name_").agg(F.count("*").alias("n_"))
    exact = distinct.join(known.select(F.col("alias").alias("name_"), F.col("canonical").alias("exact_")), "name_", "left")
    pieces = F.flatten(F.array(*[F.when(F.length("name_") >= n, F.transform(F.sequence(F.lit(1), F.length("name_") - n + 1), lambda i: F.substring("name_", i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in lengths])) if lengths else F.array().cast("array<string>")  # noqa: B023
    held = (
        exact.filter("exact_ IS NULL")
        .select("name_", F.explode(F.array_distinct(pieces)).alias("alias"))
        .join(known, "alias")
        .groupBy("name_")
        .agg(F.min_by("canonical", "ord").alias("held_"))
    )
    found = exact.join(held, "name_", "left").select("name_", "n_", F.coalesce("exact_", "held_").alias("told_"))
    hot = found.filter(F.col("n_") > HOT).select("name_", "told_", F.lit(True).alias("hot_"))
    rest = found.filter((F.col("n_") <= HOT) & F.col("told_").isNotNull()).select(F.col("name_").alias("key_"), F.xxhash64("name_").alias("at_"), F.col("told_").alias("rest_"))
    out = values.withColumn("name_", name).join(F.broadcast(hot), "name_", "left")
    alone = F.col("hot_").isNotNull() | F.coalesce(F.col("name_") == "", F.lit(True))
    held_by = [c for c, kind in values.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = out.withColumns({"key_": F.when(~alone, F.col("name_")), "at_": F.when(alone, F.xxhash64(*held_by)).otherwise(F.xxhash64("name_"))})
    out = keyed.join(dealt(rest, tasks, "key_", "at_"), ["key_", "at_"], "left").withColumn("found_", F.coalesce("told_", "rest_"))
    canon = F.when(F.coalesce(F.col("name_") == "", F.lit(True)), F.col(column)).otherwise(F.coalesce("found_", "name_"))
    return out.withColumns({"canon": canon, "changed": F.coalesce(F.col("found_") != F.col("name_"), F.lit(False))}).drop("name_", "found_", "told_", "rest_", "hot_", "key_", "at_")


def mapped(rows: DataFrame, column: str, mapping: DataFrame, other: str) -> DataFrame:
    """``rows`` with canon: what ``mapping`` (raw, canonical) says, a canonical value itself, else ``other``."""
    canon = mapping.select(F.col("canonical").alias("raw")).distinct().withColumn("canonical", F.col("raw"))
    every = mapping.select("raw", "canonical").unionByName(canon.join(mapping.select("raw"), "raw", "left_anti"))
    return rows.join(every.withColumnsRenamed({"raw": column, "canonical": "canon"}), column, "left").withColumn("canon", F.coalesce("canon", F.lit(other)))


def name_pattern(glob: str) -> str:
    """A regular expression for a glob over names, in which ``*`` is anything."""
    return "^" + "".join({"*": ".*", "?": "."}.get(p, re.escape(p)) for p in re.split(r"(\*|\?)", glob)) + "$"


def loose_name(stem: Column) -> Column:
    """The beginning of a file's name up to ``_``, without a leading number and a trailing bracket; the name where nothing is left."""
    head = F.trim(F.regexp_replace(F.trim(F.substring_index(stem, "_", 1)), r"^[0-9]{1,2}[.\-、]?", ""))
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(head, r"\s*[(（\[【][^)）\]】]*[)）\]】]\s*$", "")), F.lit("")), stem)


def group_of(path: Column, rules: Sequence[tuple[str, str]] = (), known: Sequence[str] = (), aliases: Mapping[str, str] | None = None) -> Column:
    """Struct (grp, why) of a file below the root: a rule (glob over its name or path), a known group, the longest known group
    that folder and name hold (ties: the first listed), an alias, else the folder or the beginning of the name."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    raw = F.when(F.size(parts) > 1, parts[0]).otherwise(loose_name(stem))
    probe = F.concat(raw, F.lit(" "), stem)
    told = lambda grp, why: F.struct(grp.alias("grp"), F.lit(why).alias("why"))
    candidates = [F.when(name.rlike(name_pattern(g)) | path.rlike(name_pattern(g)), told(F.lit(to), "rule")) for g, to in rules]
    candidates += [F.when(raw.isin(*known), told(raw, "known"))] if known else []
    candidates += [F.when(F.contains(probe, F.lit(k)), told(F.lit(k), "held")) for k in sorted(known, key=len, reverse=True) if k]
    candidates += [F.when(raw == a, told(F.lit(to), "alias")) for a, to in (aliases or {}).items()]
    return F.coalesce(*candidates, told(raw, "name"))


def id_prefix(grp: Column, registered: Mapping[str, str], asked: Column | None = None) -> Column:
    """The prefix of a group's ids: registered, else asked, else six ASCII letters and digits of its name, else a digest."""
    of = [F.when(grp == g, F.lit(p)) for g, p in registered.items()]
    ascii_ = F.substring(F.lower(F.regexp_replace(grp, "[^A-Za-z0-9]", "")), 1, 6)
    fallback = F.coalesce(F.nullif(ascii_, F.lit("")), F.concat(F.lit("t"), F.substring(F.sha1(grp.cast("binary")), 1, 4)))
    return F.coalesce(*of, *([F.nullif(asked, F.lit(""))] if asked is not None else []), fallback)


def speaker(label: Column) -> Column:
    """A speaker's label without the bracket at its end; the label where nothing else is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(label, r"（[^）]*）\s*$", "")), F.lit("")), label)


def file_tag(name: Column, most: int = 40) -> Column:
    """A name that can stand in a file's name."""
    return F.coalesce(F.nullif(F.substring(F.btrim(F.regexp_replace(name, r'[\\/:*?"<>|]', "_"), F.lit(" .")), 1, most), F.lit("")), F.lit("part"))


def roster(nodes: DataFrame) -> DataFrame:
    """id, name, aliases, groups, tags, played_by, with empty values for missing ones."""
    none = F.expr("CAST(array() AS array<string>)")
    column = lambda c, default: (F.coalesce(F.col(c), default) if c in nodes.columns else default).alias(c)
    return nodes.select("id", "name", *[column(c, none) for c in ("aliases", "groups", "tags")], column("played_by", F.lit("")))


def canon_block(nodes: DataFrame, grp: str) -> DataFrame:
    """id, name, detail, line of a group's roster: its own members in full (a line each), of all others the name alone."""
    own = F.array_contains("groups", grp)
    aliases = F.when(F.size("aliases") > 0, F.concat(F.lit("（"), F.array_join("aliases", "、"), F.lit("）"))).otherwise("")
    played = F.when(F.col("played_by") != "", F.concat(F.lit(" | "), "played_by")).otherwise("")
    full = F.concat("id", F.lit(" "), "name", aliases, played, F.lit(" | "), F.array_join("groups", "、"))
    return roster(nodes).filter(own | (F.col("name") != "")).select("id", "name", own.alias("detail"), F.when(own, full).otherwise(F.col("name")).alias("line"))


def resolved(nodes: DataFrame, terms: Sequence[str]) -> DataFrame:
    """term, tier, id: whom each of the given terms means, by the first tier that anyone meets: 1 the id, 2 the name, 3 a part
    of the name, 4 an alias or a part of one. Every node is looked at once; only hits are shuffled."""
    aliases = F.coalesce("aliases", F.expr("CAST(array() AS array<string>)"))
    tier = lambda t: (
        F.when(F.col("id") == t, 1).when(F.col("name") == t, 2).when(F.contains(F.col("name"), t), 3).when(F.exists(aliases, lambda a: F.contains(a, t)), 4)
    )
    hits = F.filter(F.array(*[F.struct(F.lit(t).alias("term"), tier(F.lit(t)).alias("tier")) for t in terms]), lambda h: h["tier"].isNotNull())
    each = nodes.select("id", F.explode(hits).alias("h")).select("h.term", "h.tier", "id")
    return each.join(each.groupBy("term").agg(F.min("tier").alias("tier")), ["term", "tier"]).select("term", "tier", "id")


def groups_or(groups: Column, default: str) -> Column:
    """A node's real groups, or ``default`` alone."""
    real = real_groups(groups)
    return F.when(F.size(real) == 0, F.array(F.lit(default))).otherwise(real)
