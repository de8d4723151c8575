"""Entries that come as JSON text: parsed from replies with prose around them, held against a schema, cut to what a kind may hold.

All of it is expressions over VARIANT, so a field of the wrong type is seen as what it is and costs no row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped

_ISSUES = "CAST(array() AS array<struct<place: string, level: string, issue: string>>)"
_TEXTS = "CAST(array() AS array<string>)"


def json_reply(reply: Column) -> Column:
    """The JSON value of a reply (VARIANT) that may stand in a fence or among prose; null where none can be read.

    A fence at the beginning is opened first; if what is left isn't JSON, what stands between the first and last brace is tried,
    then between the first and last bracket.
    """
    text = stripped(reply)
    inside = F.regexp_extract(text, r"(?s)^```(.*?)(?:```|$)", 1)
    body = stripped(F.when(F.startswith(text, F.lit("```")), F.regexp_replace(inside, r"(?is)^\s*json", "")).otherwise(text))
    among = [F.try_parse_json(F.nullif(F.regexp_extract(body, p, 0), F.lit(""))) for p in (r"(?s)\{.*\}", r"(?s)\[.*\]")]
    return F.coalesce(F.try_parse_json(body), *among)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def kind_of(value: Column) -> Column:
    """object, array, string, boolean, number or null of a VARIANT; SQL's null for none."""

    def told(of: Column) -> Column:
        nested = F.when(F.startswith(of, F.lit("OBJECT")), "object").when(F.startswith(of, F.lit("ARRAY")), "array")
        return nested.when(of == "STRING", "string").when(of == "BOOLEAN", "boolean").when(of == "VOID", "null").when(of.isNotNull(), "number")

    return once(F.schema_of_variant(value), told)


def inside(value: Column, name: str) -> Column:
    """A field of a VARIANT object; SQL's null where it has none."""
    return F.try_variant_get(value, f"$['{name}']", "variant")


def text_of(value: Column) -> Column:
    """The string that a VARIANT is; null for anything else."""
    return once(value, lambda v: F.when(kind_of(v) == "string", F.try_variant_get(v, "$", "string")))


def list_of(value: Column) -> Column:
    """The items of a VARIANT array; null for anything else."""
    return once(value, lambda v: F.when(kind_of(v) == "array", F.try_variant_get(v, "$", "array<variant>")))


@dataclass(frozen=True)
class Rule:
    """What a value must be: its ``kinds``; of a string the ``least`` length, the values it ``usually`` has (others are warned of);
    of an array the rule of its items; of an object the rules of its fields and which it must have."""

    kinds: tuple[str, ...] = ("string",)
    least: int = 0
    usually: tuple[str, ...] = ()
    items: Rule | None = None
    fields: Mapping[str, Rule] = field(default_factory=dict)
    required: tuple[str, ...] = ()


_TEXT, _NAME, _MAYBE, _LIST = Rule(), Rule(least=1), Rule(("string", "null")), Rule(("array",), items=Rule())
_OBJECTS = Rule(("array",), items=Rule(("object",)))
_EVENT = Rule(("object",), fields={"group": _TEXT, "items": _LIST}, required=("group", "items"))
# The usual strengths of a relation, and the fields of each kind of entry.
STRENGTHS = ("强", "中", "弱")
RULES = {
    "characters": Rule(
        ("object",),
        fields={
            "id": _NAME, "name": _NAME, "aliases": _LIST, "identity": _MAYBE, "groups": _LIST, "tags": _LIST, "played_by": _MAYBE, "played_by_alt": _MAYBE, "note": _MAYBE,
            "avatar": _MAYBE, "in_graph": Rule(("boolean", "null")), "events": Rule(("array",), items=_EVENT),
        },
        required=("id", "name", "groups"),
    ),
    "relations": Rule(("object",), fields={"from": _NAME, "to": _NAME, "type": _NAME, "strength": Rule(usually=STRENGTHS), "event": _TEXT}, required=("from", "to", "type", "strength", "event")),
    "players": Rule(("object",), fields={"uid": _NAME, "uin": _MAYBE, "qq_name": _MAYBE, "real_alias": _MAYBE, "note": _MAYBE, "roles": _OBJECTS, "alt_accounts": _OBJECTS}, required=("uid",)),
    "pl_profiles": Rule(
        ("object",),
        fields={"uid": _NAME, "name": _NAME, "aliases": _LIST, "groups_played": _LIST, "cards": _OBJECTS, "speaking_style": _MAYBE, "rp_style": _MAYBE, "impressions": _LIST, "highlights": _LIST, "avatar": _MAYBE},
        required=("uid", "name"),
    ),
}
IDS = {"characters": "id", "players": "uid", "pl_profiles": "uid"}


def issues_of(value: Column, rule: Rule, place: Column) -> Column:
    """Array of (place, level, issue): where a VARIANT breaks a rule; places are paths like ``/events/0/group``."""
    told = lambda when, level, issue, at=place: F.when(when, F.array(F.struct(at.alias("place"), F.lit(level).alias("level"), issue.alias("issue"))))
    kind = kind_of(value)
    parts = [told(~kind.isin(*rule.kinds), "error", F.concat(F.lit("is "), kind, F.lit(f", not {' or '.join(rule.kinds)}")))]
    if rule.least:
        parts.append(told(F.length(text_of(value)) < rule.least, "error", F.lit(f"has less than {rule.least} characters")))
    for name in rule.required:
        parts.append(told((kind == "object") & inside(value, name).isNull(), "error", F.lit(f"lacks {name}")))
    for name, of in rule.fields.items():
        at, one = F.concat(place, F.lit(f"/{name}")), inside(value, name)
        parts.append(F.when((kind == "object") & one.isNotNull(), issues_of(one, of, at)))
        if of.usually:
            unusual = (kind == "object") & ~F.coalesce(text_of(one).isin(*of.usually), F.lit(False))
            parts.append(told(unusual, "warn", F.lit(f"isn't {', '.join(of.usually)}"), at))
    if rule.items is not None:
        parts.append(F.flatten(F.transform(list_of(value), lambda x, i: issues_of(x, rule.items, F.concat(place, F.lit("/"), i.cast("string"))))))
    return F.flatten(F.array(*[F.coalesce(p, F.expr(_ISSUES)) for p in parts]))


def validated(entries: DataFrame, rule: Rule, key: str | None = None) -> DataFrame:
    """idx, place, level, issue of ``entries`` (idx, doc: JSON text) that break the rule; with ``key`` also entries whose key an
    earlier one has. A text that isn't JSON, null too, is an error at the root; a sound entry gives no row."""
    parsed = entries.select("idx", F.try_parse_json("doc").alias("value"))
    broken = F.array(F.struct(F.lit("/").alias("place"), F.lit("error").alias("level"), F.lit("no JSON").alias("issue")))
    found = F.when(F.col("value").isNull(), broken).otherwise(F.transform(issues_of(F.col("value"), rule, F.lit("")), lambda i: i.withField("place", F.coalesce(F.nullif(i["place"], F.lit("")), F.lit("/")))))
    issues = parsed.select("idx", F.explode(found).alias("i")).select("idx", "i.place", "i.level", "i.issue")
    if key is None:
        return issues
    keyed = parsed.select("idx", text_of(inside(F.col("value"), key)).alias("key")).filter("key IS NOT NULL")
    first = keyed.groupBy("key").agg(F.min("idx").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = keyed.join(first, "key").filter("idx > first")
    return issues.unionByName(again.select("idx", F.lit(f"/{key}").alias("place"), F.lit("error").alias("level"), F.concat(F.lit("an earlier entry has "), "key").alias("issue")))


@dataclass(frozen=True)
class Kept:
    """What an entry may hold: texts with their longest length, lists with the most items and their length, and one field of
    dimensions with its most names, their length, the length of a value and the most values."""

    texts: Mapping[str, int]
    lists: Mapping[str, tuple[int, int]] = field(default_factory=dict)
    dims: Mapping[str, tuple[int, int, int, int]] = field(default_factory=dict)


# What suggestions about nodes and relations may hold.
KEPT = {
    "node": Kept(
        {"id": 64, "name": 80, "identity": 400, "note": 4000, "profile": 12000, "played_by": 80},
        {"aliases": (20, 80), "groups": (20, 80), "tags": (10, 40)},
        {"attrs": (40, 30, 120, 12)},
    ),
    "relation": Kept({"from": 64, "to": 64, "type": 60, "strength": 10, "event": 4000, "raw": 120}),
}


def _cut(value: Column, most: int) -> Column:
    return once(F.substring(stripped(text_of(value)), 1, most), lambda t: F.when(t != "", t))


def _cut_list(value: Column, many: int, most: int) -> Column:
    whole = F.filter(F.transform(list_of(value), lambda x: stripped(text_of(x))), lambda x: x.isNotNull() & (x != ""))
    return F.slice(F.transform(whole, lambda x: F.substring(x, 1, most)), 1, many)


def _fields(value: Column, doc: Column, kept: Kept) -> list[Column]:
    out = [_cut(inside(value, c), most).alias(c) for c, most in kept.texts.items()]
    out += [_cut_list(inside(value, c), *most).alias(c) for c, most in kept.lists.items()]
    for c, (many, name, most, values) in kept.dims.items():
        entries = F.map_entries(F.from_json(F.get_json_object(doc, f"$.{c}"), "map<string, variant>"))
        of = lambda v: F.coalesce(_cut_list(v, values, most), F.filter(F.array(_cut(v, most)), lambda x: x.isNotNull()))  # noqa: E731, B023
        gone = lambda v: v.isNull() | (kind_of(v) == "null")
        pair = lambda e: F.struct(F.substring(stripped(e["key"]), 1, name).alias("key"), once(e["value"], lambda v: F.when(~gone(v), of(v))).alias("value"))  # noqa: E731, B023
        sound = F.filter(F.transform(entries, pair), lambda p: (p["key"] != "") & (p["value"].isNull() | (F.size(p["value"]) > 0)))
        later = lambda all_, p, i: F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_), F.lit(1))), lambda q: q["key"] == p["key"])
        last = once(F.slice(sound, 1, many), lambda all_: F.filter(all_, lambda p, i: ~later(all_, p, i)))  # noqa: B023
        out.append(once(last, lambda x: F.when(F.size(x) > 0, F.map_from_entries(x))).alias(c))
    return out


def cleaned(doc: Column, kept: Kept) -> Column:
    """A struct of what ``doc`` (JSON text of an object) holds of the fields that are ``kept``; everything else is dropped.

    Texts are stripped and cut (null: missing, empty or no string). Lists keep their strings that aren't blank, stripped and
    cut, the first ones (null: missing or no array). Dimensions are a map of arrays in the order of the text: a string is an
    array of one, a null value stays (it deletes the dimension), names and values are stripped and cut, empty ones and other
    types are left out, and of two equal names the last counts. Null for a text that isn't a JSON object.
    """
    return once(F.try_parse_json(doc), lambda v: F.when(kind_of(v) == "object", F.struct(*_fields(v, doc, kept))))


def cleaned_rows(entries: DataFrame, kept: Kept) -> DataFrame:
    """idx and the fields of :func:`cleaned` of the ``entries`` (idx, doc) that are JSON objects; fields nobody asks for aren't computed."""
    parsed = entries.select("idx", "doc", F.try_parse_json("doc").alias("value")).filter(kind_of(F.col("value")) == "object")
    return parsed.select("idx", *_fields(F.col("value"), F.col("doc"), kept))


def with_dimensions(old: Column, new: Column) -> Column:
    """A map of arrays after another's values: a null deletes the dimension, any other replaces it (null maps are empty)."""
    none = "CAST(map() AS map<string, array<string>>)"
    old, new = F.coalesce(old, F.expr(none)), F.coalesce(new, F.expr(none))
    merged = F.map_zip_with(old, new, lambda k, a, b: F.when(F.array_contains(F.map_keys(new), k), b).otherwise(a))
    return F.map_filter(merged, lambda _, v: v.isNotNull())
