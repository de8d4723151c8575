"""Scalar functions of the archive: built-in expressions, and Arrow functions where Spark has none."""

from __future__ import annotations

import difflib
import html
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

# White space and the punctuation that a comparison of lines ignores.
_IGNORED = r"[\s，。！？、；：,.!?;:~～…—\-（）()【】\[\]「」『』\"'“”‘’]"
# Names that stand in a group list without being groups.
RESERVED_GROUPS = ("待确认", "KP", "PC", "NPC", "BOSS", "")


def squeezed(text: Column) -> Column:
    """``text`` without white space and punctuation."""
    return F.regexp_replace(text, _IGNORED, "")


def squeezed_plain(text: str) -> str:
    """:func:`squeezed` of a plain string."""
    return re.sub(_IGNORED, "", text)


def real_groups(groups: Column) -> Column:
    """The entries of a group array that name groups; a null array is empty."""
    return F.filter(F.coalesce(groups, F.expr("CAST(array() AS array<string>)")), lambda g: F.coalesce(~g.isin(*RESERVED_GROUPS), F.lit(False)))


def stripped(text: Column | str) -> Column:
    """``text`` without white space of any script at its ends."""
    return F.regexp_replace(text, r"^[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+|[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+$", "")


def clipped(text: Column, most: int) -> Column:
    """The trimmed text's first ``most`` code points; null where nothing is left."""
    return F.nullif(F.substring(F.trim(text), 1, most), F.lit(""))


def code_point_bucket(text: Column, buckets: int) -> Column:
    """A stable bucket: the sum of the code points modulo ``buckets``."""
    points = F.transform(F.split(F.coalesce(text, F.lit("")), ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c)))
    return F.aggregate(points, F.lit(0), lambda a, x: a + x) % buckets


def clock(seconds: Column) -> Column:
    """Seconds as ``XhYYm``."""
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit("h"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lit("m"))


def combined_digest(digests: Column) -> Column:
    """One digest of an array of (name, digest) in any order: 32 hex digits of the sorted parts with their separators."""
    parts = F.transform(F.array_sort(digests), lambda d: F.concat(d["name"], F.lit("\x00"), d["digest"], F.lit("\x01")))
    return F.substring(F.sha2(F.array_join(parts, "").cast("binary"), 256), 1, 32)


def attributes(text: Column) -> Column:
    """A map of lines ``name: value、value``; lines without a colon and names without values are left out, of repeated names
    the last counts (null: empty)."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.contains(x, F.lit(":")))
    name = lambda x: F.trim(F.substring_index(x, ":", 1))
    values = lambda x: F.filter(F.transform(F.split(F.substr(x, F.instr(x, ":") + 1), "、"), lambda v: F.trim(v)), lambda v: v != "")
    pairs = F.transform(lines, lambda x: F.struct(name(x).alias("key"), values(x).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.filter(last, lambda p: (p["key"] != "") & (F.size(p["value"]) > 0)))


def minutes(seconds: Column) -> Column:
    """Seconds as ``m:ss``."""
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


@F.pandas_udf(StringType())
def stamp(seconds: pd.Series) -> pd.Series:
    """Seconds with two decimals, seven characters wide, rounded as the exact binary value is; Spark's format rounds its
    shortest decimal form, which differs at ties."""
    return pd.Series([None if pd.isna(x) else f"{x:07.2f}" for x in seconds], dtype=object)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts (null: empty); Spark has distances only."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(LongType())
def fnv1a_utf16(text: pd.Series) -> pd.Series:
    """32-bit FNV-1a over UTF-16 code units (null: empty)."""
    out = []
    for t in text:
        h = 0x811C9DC5
        units = (t or "").encode("utf-16-le", "surrogatepass")
        for i in range(0, len(units), 2):
            h = (h ^ (units[i] | units[i + 1] << 8)) * 0x01000193 & 0xFFFFFFFF
        out.append(h)
    return pd.Series(out)


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of a file's bytes: by its mark, else UTF-8, GB 18030, Latin-1; null for binary files (a zero byte, no mark)."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        raw = bytes(raw)
        for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
            if raw.startswith(mark):
                return raw.decode(name, "replace")
        if b"\x00" in raw:
            return None
        for name in ("utf-8", "gb18030"):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
        return raw.decode("latin-1")

    return pd.Series([one(x) for x in content], dtype=object)


@F.pandas_udf(StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """The paragraphs of a .docx file's body, a line each; null where the bytes are no such archive."""

    def one(raw: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(raw or b""))) as packed:
                body = packed.read("word/document.xml").decode("utf-8", "replace")
        except (zipfile.BadZipFile, KeyError):
            return None
        paragraphs = re.findall(r"<w:p[ >].*?</w:p>", body, re.S)
        return "\n".join(html.unescape("".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", p, re.S))) for p in paragraphs)

    return pd.Series([one(x) for x in content], dtype=object)


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob; ``dir/**`` is any depth below dir."""
    parts = re.split(r"(\*\*/?|\*|\?)", glob)
    return "^" + "".join({"**": ".*", "**/": "(?:.*/)?", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts) + "$"
