"""Readers of the archive's inputs: folders of files, transcripts, chat logs and chat exports; versioned tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import decoded, glob_pattern
from .sinks import exists, names

# A transcript line, a dated chat line.
STAMPED = r"^\[\s*(\d+(?:\.\d+)?)\s*->\s*(\d+(?:\.\d+)?)\s*\]\s?(.*)$"
DATED = r"^\[(\d{2}-\d{2})\s+(\d{2}:\d{2})\]\s*(.*)$"
_EXTENSIONS = {"audio": ("mp3", "wav", "m4a", "flac", "ogg"), "image": ("png", "jpg", "jpeg", "webp", "gif"), "document": ("doc", "docx", "pdf")}
_HEAD, _SNIFFED = 8192, 40


def scan(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path (below ``folder``), length, content of all files below a folder but for those that a glob excludes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(re.sub(r"([*?\[\]{}\\])", r"\\\1", folder))  # no glob
    # where the folder stands in the files' addresses, whatever scheme and host come first; no regular expression, as a
    # folder's name may hold anything
    place = folder.rstrip("/").split("://")[-1].removeprefix("file:") + "/"
    at = F.instr("path", place)
    path = F.when(at > 0, F.substr("path", at + len(place))).otherwise(F.col("path"))
    named = files.select(path.alias("path"), "length", "content")
    for glob in exclude:
        named = named.filter(~F.col("path").rlike(glob_pattern(glob)))
    return named


def classified(files: DataFrame) -> DataFrame:
    """``files`` (path, content) with kind: by extension, else by the head's lines; a transcript before a chat log."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    head = decoded(F.substring("content", 1, _HEAD))
    lines = F.slice(F.filter(F.split(F.coalesce(head, F.lit("")), r"\r?\n"), lambda x: F.trim(x) != ""), 1, _SNIFFED)
    hits = lambda pattern: F.size(F.filter("lines", lambda x: x.rlike(pattern))) >= F.greatest(F.lit(1), F.floor(F.size("lines") / 2))
    kind = F.coalesce(
        *[F.when(extension.isin(*names), k) for k, names in _EXTENSIONS.items()],
        F.when((extension == "json") & F.contains("head", F.lit('"messages"')), "chat_export"),
        F.when(hits(STAMPED), "transcript"),
        F.when(hits(DATED), "chat_log"),
        F.lit("other"),
    )
    return files.withColumn("head", head).withColumn("lines", lines).withColumn("kind", kind).drop("head", "lines")


def reclassified(files: DataFrame, previous: DataFrame) -> DataFrame:
    """``files`` (path, content) with hash (SHA-256) and kind; a file that ``previous`` (path, hash, kind) holds with the same
    hash takes its kind over, only the others' heads are looked at. A kind of null isn't taken over; of paths that repeat in
    ``previous`` the least kind with the same hash is."""
    known = previous.filter("kind IS NOT NULL").groupBy("path", "hash").agg(F.min("kind").alias("known_"))
    hashed = files.withColumn("hash", F.sha2("content", 256)).join(known, ["path", "hash"], "left")
    same = hashed.filter("known_ IS NOT NULL").withColumnRenamed("known_", "kind")
    return same.unionByName(classified(hashed.filter("known_ IS NULL").drop("known_")))


def edge_digest(content: Column, edge: int = 1 << 20) -> Column:
    """32 hex digits of the SHA-256 of a file's first ``edge`` bytes, with its last ones where it has more than twice as many; a
    change between them isn't seen, so compare the lengths too."""
    ends = F.when(F.octet_length(content) > 2 * edge, F.concat(F.substring(content, 1, edge), F.substring(content, -edge, edge))).otherwise(F.substring(content, 1, edge))
    return F.substring(F.sha2(ends, 256), 1, 32)


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line"))


def transcript_lines(texts: DataFrame) -> DataFrame:
    """path, no, start_s, end_s, body of ``texts`` (path, text); a line without a stamp has null times (a reject)."""
    part = lambda i: F.nullif(F.regexp_extract("line", STAMPED, i), F.lit(""))
    return _lines(texts).filter(F.trim("line") != "").select(
        "path", "no", part(1).cast("double").alias("start_s"), part(2).cast("double").alias("end_s"), F.coalesce(part(3), "line").alias("body")
    )


def chat_lines(texts: DataFrame) -> DataFrame:
    """path, no, day, line: lines without a date carry the last one on; before the first it is null (a reject)."""
    day = F.nullif(F.regexp_extract("line", DATED, 1), F.lit(""))
    frame = W.partitionBy("path").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    return _lines(texts).filter(F.trim("line") != "").select("path", "no", F.last(day, ignorenulls=True).over(frame).alias("day"), "line")


EXPORT = (
    "chatInfo struct<name: string, groupName: string>, messages array<struct<timestamp: bigint, type: string,"
    " sender: struct<uid: string, name: string>, content: struct<text: string>>>"
)


def chat_export(spark: SparkSession, path: str) -> DataFrame:
    """chat, no, ts (UTC), kind, uid, name, text of every message; a file that isn't such an export, or has no list of messages,
    is an error."""
    read = spark.read.schema(EXPORT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    chat = F.coalesce("chatInfo.name", "chatInfo.groupName").alias("chat")
    messages = F.when(F.col("messages").isNull(), F.raise_error(F.lit("no list of messages"))).otherwise(F.col("messages"))
    each = read.select(chat, F.posexplode(messages).alias("no", "m"))
    return each.select("chat", "no", F.timestamp_millis("m.timestamp").alias("ts"), F.col("m.type").alias("kind"), "m.sender.uid", "m.sender.name", F.col("m.content.text").alias("text"))


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON document (an array of objects), none where there is no such file; a broken file is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


# What stands for a message that isn't text.
PLACEHOLDERS = {"audio": "[语音]", "forward": "[合并转发]", "json": "[卡片消息]", "video": "[video]", "file": "[file]"}


def message_line(kind: Column, text: Column, name: Column, ts: Column) -> Column:
    """One line of a chat log for a message: a placeholder for what isn't text, at most 100 code points of unknown kinds."""
    text, name = F.coalesce(text, F.lit("")), F.coalesce(name, F.lit("?"))
    said = lambda body: F.concat(name, F.lit(": "), body)
    body = F.when(kind == "system", F.concat(F.lit("[系统] "), text)).when(kind == "text", said(text)).when(kind == "reply", said(F.concat(F.lit("(回复) "), text)))
    for k, placeholder in PLACEHOLDERS.items():
        body = body.when(kind == k, said(F.lit(placeholder)))
    other = said(F.concat(F.lit("("), F.coalesce(kind, F.lit("?")), F.lit(") "), F.substring(text, 1, 100)))
    stamp = F.coalesce(F.date_format(ts, "MM-dd HH:mm"), F.lit(""))
    return F.concat(F.lit("["), stamp, F.lit("] "), F.regexp_replace(body.otherwise(other), r"\s*\n\s*", " "))


def write_version(frame: DataFrame, folder: str, version: int) -> None:
    """Writes a version of a table beside the earlier ones; a whole version that is there already is an error, what a job left
    that died is written over."""
    place = f"{folder}/version={version}"
    if exists(frame.sparkSession, f"{place}/_SUCCESS"):
        raise FileExistsError(f"{place} is there already")
    frame.write.mode("overwrite").parquet(place)


def read_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of a table, by default the newest; one whose job died isn't a version."""
    whole = {int(n.partition("=")[2]) for n in names(spark, folder) if n.startswith("version=") and exists(spark, f"{folder}/{n}/_SUCCESS")}
    version = max(whole, default=None) if version is None else version
    if version not in whole:
        raise FileNotFoundError(f"no such version in {folder}")
    return spark.read.parquet(f"{folder}/version={version}")
