"""Sinks that survive a lost job: staged tables promoted together, versions behind a pointer, writes that skip what is there,
and clean-up by what an index names, never by pattern. All paths go through Hadoop's file systems."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    """The file system of a path and the path; a local one without checksum files, which a rename would leave behind."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return (files.getRawFileSystem() if files.getUri().getScheme() == "file" else files), place


def _replace(spark: SparkSession, aside, place) -> None:
    """Renames a file over another in one step, so that a reader always finds the old one or the new."""
    files, _ = _at(spark, place.toString())
    if files.getUri().getScheme() == "file":
        if not files.rename(aside, place):  # the system's own rename, which takes the place of what stands there
            raise OSError(f"can't put {place} in its place")
        return
    overwrite = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(overwrite, 1)
    options[0] = overwrite.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, place, options)


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.delete(place, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What stands in a folder, sorted by name; nothing where there is none."""
    files, place = _at(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    files, place = _at(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small text whole or not at all (a new file takes the old one's place in one step); False where it is there
    already."""
    if read_text(spark, path) == text:
        return False
    files, place = _at(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{hashlib.sha256(text.encode()).hexdigest()[:8]}.tmp")
    stream = files.create(aside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    _replace(spark, aside, place)
    return True


def publish(tables: Mapping[str, DataFrame], folder: str, keep: int = 10) -> int:
    """Writes a set of tables as the folder's next version and returns its number.

    All tables are staged first, by Spark's committer; only when every one is written the small file ``current`` names the
    version, so readers see the old set or the new, never a mixture, and a job that dies leaves the old. Of the versions behind
    the current one the newest ``keep`` stay.
    """
    spark = next(iter(tables.values())).sparkSession
    last = current(spark, folder)
    version = max([last or 0, *(int(n.partition("=")[2]) for n in names(spark, folder) if n.startswith("version="))]) + 1
    for name, frame in tables.items():
        frame.write.mode("errorifexists").parquet(f"{folder}/version={version}/{name}")
    write_text(spark, f"{folder}/current", json.dumps({"version": version, "tables": sorted(tables)}))
    old = sorted(int(n.partition("=")[2]) for n in names(spark, folder) if n.startswith("version=") and int(n.partition("=")[2]) < version)
    for v in old[: max(0, len(old) - keep)]:
        remove(spark, f"{folder}/version={v}")
    return version


def current(spark: SparkSession, folder: str) -> int | None:
    """The version that ``current`` names."""
    said = read_text(spark, f"{folder}/current")
    return json.loads(said)["version"] if said else None


def published(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the current version, or of another that is kept."""
    version = current(spark, folder) if version is None else version
    if version is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/version={version}/{name}")


def write_indexed(spark: SparkSession, folder: str, texts: Mapping[str, str], index: str = "index.json") -> dict[str, list[str]]:
    """Writes small files and their index; returns which were written, unchanged, refused and removed.

    A file that stands there and is neither in the last index nor in an intent is somebody else's: it is refused. What these
    name and the new index doesn't is removed; nothing else is. The intent (the names about to be written) is set down before
    any file, and taken away after the index: so a run that follows one which died at any step knows its files for its own.
    """
    intent = f"{folder}/{index}.intent"
    before = set(json.loads(read_text(spark, f"{folder}/{index}") or "[]")) | set(json.loads(read_text(spark, intent) or "[]"))
    refused = sorted(n for n in texts if n not in before and exists(spark, f"{folder}/{n}"))
    done: dict[str, list[str]] = {"written": [], "unchanged": [], "refused": refused, "removed": []}
    own = sorted(set(texts) - set(refused))
    write_text(spark, intent, json.dumps(sorted(before | set(own))))
    for name in own:
        done["written" if write_text(spark, f"{folder}/{name}", texts[name]) else "unchanged"].append(name)
    for name in sorted(before - set(own)):
        if remove(spark, f"{folder}/{name}"):
            done["removed"].append(name)
    write_text(spark, f"{folder}/{index}", json.dumps(own))
    remove(spark, intent)
    return done


def fingerprint(parameters: Mapping[str, object]) -> str:
    """Sixteen hex digits of parameters, whatever their order."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]


def append_batches(stream: DataFrame, folder: str, checkpoint: str, parameters: Mapping[str, object] | None = None):
    """A streaming query that writes each micro-batch to a place of its own number: one that is run again after a failure writes
    the same place over, so every row is there once.

    Rows made with other ``parameters`` aren't mixed: each set of parameters has a run of its own, that is resumed where it
    stopped when they come again, and ``current_run`` names the last one that began.
    """
    spark, run = stream.sparkSession, fingerprint(parameters or {})
    write_text(spark, f"{folder}/current_run", run)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/run={run}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{run}").trigger(availableNow=True).start()


def appended(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the run that ``current_run`` names; those of a batch that wasn't finished are left out."""
    run = read_text(spark, f"{folder}/current_run")
    place = f"{folder}/run={run}"
    whole = [f"{place}/{n}" for n in names(spark, place) if n.startswith("batch=") and exists(spark, f"{place}/{n}/_SUCCESS")]
    if not whole:
        raise FileNotFoundError(f"nothing is written in {folder}")
    return spark.read.parquet(*whole)
