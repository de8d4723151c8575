import difflib
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from talewind.functions.text import squeezed_plain
from talewind.operators import calls, graph, history, ordered, quality, reports
from talewind.sources import texts
from talewind.streaming.quality import write_told

PROMPT = "Players and their host speak. Names: Ann, Bo."
SCHEMA = "file string, start double, text string"


def plain_outcomes(rows, prompt, threshold=0.8):
    """The rule told line by line."""
    whole = squeezed_plain(prompt)
    pieces = [p for p in (squeezed_plain(x) for x in re.split(r"[，。！？；,;.!?]", prompt)) if len(p) >= 5]
    last, out = {}, []
    for file, start, text in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        line, said = squeezed_plain(text or ""), text or ""
        like = max((difflib.SequenceMatcher(None, line, p).ratio() for p in pieces), default=0)
        leak = bool(whole) and len(line) >= 4 and (line in whole or any(p in line or line in p for p in pieces) or like >= threshold)
        told = "leak" if leak else "repeat" if said and said == last.get(file) else "kept"
        if told == "kept":
            last[file] = said
        out.append((file, start, text, told))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def said():
    rng = random.Random(5)
    lines = ["", None, "yes", "no way", "Players and their host speak.", "their host", "Names: Ann", "Players and there host speak", "Bo"]
    return [(f, float(i), rng.choice(lines)) for f in ("a", "b", "hot", None) for i in range(400 if f == "hot" else 40)]


def test_outcomes_and_report_equal_the_plain_rule(spark, said):
    rows = spark.createDataFrame(said, SCHEMA).repartition(7)
    told = quality.outcomes(rows, "file", ["start"], "text", PROMPT)
    assert sorted((tuple(r) for r in told.collect()), key=repr) == plain_outcomes(said, PROMPT)
    report = {r.file: r for r in quality.report(told, "file", "start", "text").collect()}
    for file in ("a", "b", "hot", None):
        mine = sorted((r for r in plain_outcomes(said, PROMPT) if r[0] == file), key=lambda r: r[1])
        kept, leaks, repeats = ([r for r in mine if r[3] == o] for o in ("kept", "leak", "repeat"))
        r = report[file]
        assert (r.kept, r.dropped, r.prompt_leak, r.repeat) == (len(kept), len(leaks) + len(repeats), len(leaks), len(repeats))
        assert r.kept_ratio == pytest.approx(len(kept) / len(mine), abs=6e-5)
        assert r.first_kept == [f"[{s:07.2f}] {t or ''}" for _, s, t, _ in kept[:5]]
        assert r.leak_samples == [t for _, _, t, _ in leaks[:3]]


def test_outcomes_of_nothing_and_without_a_prompt(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.report(quality.outcomes(empty, "file", ["start"], "text", PROMPT), "file", "start", "text").count() == 0
    rows = spark.createDataFrame([("a", 1.0, "their host"), ("a", 2.0, "their host")], SCHEMA)
    assert [r.outcome for r in quality.outcomes(rows, "file", ["start"], "text", "").orderBy("start").collect()] == ["kept", "repeat"]


def test_the_stream_equals_the_batch_across_a_restart(spark, said, tmp_path):
    rows = [r for r in said if r[0] is not None]
    halves = [[r for r in rows if r[1] < 20], [r for r in rows if r[1] >= 20]]
    for i, half in enumerate(halves):
        spark.createDataFrame(half, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = write_told(stream, str(tmp_path / "out"), str(tmp_path / "state"), key="file", order="start", text="text", prompt=PROMPT)
        query.awaitTermination()
        assert query.exception() is None, i
    told = spark.read.parquet(str(tmp_path / "out")).select("file", "start", "text", "outcome").collect()
    assert sorted((tuple(r) for r in told), key=repr) == plain_outcomes(rows, PROMPT)


def test_the_last_value_before(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([None, None, "x", "y"])) for g in ("hot", "b", None) for i in range(300 if g == "hot" else 5)]
    got = ordered.last_before(spark.createDataFrame(rows, "g string, i int, v string").repartition(5), F.upper("v"), "own", ["i"], ["g"]).collect()
    assert len(got) == len(rows)
    for r in got:
        earlier = [v for g, i, v in rows if g == r.g and i < r.i and v]
        assert (r.own, r.before) == (r.v and r.v.upper(), earlier[-1].upper() if earlier else None)


def test_calls_are_tried_again_and_never_end_the_job(spark):
    def work(text, attempt):
        if text.startswith("late") and attempt < 3:
            raise TimeoutError("late")
        if text == "never":
            raise TimeoutError("never")
        if text == "broken":
            raise KeyError("broken")
        return "" if text == "silent" else f" {text.upper()} "

    rows = spark.createDataFrame([("late1",), ("never",), ("broken",), ("silent",), ("fine",), ("junk",), ("x" * 20,), (None,)], "t string")
    for threads in (1, 4):
        got = {r.t: (r.result, r.error, r.attempts) for r in calls.called(rows, "t", work, 2, (TimeoutError,), 10, lambda x: x == "JUNK", threads).collect()}
        assert got["late1"] == ("LATE1", None, 3)
        assert got["never"] == (None, "TimeoutError: never", 3)
        assert got["broken"] == (None, "KeyError: 'broken'", 1)
        assert got["silent"][::2] == (None, 1)
        assert got["fine"] == ("FINE", None, 1)
        assert got["junk"] == (None, "ValueError: the result is no answer: 'JUNK'", 1)
        assert got["x" * 20] == (None, "ValueError: 20 characters are more than 10", 0)
        assert got[None][2] == 1
    done = calls.called(rows, "t", work, 0, (TimeoutError,))
    assert {r.t for r in calls.left_over(rows, done, "t").collect()} == {"late1", "never", "broken", "silent", None}
    assert calls.called(rows.limit(0), "t", work).count() == 0
    with pytest.raises(ValueError, match="already"):
        calls.called(rows.withColumn("error", F.lit(1)), "t", work)


def test_merged_values_keep_their_order(spark):
    values = spark.createDataFrame(
        [("a", "job", "cook", 0), ("a", "job", "cook", 1), ("b", "job", "smith", 0), ("b", "job", "cook", 1), ("b", "home", "inn", 0), ("c", "job", "smith", 0), ("c", None, "x", 0), ("b", "job", "", 2), ("b", "job", None, 3)],
        "id string, dim string, value string, ord int",
    )
    merges = spark.createDataFrame([("b", "a"), ("c", "a")], "src_id string, dst_id string")
    got = graph.merge_values(values, merges, ("dim",)).orderBy("dim", F.col("origin").asc_nulls_first(), "ord").collect()
    assert [tuple(r) for r in got] == [("a", None, "x", "c", 0), ("a", "home", "inn", "b", 0), ("a", "job", "cook", None, 0), ("a", "job", "smith", "b", 0)]


def test_what_a_merge_moves_and_drops(spark):
    edges = spark.createDataFrame(
        [("a", "z", "t", 1), ("b", "z", "t", 2), ("b", "a", "t", 3), ("b", "b", "t", 4), ("b", "c", "u", 5), ("c", "z", "t", 6), ("c", "y", "t", 7), ("a", "a", "t", 8), ("b", "y", "t", 9)],
        "src string, dst string, type string, event_ord int",
    )
    merges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "a")], "src_id string, dst_id string")
    got = {r.src_id: (r.moved, r.dropped) for r in graph.merge_counts(edges, merges).collect()}
    assert got == {"b": (5, 4), "c": (3, 2), "d": (0, 0)}


def test_speakers_and_types(spark):
    rows = spark.createDataFrame([(1, "u", "Ann", "text"), (2, "u", "Bo", None), (3, None, None, "text"), (4, "u", None, "audio")], "ord int, uid string, name string, kind string")
    got = sorted(tuple(r) for r in reports.talk_summary(rows, "uid", "name", "kind", "ord").collect())
    assert got == [("speaker", "?", 1, "?"), ("speaker", "u", 3, "?"), ("type", "?", 1, None), ("type", "audio", 1, None), ("type", "text", 2, None)]


def combined(items):
    return hashlib.sha256("".join(f"{n}\0{d}\1" for n, d in sorted(items)).encode()).hexdigest()[:32]


def test_folder_digests(spark):
    rows = [("small", f"n{i}", f"d{i}") for i in range(5)] + [("large", f"n{i}", f"d{i}") for i in range(300)] + [(None, None, None)]
    of = lambda some: {r.folder: r.digest for r in history.folder_digests(spark.createDataFrame(some, "folder string, name string, hash string"), "folder", "name", "hash", 8).collect()}
    got = of(rows)
    assert got["small"] == combined((n, d) for f, n, d in rows if f == "small")
    assert got[None] == combined([("", "")])
    assert of(rows[::-1]) == got
    changed = of([(f, n, "other" if (f, n) == ("large", "n7") else d) for f, n, d in rows])
    assert {f for f in got if changed[f] != got[f]} == {"large"}
    assert of([]) == {}


def test_kinds_are_taken_over_where_the_content_is_the_same(spark):
    chat, other = bytearray(b"[09-01 10:00] Ann: hi\n"), bytearray(b"nothing")
    files = spark.createDataFrame([("a.txt", chat), ("b.txt", other), ("c.txt", chat)], "path string, content binary")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    before = spark.createDataFrame([("a.txt", sha(chat), "taken over"), ("b.txt", sha(chat), "stale"), ("c.txt", sha(chat), None)], "path string, hash string, kind string")
    assert {r.path: r.kind for r in texts.reclassified(files, before).collect()} == {"a.txt": "taken over", "b.txt": "other", "c.txt": "chat_log"}


def test_edge_digests(spark):
    contents = [b"", b"abc", b"x" * 8 + b"y" * 8, b"x" * 8 + b"m" + b"y" * 8]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "i int, content binary")
    got = [r.h for r in rows.select("i", texts.edge_digest(F.col("content"), 8).alias("h")).orderBy("i").collect()]
    assert got == [hashlib.sha256(c).hexdigest()[:32] for c in (b"", b"abc", b"x" * 8, b"x" * 8 + b"y" * 8)]
