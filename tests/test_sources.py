"""Readers, text functions and streams against small files and plain models."""

import difflib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from talewind.functions import text as fn
from talewind.operators import records
from talewind.sources import texts
from talewind.streaming import streams


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "talk.txt").write_text("[0.0 -> 2.5] hello\n[2.5 -> 4] world\nnot stamped\n", encoding="utf-8")
    (tmp_path / "a" / "chat.txt").write_text("lost line\n[01-17 20:00] Ann: hi\nmore\n[01-18 09:30] Bo: yes\n", encoding="utf-16")
    (tmp_path / "skip.tmp").write_text("x")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:r><w:t>One &amp; two</w:t></w:r><w:r><w:t xml:space='preserve'> three</w:t></w:r></w:p><w:p><w:r><w:t>four</w:t></w:r></w:p></w:document>")
    (tmp_path / "a" / "note.docx").write_bytes(packed.getvalue())
    (tmp_path / "a" / "broken.docx").write_bytes(b"PK no archive")
    return tmp_path


def test_scan_classifies_files_by_name_and_head(spark, folder):
    got = {r.path: r.kind for r in texts.classified(texts.scan(spark, str(folder), ("*.tmp",))).select("path", "kind").collect()}
    assert got == {"a/talk.txt": "transcript", "a/chat.txt": "chat_log", "a/note.docx": "document", "a/broken.docx": "document"}


def test_transcripts_keep_their_rejects(spark, folder):
    files = texts.scan(spark, str(folder)).filter("path = 'a/talk.txt'").select("path", fn.decoded("content").alias("text"))
    rows = texts.transcript_lines(files).orderBy("no").collect()
    assert [(r.start_s, r.end_s, r.body) for r in rows] == [(0.0, 2.5, "hello"), (2.5, 4.0, "world"), (None, None, "not stamped")]


def test_chat_lines_carry_their_date(spark, folder):
    files = texts.scan(spark, str(folder)).filter("path = 'a/chat.txt'").select("path", fn.decoded("content").alias("text"))
    assert [r.day for r in texts.chat_lines(files).orderBy("no").collect()] == [None, "01-17", "01-17", "01-18"]


def test_docx_text(spark, folder):
    rows = texts.scan(spark, str(folder)).filter("path LIKE '%.docx'").select("path", fn.docx_text("content").alias("text")).collect()
    assert {r.path: r.text for r in rows} == {"a/note.docx": "One & two three\nfour", "a/broken.docx": None}


def test_chat_export_and_its_lines(spark, tmp_path):
    messages = [
        {"timestamp": 1768672800000, "type": "text", "sender": {"uid": "1", "name": "Ann"}, "content": {"text": "hi\nthere"}},
        {"timestamp": 1768672860000, "type": "audio", "sender": {"uid": "2", "name": "Bo"}, "content": {}},
    ]
    (tmp_path / "e.json").write_text(json.dumps({"chatInfo": {"groupName": "G"}, "messages": messages}))
    rows = texts.chat_export(spark, str(tmp_path / "e.json"))
    assert [r.chat for r in rows.collect()] == ["G", "G"]
    line = texts.message_line(F.col("kind"), F.col("text"), F.col("name"), F.col("ts"))
    assert [r[0] for r in rows.orderBy("no").select(line).collect()] == ["[01-17 18:00] Ann: hi there", "[01-17 18:01] Bo: [语音]"]


def test_versions_are_kept_side_by_side(spark, tmp_path):
    place = str(tmp_path / "t")
    texts.write_version(spark.range(2), place, 1)
    texts.write_version(spark.range(5), place, 2)
    assert texts.read_version(spark, place).count() == 5
    assert texts.read_version(spark, place, 1).count() == 2


def test_text_functions(spark):
    rows = spark.createDataFrame([("ab，c!", "abd"), (None, "x"), ("", None)], "a string, b string")
    got = rows.select(fn.squeezed(F.col("a")), fn.similarity("a", "b"), fn.fnv1a_utf16("a"), fn.code_point_bucket(F.col("a"), 7), fn.clipped(F.col("a"), 2)).collect()
    assert got[0][0] == "abc"
    assert got[0][1] == pytest.approx(difflib.SequenceMatcher(None, "ab，c!", "abd").ratio())
    assert got[1][2] == got[2][2] == 0x811C9DC5
    assert got[0][3] == sum(map(ord, "ab，c!")) % 7
    assert [r[4] for r in got] == ["ab", None, None]


def test_attributes(spark):
    row = spark.createDataFrame([("a: x、y\nb:\nplain\n c :z",), (None,)], "t string").select(fn.attributes(F.col("t"))).collect()
    assert [r[0] for r in row] == [{"a": ["x", "y"], "c": ["z"]}, {}]


def test_upsert_without_matches_and_with_an_unknown_end(spark):
    edges = spark.createDataFrame([("a", "b", "t", 1, 1)], "src string, dst string, type string, strength int, event_ord long")
    ups = spark.createDataFrame(
        [(5, "a", "b", "no such", "n", 2), (6, "a", "zz", None, "n", 2), (7, "a", "a", None, "n", 2), (8, "b", "a", None, "n", 2)],
        "seq long, src string, dst string, old_type string, type string, strength int",
    )
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted(map(tuple, records.upsert_edges(edges, ups, ids).collect())) == [("a", "b", "n", 2, 1), ("b", "a", "n", 2, 8)]
    assert records.upsert_edges(edges.limit(0), ups.limit(0), ids).count() == 0


def _drained(stream, spark, tmp_path, name):
    run = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert run.exception() is None
    return spark.table(name).collect()


def test_streams_equal_their_models(spark, tmp_path):
    rows = [(0, "k", 0.0, "a"), (1, "k", 10.0, "a"), (2, "k", 20.0, ""), (3, "k", 30.0, "a"), (4, "k", 700.0, "b"), (5, "m", 1.0, "b")]
    schema = "no long, key string, t double, line string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    kept = {r.no for r in _drained(streams.distinct_lines(read(), "key", "no", "line"), spark, tmp_path, "kept")}
    assert kept == {0, 2, 3, 4, 5}
    hits = {r.no: r.accepted for r in _drained(streams.accepted_hits(read(), "key", "t", 600, 2), spark, tmp_path, "hits")}
    assert hits == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True}


def test_sinks(spark, tmp_path):
    from talewind.sources import sinks

    place = f"{tmp_path}/p"
    for n in (1, 2, 3, 4):
        assert sinks.publish({"a": spark.range(n), "b": spark.range(1)}, place, keep=2) == n
    assert sinks.published(spark, place, "a").count() == 4
    assert sinks.published(spark, place, "a", 3).count() == 3
    assert [x for x in sinks.names(spark, place) if "version" in x] == ["version=2", "version=3", "version=4"]

    class Broken(Exception):
        pass

    bad = spark.range(3).select(F.raise_error(F.lit("dies")).alias("id"))
    with pytest.raises(Exception, match="dies"):
        sinks.publish({"a": spark.range(9), "b": bad}, place)
    assert sinks.published(spark, place, "a").count() == 4  # readers still see the whole old set
    assert sinks.publish({"a": spark.range(7), "b": spark.range(1)}, place) > 5
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, f"{tmp_path}/none", "a")
    folder = f"{tmp_path}/out"
    assert sinks.write_indexed(spark, folder, {"x": "1", "y": "2"})["written"] == ["x", "y"]
    (tmp_path / "out" / "mine").write_text("by hand")
    got = sinks.write_indexed(spark, folder, {"x": "1", "z": "3", "mine": "over"})
    assert got == {"written": ["z"], "unchanged": ["x"], "refused": ["mine"], "removed": ["y"]}
    assert (tmp_path / "out" / "mine").read_text() == "by hand"
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        run = sinks.append_batches(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/log_at")
        run.awaitTermination(120)
    assert sinks.appended(spark, f"{tmp_path}/log").count() == 10
    other = sinks.append_batches(spark.readStream.schema("id long").parquet(f"{tmp_path}/in").filter("id > 3"), f"{tmp_path}/log", f"{tmp_path}/log_at", {"least": 3})
    other.awaitTermination(120)
    assert sinks.appended(spark, f"{tmp_path}/log").count() == 6  # other parameters, another run
    (tmp_path / "log" / f"run={sinks.fingerprint({'least': 3})}" / "batch=7").mkdir()
    assert sinks.appended(spark, f"{tmp_path}/log").count() == 6
    with pytest.raises(FileNotFoundError):
        sinks.appended(spark, f"{tmp_path}/none")


class Killed(Exception):
    pass


def killed_after(monkeypatch, sinks, steps):
    """From now on the job dies before its ``steps``-th step that changes the folder."""
    left = [steps]

    def dies(real):
        def step(*a, **b):
            if left[0] == 0:
                raise Killed
            left[0] -= 1
            return real(*a, **b)

        return step

    for name in ("_replace", "remove"):
        monkeypatch.setattr(sinks, name, dies(getattr(sinks, name)))


def test_a_published_set_outlives_a_job_killed_at_any_step(spark, tmp_path, monkeypatch):
    from talewind.sources import sinks

    place, seen = f"{tmp_path}/p", set()
    sinks.publish({"a": spark.range(1)}, place, keep=0)
    for steps in range(3):
        n = 10 + steps
        with monkeypatch.context() as m:
            killed_after(m, sinks, steps)
            try:
                sinks.publish({"a": spark.range(n)}, place, keep=0)
            except Killed:
                seen.add(steps)
        assert sinks.published(spark, place, "a").count() in ((1, n) if steps == 0 else (n,))
        sinks.publish({"a": spark.range(1)}, place, keep=0)
        assert sinks.published(spark, place, "a").count() == 1
        assert len([x for x in sinks.names(spark, place) if x.startswith("version=")]) == 1
    assert {0, 1} <= seen


def test_indexed_files_outlive_a_job_killed_at_any_step(spark, tmp_path, monkeypatch):
    from talewind.sources import sinks

    old, new = {"x": "1", "y": "2"}, {"x": "1b", "z": "3", "w": "4", "mine": "over"}
    died = 0
    for steps in range(9):
        folder = f"{tmp_path}/{steps}"
        sinks.write_indexed(spark, folder, old)
        (tmp_path / str(steps) / "mine").write_text("by hand")
        with monkeypatch.context() as m:
            killed_after(m, sinks, steps)
            try:
                sinks.write_indexed(spark, folder, new)
            except Killed:
                died += 1
        for name in ("x", "y", "z", "w"):
            assert sinks.read_text(spark, f"{folder}/{name}") in (None, old.get(name), new.get(name))
        got = sinks.write_indexed(spark, folder, new | {"z": "5"})
        assert got["refused"] == ["mine"]
        assert {n: sinks.read_text(spark, f"{folder}/{n}") for n in ("x", "y", "z", "w", "mine")} == {"x": "1b", "y": None, "z": "5", "w": "4", "mine": "by hand"}
        assert sinks.names(spark, folder) == ["index.json", "mine", "w", "x", "z"] or died
        assert not sinks.exists(spark, f"{folder}/index.json.intent")
    assert died >= 6


def test_a_version_whose_job_died_is_none(spark, tmp_path):
    place = str(tmp_path / "t")
    texts.write_version(spark.range(2), place, 1)
    spark.range(5).write.parquet(f"{place}/version=2")
    (tmp_path / "t" / "version=2" / "_SUCCESS").unlink()
    assert texts.read_version(spark, place).count() == 2
    texts.write_version(spark.range(7), place, 2)
    assert texts.read_version(spark, place).count() == 7
    with pytest.raises(FileExistsError):
        texts.write_version(spark.range(1), place, 2)
    with pytest.raises(FileNotFoundError):
        texts.read_version(spark, place, 9)


def test_documents_that_are_missing_or_broken(spark, tmp_path):
    assert texts.documents(spark, f"{tmp_path}/none.json", "id string").count() == 0
    (tmp_path / "bad.json").write_text('[{"id": "a"}, {"id"')
    with pytest.raises(Exception):
        texts.documents(spark, f"{tmp_path}/bad.json", "id string").collect()
    (tmp_path / "no.json").write_text('{"chatInfo": {"name": "x"}}')
    with pytest.raises(Exception, match="no list of messages"):
        texts.chat_export(spark, f"{tmp_path}/no.json").collect()


def test_dates_of_system_lines_and_odd_folders(spark, tmp_path):
    odd = tmp_path / "a+(b)[c]"
    odd.mkdir()
    (odd / "log.txt").write_text("[01-17 20:00] Ann: hi\n[01-18 09:30] someone joined\nmore\n", encoding="utf-8")
    files = texts.scan(spark, str(odd)).select("path", fn.decoded("content").alias("text"))
    assert [r.path for r in files.collect()] == ["log.txt"]
    assert [r.day for r in texts.chat_lines(files).orderBy("no").collect()] == ["01-17", "01-18", "01-18"]


def test_leaks_stamps_and_folds(spark):
    from talewind.operators import search, segments

    prompt = "主持人与玩家的角色扮演发言。请逐字转写, never summarize anything"
    lines = ["主持人与玩家的角色扮演发言", "请逐字", "好的，主持人与玩家的角色扮演发言！", "never sumarize anythin", "hello there", "", None, "主持"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").orderBy("i").select(search.is_leak(F.col("t"), prompt)).collect()]
    assert got == [True, False, True, True, False, False, False, False]
    assert spark.range(1).select(search.is_leak(F.lit("anything"), "")).first()[0] is False
    assert fn.squeezed_plain("【a】[b]「c」『d』《e》") == "abcd《e》"
    assert [r[0] for r in spark.createDataFrame([(0.125,), (12.345,), (None,)], "x double").select(fn.stamp("x")).collect()] == ["0000.12", f"{12.345:07.2f}", None]
    counts = spark.createDataFrame([("k", "d1", 3), ("k", "d2", 2), ("k", "d3", 9), ("k", "d4", 1), (None, "d1", 5)], "k string, d string, n long")
    cut = {tuple(r) for r in segments.date_segments(counts, "k", "d", "n", 5, 4).collect()}
    assert cut == {("k", "d1", 0, 1, 3), ("k", "d2", 1, 1, 2), ("k", "d3", 2, 1, 4), ("k", "d3", 3, 5, 4), ("k", "d3", 4, 9, 1), ("k", "d4", 4, 1, 1), (None, "d1", 0, 1, 4), (None, "d1", 1, 5, 1)}
    alone = {(r.d, r.segment) for r in segments.date_segments(counts.filter("k = 'k'"), "k", "d", "n", 0, 100).collect()}
    assert alone == {("d1", 0), ("d2", 1), ("d3", 2), ("d4", 3)}


def test_one_time_axis(spark):
    from talewind.operators import segments

    rows = [(0, 0, 0.0, 2.0, "a"), (0, 1, 2.0, 9.0, "b"), (0, 2, 3.0, 5.0, "c"), (0, 3, None, None, "lost"), (1, 0, None, None, "plain"), (2, 0, 1.0, 2.0, "d")]
    lines = spark.createDataFrame(rows, "file_ord long, no int, start_s double, end_s double, body string")
    got = sorted((tuple(r) for r in segments.joined_timeline(lines, lines.select("file_ord")).collect()), key=lambda r: r[:2])
    assert got == [(0, 0, 0.0, 2.0, "a", False), (0, 1, 2.0, 9.0, "b", False), (0, 2, 3.0, 5.0, "c", False), (1, 0, None, None, "plain", False), (2, 0, 6.0, 7.0, "d", True)]


def test_nodes_merged_with_their_fields(spark):
    from talewind.operators import graph

    rows = [("a", "Ann", ["A"], ["g"], ["t"], "short", None), ("b", "Bea", ["x", "A"], ["h"], None, "other", "p"), ("c", "Cy", None, None, None, "short and more", "q"), ("d", "Di", [], [], [], None, "")]
    nodes = spark.createDataFrame(rows, "id string, name string, aliases array<string>, groups array<string>, tags array<string>, note string, played_by string")
    merges = spark.createDataFrame([("b", "a"), ("c", "a")], "src_id string, dst_id string")
    got = {r.id: r for r in graph.merge_records(nodes, merges).collect()}
    assert set(got) == {"a", "d"}
    a = got["a"]
    assert (a.aliases, a.groups, a.tags, a.played_by, a.merged_from) == (["A", "Bea", "x", "Cy"], ["g", "h"], ["t"], "p", ["b", "c"])
    assert a.note == "short\n\n(Bea)\nother\n\n(Cy)\nshort and more"
    assert (got["d"].aliases, got["d"].merged_from) == ([], [])


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "k"), ("2024-01-01 00:00:50", "k"), ("2024-01-01 00:01:10", "k"), ("2024-01-01 01:00:00", "m")]
    spark.createDataFrame(rows, "ts string, key string").select(F.to_timestamp("ts").alias("ts"), "key").coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema("ts timestamp, key string").parquet(str(tmp_path / "w"))
    got = {(str(r.window_start), r.key, r.n) for r in _drained(streams.windowed_counts(stream, "ts", "key", "1 minute", "10 minutes"), spark, tmp_path, "windows")}
    assert got >= {("2024-01-01 00:00:00", "k", 2), ("2024-01-01 00:01:00", "k", 1)}
