"""Positions, running sums and names in running text against plain models; hot groups are dealt out."""

import random

import pytest
from pyspark.sql import functions as F

from talewind.operators import ordered, reports, search


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(6)
    data = [(i, draw.choice([None, "a", "a", "a", "b"]), draw.randrange(50), draw.choice([None, 1, 2, -3])) for i in range(3000)]
    return data, spark.createDataFrame(data, "id int, grp string, x int, v long").repartition(7)


def test_positions_and_sums(spark, rows):
    data, frame = rows
    groups = {}
    for r in sorted(data, key=lambda r: (r[2], r[0])):
        groups.setdefault(r[1], []).append(r)
    got = {r.id: (r.position, r.size) for r in ordered.placed(frame, ["x", "id"], ["grp"]).collect()}
    assert got == {r[0]: (i, len(g)) for g in groups.values() for i, r in enumerate(g)}
    got = {r.id: r.before for r in ordered.summed_before(frame, "v", ["x", "id"], ["grp"]).collect()}
    expected = {}
    for g in groups.values():
        run = 0
        for r in g:
            expected[r[0]] = run
            run += r[3] or 0
    assert got == expected
    whole = {r.id: r.position for r in ordered.placed(frame, [F.desc("x"), "id"]).collect()}
    assert whole == {r[0]: i for i, r in enumerate(sorted(data, key=lambda r: (-r[2], r[0])))}
    assert ordered.placed(frame.limit(0), ["x"]).count() == ordered.summed_before(frame.limit(0), "v", ["x"]).count() == 0


def test_a_value_that_all_rows_share_is_dealt_out(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.range(20_000, numPartitions=8).withColumn("name", F.lit("same"))
        parts = [r["count"] for r in ordered._dealt(frame, ["name"], []).groupBy("part_").count().collect()]
        assert len(parts) > 2 and max(parts) < 2 * sum(parts) / len(parts)
        assert sorted(r.position for r in ordered.placed(frame, ["name"]).select("position").collect()) == list(range(20_000))
        slots = reports.slots(frame.select("id", "name"), spark.createDataFrame([(3, 10)], "id long, slot long"))
        assert sorted(r.slot for r in slots.collect()) == list(range(10, 20_010))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


LINES = [("g", "张三走进了房间"), ("g", "Ann's hair was red"), ("g", "nobody"), ("g", ""), ("g", None), ("h", "张三走进了房间"), (None, "Annabel and 李四"), ("g", "Ann's hair was red"), ("g", "李四说：张三！")]
NAMES = [("g", "张三"), ("g", "Ann"), ("g", "三"), ("g", ""), ("g", None), (None, "李四"), (None, "Ann"), ("k", "Ann"), ("g", "Ann")]


@pytest.mark.parametrize("bytes_, chars", [(1 << 20, 1 << 20), (0.5, 4)])
def test_names_stand_anywhere_in_a_line(spark, bytes_, chars):
    lines, names = spark.createDataFrame(LINES, "grp string, sentence string"), spark.createDataFrame(NAMES, "grp string, name string")
    bound = 20 if bytes_ < 1 else bytes_
    got = {tuple(r) for r in search.names_in(lines, names, names_bytes=bound, block_chars=chars).collect()}
    assert got == {(g, x, n) for g, x in LINES for h, n in NAMES if x and n and g == h and n in x}
    assert search.names_in(lines.limit(0), names).count() == search.names_in(lines, names.limit(0)).count() == 0


def test_evidence_in_text_without_blanks(spark):
    people = spark.createDataFrame([("p1", "g", ["张三", "三"]), ("p2", "g", ["Ann", ""]), ("p3", "h", ["张三"]), ("p4", None, ["李四"])], "id string, grp string, names array<string>")
    lines = spark.createDataFrame([(g, i, x) for i, (g, x) in enumerate(LINES)], "grp string, no int, sentence string")
    got = [tuple(r) for r in search.evidence(people, lines, ["！"], 20).orderBy("id", "place").collect()]
    assert got == [("p1", 1, "李四说：张三！", True), ("p1", 2, "张三走进了房间", False), ("p2", 1, "Ann's hair was red", False), ("p3", 1, "张三走进了房间", False), ("p4", 1, "Annabel and 李四", False)]
