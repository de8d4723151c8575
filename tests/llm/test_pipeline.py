"""The corpus pipeline, stage by stage."""

from collections import Counter

import corpus_pipeline
from oracle import DATA
from test_pairs import brute_duplicates


def test_stages_on_the_small_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "language", "near_duplicates", "mixing", "packing"]
    clean = stages["toxicity"](spark, docs, DATA).cache()
    known = stages["language"](spark, clean, DATA).cache()
    kept = stages["near_duplicates"](spark, known, DATA).cache()
    mixed = stages["mixing"](spark, kept, DATA).cache()
    packed = stages["packing"](spark, mixed, DATA).cache()
    for frame in (clean, known, kept, mixed):
        assert frame.columns == docs.columns
    assert 0.7 * docs.count() < clean.count() < docs.count()
    assert known.count() > 0.95 * clean.filter("text RLIKE '[a-z]'").count()
    classes = brute_duplicates([(r.doc_id, r.text) for r in known.select("doc_id", "text").collect()], 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values()))
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 3
    pieces = Counter(r.doc_id for r in packed.filter("piece = 0").collect())
    assert pieces == copies


def test_odd_rows_pass_through_every_stage(spark):
    rows = [(1, None, None, None, 0, "x"), (2, "", "en", "a", 0, "x"), (None, "the and of this that", None, "a", 0, "x"), (3, "the and of this that", "en", None, 0, "x"), (3, "the and of this that", "en", None, 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, language string")
    for name, stage in corpus_pipeline.STAGES:
        some = stage(spark, docs, DATA)
        assert some.count() <= 3 * len(rows), name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name


def test_of_rows_with_one_id_the_least_stays(spark):
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    rows = [(3, t, lang, None, 0) for t, lang in (("zzz", "en"), ("mmm", "en"), ("aaa", "fr"), ("aaa", "en"))] + [(None, "aaa", "en", None, 0)]
    for some in (rows, rows[::-1]):
        kept = stage(spark, spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long"), DATA).collect()
        assert sorted((r.doc_id or 0, r.text, r.lang) for r in kept) == [(0, "aaa", "en"), (3, "aaa", "en")]


def test_a_run_leaves_its_last_stage_alone(spark):
    from pathlib import Path

    from talewind.llm.common import shared_folder

    packed = corpus_pipeline.run(spark, DATA)
    assert packed.filter("piece = 0").count() > 0
    folder = Path(packed.inputFiles()[0].removeprefix("file://")).parent.parent
    assert str(folder).startswith(shared_folder(spark).removeprefix("file:").replace("//", "/")) or folder.name.startswith("pipeline-")
    assert [x.name for x in folder.iterdir()] == ["packing"]
