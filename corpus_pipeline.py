"""A corpus pipeline of five stages: each stage's rows are written and read again as the next one's documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talewind.llm import best_fit_pack, minhash_join, pareto_mix, piece_lm, toxicity
from talewind.llm.common import shared_folder, table

#: A text whose language is less sure than this is rejected.
LEAST_SURE = 0.5


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, by a lexicon learned from the labels of those at hand.

    Null and empty texts have no hits and stay; repeated rows fare alike; an empty table gives none.
    """
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = _free("toxicity", docs)
    return toxicity.score(docs, lexicon, name).filter(F.col(f"{name}.predicted") == 0).drop(name)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Null texts and texts without a letter go; repeated rows fare alike; an empty table gives none.
    """
    name = _free("language", docs)
    told = piece_lm.predict(docs, piece_lm.fit(docs), name)
    return told.filter((F.col(f"{name}.lang_pred") != piece_lm.UNDETERMINED) & (F.col(f"{name}.score") >= LEAST_SURE)).drop(name)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8, the least doc_id.

    Of rows that repeat the kept doc_id the least one stays, by text and then all other columns in order, nulls first; a row
    without doc_id stays; texts without words are like no other and stay.
    """
    found = minhash_join.near_duplicates(docs, words=5, similarity=0.8)
    kept = found.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    place = _free("place", docs)
    least = F.row_number().over(W.partitionBy("doc_id").orderBy("text", *[c for c, t in docs.dtypes if c not in ("doc_id", "text") and "map<" not in t]))
    return named.withColumn(place, least).filter(F.col(place) == 1).drop(place).unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


def to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: repeats are rows.

    Rows equal in id, source and text (told by 256 bits) fare alike: all as often as the one of them that is taken most. Null
    and empty texts are taken never; null is a source; an empty table gives none.
    """
    key = _free("row_key", docs)
    of = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "text")]
    nulls = [F.col(c).isNull().cast("string") for c in ("doc_id", "source", "text")]
    lengths = [F.length(c).cast("string") for c in of]
    keyed = docs.withColumn(key, F.sha2(F.concat_ws(":", *nulls, *lengths, *of).cast("binary"), 256))
    taken = pareto_mix.mix(keyed, kept=(key,)).groupBy(key).agg(F.max("copies").alias(_free("copies", docs)))
    copies = taken.columns[1]
    repeated = keyed.join(taken.filter(F.col(copies) > 0), key)
    return repeated.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*docs.columns)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: every piece of every document with its place.

    Null and empty texts are their end mark alone; repeated rows are packed each; an empty table gives none.
    """
    return best_fit_pack.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean_speech),
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("mixing", to_targets),
    ("packing", into_sequences),
]

#: Learned scores and best fit aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def _free(name: str, docs: DataFrame) -> str:
    while name in docs.columns:
        name += "_"
    return name


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the folder that executors share; a stage's rows are removed
    once the next one's are written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{last}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        last = name
    return docs
