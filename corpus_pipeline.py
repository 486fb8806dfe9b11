"""Corpus pipeline: documents to packed training windows in five stages.

Toxic documents go, then those without a recognisable language, then all but the smallest doc_id
of each group of near copies; what is left is repeated by source to flatter weights, and packed.

Extra columns, also of clashing names, pass through all stages but the last. An empty table gives
an empty result in every stage. What a stage does with nulls, empty and very long texts, ties and
repeated rows is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import jaccard_join, language_id, mixing, packing, toxicity
from glyphmill.llm.common import folder, remove, written

#: No stage before the last can be put in SQL (trained models, hashes); tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without toxic words, disguised ones included; the rules are learnt from labels.

    Null and empty texts stay, as do rows without doc_id; long texts are read whole. A score at the
    threshold counts as toxic. Repeated rows go or stay together, whatever each is labelled.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the network finds a language with a pooled probability of 0.4 at least.

    Null and empty texts have no language and go. Long texts are read whole, in windows. A
    probability at the limit stays; of equal probabilities the first language by name is taken.
    Rows without doc_id and repeated rows are treated like any other.
    """
    return language_id.filter_by_language(docs, min_confidence=0.4)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that word sets with Jaccard >= 0.7 connect: the smallest doc_id.

    Rows without doc_id, text or words stay, though alike. Rows that repeat a doc_id and its text
    become one; of one doc_id with two texts both stay or go. Similarity at the limit connects.
    """
    return jaccard_join.keep_one(docs, threshold=0.7, n=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, small sources up to 1.5 times.

    A null source is a source of its own. Null and empty texts cost no tokens and are read once at
    least. Repeated rows are read alike; ties of the order go by hash of doc_id and text.
    """
    return mixing.remix(docs, max_repeats=1.5)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in windows of 8192 bytes.

    Null and empty texts take no place. A longer text fills windows and its rest is packed like
    others; equal lengths go by hash. A document that was read twice is packed twice.
    """
    return packing.pack(docs, capacity=8192)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written as Parquet to the shared checkpoint folder, read again, and deleted when the next one is written. The last one stays."""
    path = folder(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{path}/{number}-{name}")
        if before:
            remove(spark, before)
        before = f"{path}/{number}-{name}"
    return docs
