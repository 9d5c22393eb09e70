"""Corpus pipeline: from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. run() writes each
stage's result as Parquet in the shared checkpoint folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrivana.llm.common import materialise, table
from scrivana.llm.mixing import mixed_texts
from scrivana.llm.packing import pack
from scrivana.llm.simhash import keep_one
from scrivana.llm.suffix_dedup import without_repeats
from scrivana.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword model rejects go; null and empty texts are judged by the bias alone, repeated rows alike."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays: that of the least id, null ids last. Null and wordless texts are one group."""
    return keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier go from the texts, and documents of which nothing is left; texts null or empty before stay."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources, a null one last, are mixed to their target weights; documents without a word are never taken."""
    return mixed_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of one window each."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: A learned classifier and a tokeniser have no SQL form; tests hold the operators that the stages call against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
