"""Corpus preparation over ``documents``: quality rules, near duplicates, repeated passages,
mixing to source weights, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and its
result is written as Parquet and read again.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm._spark import stored
from seqloom.llm.jaccard_join import keep_one_of_each
from seqloom.llm.mixing import take_mix
from seqloom.llm.packing import pack_documents
from seqloom.llm.queries import tokenizer_path
from seqloom.llm.repetition import keep_good
from seqloom.llm.substring_dedup import strip_repeated_substrings


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; links are shared shingles of five words, 0.8 or more."""
    return keep_one_of_each(docs, ngram=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 words that stand elsewhere too go; documents stay."""
    return strip_repeated_substrings(docs, window=35)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times."""
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids and their place in a sequence."""
    return pack_documents(docs, tokenizer_path(), end_id=1)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]

#: Suffix arrays, knapsack, tokenizer and packing have no SQL; the tests hold every stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
