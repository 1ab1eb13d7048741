"""The training-data pipeline over ``documents``: clean, unique texts packed into sequences of one length."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyscribe.llm import exact, minhash, packing, suffix, toxicity
from tallyscribe.llm.frames import small_batches
from tallyscribe.llm.queries import toxicity_index
from tallyscribe.sources.storage import cut_lineage


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go. Without labels all stay.

    Null and empty texts have no terms and the score of a text without neighbours. Rows are judged one by one.
    """
    small_batches(spark)
    return toxicity.clean(docs, toxicity_index(spark, docs, sf_dir))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the row with the largest id stays; null counts as empty, and a null id is smaller than all others."""
    return exact.survivors(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Texts without a word are like no other and stay.
    """
    small_batches(spark)
    return minhash.survivors(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that occur again anywhere leave their texts; every document stays.

    Null texts come out empty.
    """
    small_batches(spark)
    return suffix.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of all tokens in sequences of 4096; a null or empty text is its end token alone."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("suffix dedup", repeated_passages),
    ("packing", packed),
]

#: Learnt scores, MinHash buckets and token ids have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages one after the other, each to the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
