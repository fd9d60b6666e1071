"""Corpus pipeline over `documents`: quality rules, near-duplicates, repeated passages, benchmark passages, encoding.

Each stage takes and returns all columns of documents (the last: ids and digests), and its result is written and read
again before the next. A stage keeps the columns that its input has beside doc_id and text as they are; n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import bpe, common, decontaminate, quality, repeats, simhash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    common.prepare(spark)
    return simhash.keep_one(docs)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes in 50-byte strings that a document with a smaller doc_id has too."""
    common.prepare(spark)
    out = repeats.strip(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    common.prepare(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, with the digests of the ids and of what they decode to."""
    common.prepare(spark)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", strip_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]
#: No SQL for whole shingle sets, byte-level suffixes and byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        before, docs = docs, common.settled(stage(spark, docs, sf_dir), name)  # a stage's shuffle files go before the next begins
        common.drop(before)  # the input, which nobody wrote here, stays
