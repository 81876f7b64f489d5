"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixture, packing."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import mixing, neardup, packing, quality, substring
from tidewatch.llm.common import prepare, release, scratch
from tidewatch.llm.queries import SEQUENCE_TOKENS, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failed lines."""
    prepare(spark)
    return quality.passing(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    prepare(spark)
    release(spark)
    return neardup.representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that stand earlier; what has nothing left goes."""
    release(spark)  # files of the stages before
    return substring.deduplicated(docs)


def target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target shares of source, language and topic."""
    release(spark)
    return mixing.drawn_documents(docs, COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, each with its place in a sequence."""
    release(spark)
    return packing.pack(docs, tokenizer_path(), SEQUENCE_TOKENS)


STAGES = [("quality rules", good_documents), ("MinHash near-duplicates", distinct_documents),
          ("substring dedup", without_repeats), ("target mixture", target_mixture), ("best-fit packing", packed_sequences)]

#: No stage that cuts texts by rule, or packs by tokens, can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each writes Parquet to the shared folder, the next reads it."""
    prepare(spark)
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        out = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
