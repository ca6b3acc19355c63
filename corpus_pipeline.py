"""Cleans the documents table for training: quality, near-duplicates, secrets, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, mixing, quality, secrets, simhash
from quern.llm.common import saved, table


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every set of near copies, the one of the smallest id: five-word shingles, SimHashes within 3 bits or Jaccard similarity of 0.8."""
    return simhash.one_of_each(docs, spark, shingle=5, similarity=0.8, near=3)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at target weights: a document stands once for each pass that takes words of it, with those words."""
    return mixing.mixed_documents(docs, spark)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text of the mix, their number, and digests of ids and decoded text."""
    return bpe.encode(docs, with_ids=True, keep_tables=False)


STAGES = [("quality", good_only), ("near_duplicates", without_copies), ("secrets", without_secrets), ("mixture", mixed), ("bpe", encoded)]

#: SQL has no compression, no XXH64, no permutations of this kind and no tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), spark, f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
