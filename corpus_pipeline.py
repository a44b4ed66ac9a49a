"""From raw documents to token ids: four stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitwise.llm import bytebpe, likeness, mixing, quality
from pitwise.llm.common import small_batches, table
from pitwise.llm.queries import REPETITION, vocabulary
from pitwise.session import durable

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; the model learns from all labelled rows' table."""
    small_batches(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a five-word likeness of 0.8 or more: the smallest doc_id."""
    small_batches(spark)
    return likeness.one_per_group(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated until sources have their temperature weights.

    The budget is the smallest that leaves no document out, so every document stays and those of
    rare sources come again, at most ``REPETITION`` times as often as those of the most common one.
    """
    return mixing.mix(docs, repetition=REPETITION).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids and offsets, with the documents' columns and whether the ids decode back."""
    small_batches(spark)
    return bytebpe.encode(docs, vocabulary(VOCABULARY), verify=True)


STAGES = [
    ("quality_classifier", good_documents),
    ("simhash_near_dedup", one_of_each),
    ("source_mixing", mixed_sources),
    ("byte_bpe", token_ids),
]

#: Learned weights, fingerprints and merges cannot be said in SQL; tests compare with plain rewrites.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of one data directory."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
