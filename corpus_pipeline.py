"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mixture, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; :func:`run` writes each
stage's rows as Parquet to the shared folder and reads them again as the next one's ``docs``. All stages but the
last return the columns of ``documents``; the last returns what the token-id files say of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wobble.llm import decontamination, mixing, order_minhash, quality_knn, token_ids
from wobble.llm.queries import table, tokenizer_path
from wobble.llm.shared import remove, scratch, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality_knn.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest id."""
    return order_minhash.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents: whole ones as often as they are drawn, and parts of those that are drawn in part."""
    return mixing.mixture(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary shards, read back."""
    return token_ids.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixture),
    ("token-ID / binary output", token_shards),
]

#: The classifier is trained and the mixture is drawn at random, which SQL cannot express; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage read and stored is removed once the next one's input is written."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for i, (_, stage) in enumerate(first):
        with scratch(spark) as keep:
            after = keep(stored(stage(spark, docs, sf_dir), f"stage-{i}"))
        if i:
            remove(spark, docs.shared_path)
        docs = after
    out = last(spark, docs, sf_dir)  # it reads its own files, which are written by now
    remove(spark, docs.shared_path)
    return out
