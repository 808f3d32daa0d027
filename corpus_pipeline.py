"""A training corpus from raw documents, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import benchmark_decontamination, simhash_near_dedup, source_mixing, token_files, toxicity_grammar
from ledgerlens.llm.common import scratch_folder, table
from ledgerlens.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7."""
    return toxicity_grammar.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies: SimHash by planned pigeonhole finds, then MinHash what is further apart; exact Jaccard 0.8 of five-word shingles decides."""
    return simhash_near_dedup.keep_one(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return benchmark_decontamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time the mix takes a document."""
    return source_mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, read back: where each document lies, and the checksum of its ids."""
    folder = scratch_folder(spark, "tokens")
    token_files.write_tokens(docs, folder, vocabulary("byte_bpe_50k.json"))
    return token_files.read_documents(spark, folder)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing), ("token_output", token_output),
]

# The toxicity model, SimHash and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
