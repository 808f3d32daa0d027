"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    benchmark_decontamination, bpe_codec, conversation_repair, filter_audit, hash_tree_sharding, personal_data, robust_outliers, simhash_near_dedup, site_quality, source_mixing,
    token_counts, token_files, toxicity_grammar,
)
from ledgerlens.llm.common import scratch_folder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> Callable[[], str]:
    """The place of a public tokenizer file, looked up by the worker that reads it."""

    def path() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return path


@_query
def op1_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source stands for a document's host, source and language for its path."""
    return site_quality.quality_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


@_query
def op2_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree_sharding.sharded(table(spark, sf_dir, "documents"))


@_query
def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_grammar.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    return token_files.read_documents(spark, folder)


@_query
def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.quality_verdicts(table(spark, sf_dir, "documents"))


@_query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@_query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


@_query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixture(table(spark, sf_dir, "documents"))


@_query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Independent of the intervals: every document is taken through every order.
SQL["op11_filter_audit"] = r"""
WITH cut AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), failing AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END ||
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END ||
    CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) THEN 'E' ELSE '' END AS f
  FROM cut
), marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)
), walked AS (
  SELECT part, filter_order, step, f, good, toxic, substr(filter_order, step, 1) AS x,
    length(translate(f, substr(filter_order, 1, step - 1), '')) < length(f) AS gone, contains(f, substr(filter_order, step, 1)) AS fails
  FROM failing LEFT JOIN marks USING (doc_id), orders, (SELECT unnest(range(1, 6)) AS step)
), counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, x, count(*) FILTER (NOT gone AND NOT fails) AS kept, count(*) FILTER (NOT gone AND fails) AS removed,
    count(*) FILTER (gone AND fails) AS redundant, count(*) FILTER (f = x) AS unique_fails,
    count(*) FILTER (NOT gone AND fails AND coalesce(good, false)) AS good_lost, count(*) FILTER (NOT gone AND fails AND coalesce(toxic, false)) AS toxic_lost
  FROM walked GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted
"""


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


@_query
def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@_query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash_near_dedup.duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
