"""Idempotent writes and the data side of stage control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocab


def replace_by_key(old: DataFrame, new: DataFrame, key: str = "report_id") -> DataFrame:
    """Table after deleting every key that ``new`` brings and inserting its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_bucketed(df: DataFrame, path: str, *, key: str = "report_id", buckets: int = 256) -> None:
    """Replace only the hash buckets present in ``df`` (dynamic partition overwrite).

    ``df`` must hold whole buckets: read the affected ones, apply
    :func:`replace_by_key`, write back.  The random salt spreads a bucket over several
    files when it is large.
    """
    bucketed = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    bucketed.repartition("bucket", F.pmod(F.xxhash64(*df.columns[:4]), F.lit(8))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def replace_evolution(
    old: DataFrame, new: DataFrame, current_ids: DataFrame, prior_ids: DataFrame, *,
    current: str = "current_risk_id", previous: str = "previous_risk_id",
) -> DataFrame:
    """Evolution table after rebuilding one comparison of periods.

    Drops rows that touch a current id on either side, and removal rows (no current id)
    whose previous id is in the prior report; then adds the new rows.  One anti-join per
    condition; none of them joins under OR.
    """
    now = current_ids.select(F.col(current_ids.columns[0]).alias("_id"))
    before = prior_ids.select(F.col(prior_ids.columns[0]).alias("_id"))
    kept = old.join(now, F.col(current) == F.col("_id"), "left_anti").join(
        now, F.col(previous) == F.col("_id"), "left_anti")
    gone = kept.filter(F.col(current).isNull()).join(before, F.col(previous) == F.col("_id"), "left_anti")
    return kept.filter(F.col(current).isNotNull()).unionByName(gone).unionByName(new)


def stage_reached(completed: Column, target: str) -> Column:
    """Whether a completed stage is at or past the target; unknown stages are not."""
    order = F.array(*[F.lit(s) for s in vocab.STAGES])
    at = F.array_position(order, completed)
    return F.coalesce((at > 0) & (at >= vocab.STAGES.index(target) + 1), F.lit(False))


def gate_stage(reports: DataFrame, target: str, *, force: bool = False) -> DataFrame:
    """Reports that still need a stage."""
    return reports if force else reports.filter(~stage_reached(F.col("completed_stage"), target))


def quarantine(failures: DataFrame) -> DataFrame:
    """Error rows: stage, message cut to its limit, next retry count."""
    return failures.select(
        "report_id", F.lit("FAILED").alias("status"), F.col("stage").alias("failed_stage"),
        F.substring("message", 1, vocab.ERROR_MESSAGE_CHARS).alias("error_message"),
        (F.coalesce("retry_count", F.lit(0)) + 1).alias("retry_count"))


def write_dated(df: DataFrame, path: str, ts: str = "uploaded_at") -> None:
    """Layout by year and month of arrival."""
    df.withColumn("y", F.date_format(ts, "yyyy")).withColumn("m", F.date_format(ts, "MM")).write.mode(
        "append").partitionBy("y", "m").parquet(path)


def memo_markdown(memos: DataFrame, sections: DataFrame) -> DataFrame:
    """One markdown text per memo: title, summary and its sections in order.

    A memo has eight sections, so the list per memo is bounded.
    """
    part = F.concat(F.lit("## "), F.col("section_name"), F.lit("\n\n"), F.col("content"))
    body = sections.groupBy("memo_id").agg(
        F.array_sort(F.collect_list(F.struct("section_order", part.alias("p")))).alias("_s"))
    return memos.join(body, "memo_id", "left").select("memo_id", F.concat(
        F.lit("# "), F.col("title"), F.lit("\n\n## Executive Summary\n\n"), F.col("executive_summary"), F.lit("\n\n"),
        F.array_join(F.transform(F.coalesce("_s", F.array()), lambda s: s["p"]), "\n\n")).alias("markdown"))


def write_memos(markdown: DataFrame, path: str, fmt: str = "markdown") -> None:
    if fmt == "markdown":
        markdown.select("markdown").write.mode("overwrite").option("lineSep", "\n\n---\n\n").text(path)
    elif fmt == "json":
        markdown.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")
