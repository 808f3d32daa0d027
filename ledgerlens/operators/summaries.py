"""Counters and summary aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions.grouped import null_safe_join, running_total


def counts_by(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Row counts per key, and per key and each column, in one pass of grouping sets."""
    sets = [[key], *[[key, c] for c in columns]]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], key, *columns).agg(
        F.count(F.lit(1)).alias("n")).select(key, *columns, "n")


def metric_summary(metrics: DataFrame, key: str = "report_id") -> DataFrame:
    """Total, mean confidence and maps of counts by category, method and metric.

    The first aggregation collapses rows to distinct combinations; the maps are built
    from those few.
    """
    fine = metrics.groupBy(key, "metric_category", "extraction_method", "normalized_metric_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence_score").alias("c"))

    def counts(column: str) -> DataFrame:
        return fine.groupBy(key, column).agg(F.sum("n").alias("n")).groupBy(key).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("m"))

    total = fine.groupBy(key).agg(F.sum("n").alias("total"), F.sum("c").alias("c"))
    return (
        total
        .join(counts("metric_category").withColumnRenamed("m", "by_category"), key)
        .join(counts("extraction_method").withColumnRenamed("m", "by_method"), key)
        .join(counts("normalized_metric_name").withColumnRenamed("m", "by_metric"), key)
        .select(key, "total", F.bround(F.col("c").cast("double") / F.col("total"), 4).alias("avg_confidence"),
                "by_category", "by_method", "by_metric")
    )


def status_funnel(reports: DataFrame, key: str) -> DataFrame:
    return reports.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status").isin(vocab.DONE_STATUSES)).alias("processed"),
        F.count_if(F.col("status") == "FAILED").alias("failed"))


def risk_summary(risks: DataFrame, evolutions: DataFrame, key: str = "company_id") -> DataFrame:
    """Counts per category, severity and evolution type in long form."""
    def part(df: DataFrame, kind: str, column: str) -> DataFrame:
        return df.groupBy(key, F.lit(kind).alias("kind"), F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))

    return part(risks, "category", "category").unionByName(part(risks, "severity", "severity")).unionByName(
        part(evolutions, "evolution", "evolution_type"))


def severity_buckets(risks: DataFrame, key: str = "report_id") -> DataFrame:
    s = F.col("severity")
    return risks.groupBy(key).agg(
        F.count_if(s.isin("HIGH", "CRITICAL")).alias("high"), F.count_if(s == "MEDIUM").alias("medium"),
        F.count_if(s == "LOW").alias("low"))


def latency_stats(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean, median, nearest-rank p95, min and max.

    Distinct values with their counts are what the percentile functions see, and they
    are exact.  The p95 rank is round-half-even of .95 (n - 1).
    """
    from ledgerlens.functions.grouped import running_total

    freq = samples.groupBy(key, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    n = freq.groupBy(key).agg(
        F.sum("_n").alias("n"), F.sum(F.col("_v").cast("decimal(20,6)") * F.col("_n")).alias("_sum"),
        F.min("_v").alias("min_v"), F.max("_v").alias("max_v"))
    upto = running_total(freq, [key], [F.col("_v")], "_n", "_cum")
    j = upto.join(n, key)
    at = lambda i: F.max(F.when((F.col("_cum") > i) & (F.col("_cum") - F.col("_n") <= i), F.col("_v")))
    last = F.col("n") - 1
    return j.groupBy(key).agg(
        F.first("n").alias("n"), F.bround(F.first(F.col("_sum").cast("double") / F.col("n")), 1).alias("avg"),
        F.bround((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2.0, 1).alias("median"),
        F.bround(at(F.bround(last * 0.95)), 1).alias("p95"),
        F.bround(F.first("min_v"), 1).alias("min"), F.bround(F.first("max_v"), 1).alias("max"))


def trailing_counts(events: DataFrame, user: str, ts: str, *, seconds: int, limit: int) -> DataFrame:
    """Events of the same user in (now - window, now], and whether that exceeds the limit.

    The count up to now less the count up to now - window: each different moment of a user
    and the border of its window go into one sort of the whole table, and running totals
    over its partitions give both counts.  Events of one moment are counted beforehand,
    and no task holds a user or a stretch of time, however many events fall there.

    An event without a time stays and has 0 in its window; events without a user are those
    of one user.
    """
    us = F.col("_us")
    timed = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    moments = timed.filter(us.isNotNull()).groupBy(user, "_us").agg(F.count(F.lit(1)).alias("_n"))
    border = us - F.lit(seconds * 1_000_000)
    line = moments.select(user, F.explode(F.array(
        F.struct(us.alias("_at"), F.lit(False).alias("_border"), us, F.col("_n")),
        F.struct(border.alias("_at"), F.lit(True).alias("_border"), us, F.lit(0).cast("bigint").alias("_n")))).alias("_row")).select(user, "_row.*")
    totals = running_total(line, [user], [F.col("_at"), F.col("_border"), us], "_n", "_total")
    counts = totals.groupBy(user, "_us").agg(
        F.sum(F.when(F.col("_border"), -F.col("_total")).otherwise(F.col("_total"))).alias("_inside"))
    return null_safe_join(timed, counts, [user, "_us"], "left").withColumn(
        "in_window", F.coalesce("_inside", F.lit(0).cast("bigint"))).drop("_us", "_inside").withColumn(
        "limited", F.col("in_window") > limit)
