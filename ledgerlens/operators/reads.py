"""Read-side operators: lookups, lists, projections and display values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions import money
from ledgerlens.functions.grouped import number_rows, top_per


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key; the predicate reaches the scan."""
    return df.filter(F.col(key) == value)


def select_where(df: DataFrame, **filters) -> DataFrame:
    """Rows that satisfy every given equality; arguments left at None do not filter."""
    for name, value in filters.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def page(df: DataFrame, order: list[Column], *, limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered list with the total number of rows.

    The page is a bounded top-n; the total is a scalar subquery.
    """
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def sort_by(df: DataFrame, column: str, *, descending: bool = False, tie: str | None = None) -> DataFrame:
    """Sort by any column, either way; NULLs come last both ways."""
    c = F.col(column)
    first = c.desc_nulls_last() if descending else c.asc_nulls_last()
    return df.orderBy(first, *([F.col(tie)] if tie else []))


def listed(df: DataFrame, per: list[str], keys: list[str], *, tie: str, bounded: bool = False) -> DataFrame:
    """Every row with its ``place`` in the list of its owner, by several keys up, NULLs last."""
    return number_rows(df, per, [*[F.col(k).asc_nulls_last() for k in keys], F.col(tie)], "place", bounded=bounded)


def with_report(df: DataFrame, reports: DataFrame) -> DataFrame:
    """Facts with their report's company and period (company history)."""
    facts = reports.select("report_id", "company_id", "year", "quarter", "report_type")
    return df.drop("company_id").join(facts, "report_id")


def ratios_only(analytics: DataFrame) -> DataFrame:
    return analytics.filter(F.col("signal_code").isin(vocab.RATIO_CODES))


def signals_only(analytics: DataFrame) -> DataFrame:
    return analytics.filter(~F.col("signal_code").isin(vocab.RATIO_CODES))


def chart_series(comparisons: DataFrame, term: str) -> DataFrame:
    """Comparisons whose metric name contains a term, oldest period first."""
    p = F.col("current_period")
    year = F.regexp_extract(p, r"(\d{4})", 1).try_cast("int")
    quarter = F.regexp_extract(p, r"Q(\d)", 1).try_cast("int")
    return comparisons.filter(F.lower("metric_name").contains(term.lower())).withColumn(
        "period_ord", money.period_order(year, quarter)).sort("company_id", "period_ord")


def headline(reports: DataFrame, metrics: DataFrame, analytics: DataFrame, name: str) -> DataFrame:
    """Extracted metric if present, else the analytics row of that name, with its source."""
    m = metrics.filter(F.upper("normalized_metric_name") == name).groupBy("report_id").agg(
        F.min_by("value", "metric_id").alias("_m"))
    a = analytics.filter((F.upper("metric_name") == name) | (F.upper("signal_code") == name)).groupBy("report_id").agg(
        F.min_by("value", "signal_code").alias("_a"))
    return reports.select("report_id").join(m, "report_id", "left").join(a, "report_id", "left").select(
        "report_id", F.coalesce("_m", "_a").alias("value"),
        F.when(F.col("_m").isNotNull(), F.lit("metric")).when(F.col("_a").isNotNull(), F.lit("analytic")).alias("source_kind"))


def progress(status: Column, completed_stage: Column) -> Column:
    """Percent done; a failed report shows the value of its last completed stage."""
    table = F.create_map(*[F.lit(x) for kv in vocab.PROGRESS.items() for x in kv])
    done = F.when(completed_stage.isin(vocab.STAGES), table[completed_stage])
    return F.coalesce(F.when(status == "FAILED", done).otherwise(table[status]), F.lit(0))


def display_amount(value: Column, unit: Column, currency: Column) -> Column:
    """``$1.25B`` style text: the declared unit, else the magnitude, gives the suffix."""
    u, size = F.upper(F.coalesce(unit, F.lit(""))), F.abs(value)
    declared = F.when(u.isin("BILLION", "B"), F.lit("B")).when(u.isin("MILLION", "M"), F.lit("M"))
    power = F.when(declared.isNotNull(), F.lit(0)).when(size >= 10 ** 9, F.lit(9)).when(
        size >= 10 ** 6, F.lit(6)).when(size >= 10 ** 3, F.lit(3)).otherwise(F.lit(0))
    suffix = F.coalesce(declared, F.create_map(
        F.lit(9), F.lit("B"), F.lit(6), F.lit("M"), F.lit(3), F.lit("K"))[power], F.lit(""))
    shown = value.cast("double") / F.pow(F.lit(10.0), power)
    two, three = F.format_number(shown, 2), F.format_number(shown, 3)
    number = F.when(suffix != "", F.regexp_replace(two, "0$", "")).otherwise(
        F.regexp_replace(F.regexp_replace(three, "0+$", ""), r"\.$", ""))
    code = F.upper(F.coalesce(currency, F.lit("USD")))
    prefix = F.when(code == "USD", F.lit("$")).otherwise(F.concat(currency, F.lit(" ")))
    return F.when(value.isNull(), F.lit("—")).otherwise(F.concat(prefix, number, suffix))


def display_percent(value: Column, kind: str) -> Column:
    """One decimal; analytics are fractions, metrics below one are taken for fractions."""
    scaled = value * 100 if kind == "analytic" else F.when(F.abs(value) < 1, value * 100).otherwise(value)
    return F.when(value.isNull(), F.lit("—")).otherwise(F.concat(F.format_number(scaled.cast("double"), 1), F.lit("%")))


def section_map(sections: DataFrame) -> DataFrame:
    return sections.select("report_id", "section_name", "normalized_section_name", "start_page", "end_page", "confidence_score")


def chunk_map(chunks: DataFrame) -> DataFrame:
    return chunks.select("report_id", "chunk_index", "section", "start_page", "end_page", "token_count")


def tool_rows(table: DataFrame, reports: DataFrame, *, report_id: str | None = None, company_id: str | None = None) -> DataFrame:
    """Rows of one report, else of one company; the report wins when both are given."""
    if report_id is not None:
        return by_key(table, "report_id", report_id)
    if company_id is not None:
        mine = by_key(reports, "company_id", company_id).select("report_id")
        return table.join(mine, "report_id", "left_semi")
    return table


def thread_history(messages: DataFrame, last: int | None = None) -> DataFrame:
    """Messages of each thread with their place counted from the end; optionally only the last ones.

    Turns order a thread; they may have gaps and repeat.  The last ones are cut on the map
    side, and places in whole threads come from a sort of the table, so no thread is
    sorted in one task.
    """
    order = [F.col("turn").desc(), F.col("role"), F.col("text")]
    if last is None:
        placed = number_rows(messages, ["conv_id"], order, "from_end")
    else:
        placed = top_per(messages, ["conv_id"], order, last, "from_end")
    return placed.join(messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages")), "conv_id")
