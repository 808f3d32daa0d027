"""Fiscal-period operators: candidate choice, period self-joins, growth, report order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import money
from ledgerlens.functions.grouped import first_per, number_rows

POINT = ["company_id", "normalized_metric_name", "fiscal_year", "fiscal_quarter"]


def best_points(metrics: DataFrame, keys: list[str] = POINT) -> DataFrame:
    """One metric per key: highest confidence; on a tie the smallest ``metric_id``."""
    return first_per(metrics, keys, [-F.col("confidence_score"), F.col("metric_id")])


def _paired(points: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Each point and comparison with the value of its counterpart period, NULL if absent.

    A self-join would compute ``points`` twice.  Instead each point looks at the one right
    before it: among those of its quarter (annual points among themselves) for the year
    before, among all quarters for the quarter before.  If the counterpart exists, it is
    that one.  ``points`` holds one row per key, see :func:`best_points`, and a company few
    periods; where companies lie together already, nothing is shuffled.
    """
    y, q = F.col("fiscal_year"), F.col("fiscal_quarter")
    series = ["company_id", "normalized_metric_name"]
    asks = {  # type: (it applies, counterpart year and quarter, window)
        "YOY": (y.isNotNull(), y - 1, q, Window.partitionBy(*series, "fiscal_quarter").orderBy("fiscal_year")),
        "QOQ": (y.isNotNull() & q.isNotNull(), F.when(q == 1, y - 1).otherwise(y), F.when(q == 1, F.lit(4)).otherwise(q - 1),
                Window.partitionBy(*series, q.isNull()).orderBy("fiscal_year", "fiscal_quarter")),
    }
    seen = points
    for t in types:
        seen = seen.withColumn(f"_{t}", F.lag(F.struct(y.alias("y"), q.alias("q"), "value")).over(asks[t][3]))

    def asked(t: str) -> Column:
        applies, year, quarter, _ = asks[t]
        before = F.col(f"_{t}")
        found = (before["y"] == year) & before["q"].eqNullSafe(quarter)
        return F.when(applies, F.struct(
            F.lit(t).alias("comparison_type"), year.alias("prev_year"), quarter.cast("int").alias("prev_quarter"),
            F.when(found, before["value"]).alias("previous_value")))

    return seen.select(*points.columns, F.explode(F.array_compact(F.array(*[asked(t) for t in types]))).alias("_a")).select(
        *points.columns, "_a.*")


def compare_periods(
    metrics: DataFrame, types: tuple[str, ...] = ("YOY", "QOQ"), *, deduped: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Year-over-year and quarter-over-quarter comparisons for every company at once.

    ``carry`` names further columns of the current metric to keep, such as its report.
    """
    points = metrics if deduped else best_points(metrics)
    points = points.select("metric_id", *POINT, "value", *carry)
    cur, prev = F.col("value"), F.col("previous_value")
    return _paired(points, types).filter("previous_value is not null").select(
        "metric_id", "company_id", *carry,
        F.col("normalized_metric_name").alias("metric_name"), "comparison_type",
        money.period_label(F.col("fiscal_year"), F.col("fiscal_quarter")).alias("current_period"),
        money.period_label(F.col("prev_year"), F.col("prev_quarter")).alias("previous_period"),
        cur.alias("current_value"), prev.alias("previous_value"),
        (cur - prev).cast(money.AMOUNT).alias("absolute_change"),
        money.percent_change(cur, prev).alias("percentage_change"),
        money.change_flags(cur, prev).alias("flags"),
    )


def missing_periods(metrics: DataFrame, types: tuple[str, ...] = ("YOY", "QOQ")) -> DataFrame:
    """Points whose comparison applies but whose counterpart period is absent."""
    points = best_points(metrics).select("metric_id", *POINT, "value")
    return _paired(points, types).filter("previous_value is null").select(
        "metric_id", "company_id",
        F.col("normalized_metric_name").alias("metric_name"), "comparison_type",
        money.period_label(F.col("prev_year"), F.col("prev_quarter")).alias("missing_period"),
    )


def comparison_run_stats(metrics: DataFrame, types: tuple[str, ...] = ("YOY", "QOQ")) -> DataFrame:
    """Per company: points, comparisons, missing periods and share of points covered."""
    points = best_points(metrics).select("metric_id", *POINT, "value")
    # per point first: a point is covered when any of its comparisons found a counterpart
    found = F.col("previous_value").isNotNull()
    per_point = _paired(points, types).groupBy("company_id", "metric_id").agg(
        F.count_if(found).alias("_met"), F.count_if(~found).alias("_open"))
    return per_point.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("points"), F.sum("_met").alias("comparisons"), F.sum("_open").alias("missing"),
        F.bround(F.count_if(F.col("_met") > 0) / F.count(F.lit(1)), 4).alias("coverage"))


# --- report order -----------------------------------------------------------------
def prior_report(reports: DataFrame) -> DataFrame:
    """The report right before each one in (year, quarter or 4) order within its company.

    Ties follow ``report_id``.  Positions come from :func:`number_rows`, so a company with
    very many reports is not handled by one task, and the look-back is an equi-join on
    (company, position), whose keys are unique.
    """
    r = reports.select(
        "company_id", "report_id",
        money.period_order(F.col("year"), F.col("quarter")).alias("period_ord"),
    )
    numbered = number_rows(r, ["company_id"], [F.col("period_ord"), F.col("report_id")], "_n")
    before = numbered.select(
        "company_id", (F.col("_n") + 1).alias("_n"), F.col("report_id").alias("prior_report_id")
    )
    return numbered.join(before, ["company_id", "_n"], "left").select(
        "company_id", "report_id", "period_ord", "prior_report_id"
    )


def _recency() -> list[Column]:
    """Newest first: year down, annual before quarters (NULLs first), then upload time down."""
    return [
        F.col("year").desc_nulls_first(), F.col("quarter").desc_nulls_first(),
        F.col("uploaded_at").desc_nulls_first(), F.col("report_id"),
    ]


def latest_report(reports: DataFrame, year: int | None = None) -> DataFrame:
    """Newest report per company, optionally of one year; combined on the map side."""
    pool = reports if year is None else reports.filter(F.col("year") == year)
    w = Window.partitionBy("company_id").orderBy(*_recency())
    return pool.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def strictly_earlier_report(current: DataFrame, reports: DataFrame) -> DataFrame:
    """Newest report strictly before each given one.

    A quarterly report looks at earlier quarters of its year, then at earlier years; an
    annual report looks at earlier years only.  Reports first collapse to the newest of
    each period slot, so the look-back windows see four quarters of a year or the years of
    a company, and no two reports of a company are paired.
    """
    newest = F.struct(-F.unix_micros(F.col("uploaded_at").cast("timestamp")), F.col("report_id"))
    slots = reports.groupBy("company_id", "year", "quarter").agg(F.min_by("report_id", newest).alias("_best"))
    in_year = Window.partitionBy("company_id", "year").orderBy("quarter")
    quarters = slots.filter("quarter is not null").select(
        "company_id", "year", "quarter", F.lag("_best").over(in_year).alias("_same_year"))
    annual_first = F.struct(F.col("quarter").isNotNull(), -F.col("quarter"))
    years = slots.groupBy("company_id", "year").agg(F.min_by("_best", annual_first).alias("_top"))
    over_years = Window.partitionBy("company_id").orderBy("year")
    before = years.select("company_id", "year", F.lag("_top").over(over_years).alias("_year_before"))
    return (
        current.select("company_id", "report_id", "year", "quarter")
        .join(before, ["company_id", "year"], "left")
        .join(quarters, ["company_id", "year", "quarter"], "left")
        .select("company_id", "report_id", F.coalesce("_same_year", "_year_before").alias("previous_report_id"))
        .filter("previous_report_id is not null")
    )
