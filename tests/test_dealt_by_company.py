"""Work per company stays where the company lies."""

from decimal import Decimal

from ledgerlens.operators import periods

METRICS = "metric_id string, company_id string, normalized_metric_name string, fiscal_year int, fiscal_quarter int, value decimal(22,6)"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_comparisons_of_dealt_companies_shuffle_nothing(spark, rows):
    points = [(f"{c}-{y}-{q}", c, "REVENUE", y, q, Decimal(y * 10 + (q or 0))) for c in ("a", "b") for y in (2020, 2021) for q in (None, 1, 4)]
    m = spark.createDataFrame([p for p in points if p[0] != "b-2020-4"], METRICS)
    out = periods.compare_periods(m.repartition(4, "company_id"), deduped=True)
    assert plan(out).count("Exchange") == 1
    assert rows(out, "metric_id", "comparison_type", "previous_period") == sorted([
        ("a-2021-None", "YOY", "FY2020"), ("b-2021-None", "YOY", "FY2020"), ("a-2021-1", "YOY", "Q1 2020"), ("b-2021-1", "YOY", "Q1 2020"),
        ("a-2021-4", "YOY", "Q4 2020"), ("a-2021-1", "QOQ", "Q4 2020")], key=repr)
