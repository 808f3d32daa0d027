from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.functions import money
from ledgerlens.operators import analytics, periods

METRIC = "metric_id string, report_id string, company_id string, normalized_metric_name string, value decimal(22,6), fiscal_year int, fiscal_quarter int, confidence_score decimal(4,3)"


def points(spark, *rows):
    data = [(f"m{i}", f"r{y}{q}", "c", name, D(str(v)), y, q, D("0.8")) for i, (name, v, y, q) in enumerate(rows)]
    return spark.createDataFrame(data, METRIC)


@pytest.mark.parametrize("now, before, absolute, percent, flags", [
    ("120", "100", "20", "20.00", []),
    ("100.235", "100", "0.235", "0.24", []),
    ("100.225", "100", "0.225", "0.22", []),      # half to even
    ("80", "100", "-20", "-20.00", []),
    ("50", "0", "50", None, ["division_by_zero"]),
    ("500", "-1000", "1500", "-150.00", ["negative_base"]),
])
def test_growth(spark, now, before, absolute, percent, flags):
    out = periods.compare_periods(points(spark, ("REVENUE", now, 2024, None), ("REVENUE", before, 2023, None))).collect()
    assert len(out) == 1
    assert out[0]["absolute_change"] == D(absolute)
    assert out[0]["percentage_change"] == (None if percent is None else D(percent))
    assert out[0]["flags"] == flags


def test_periods_pair_by_quarter_and_wrap(spark, rows):
    out = periods.compare_periods(points(
        spark, ("OCF", 27, 2025, 2), ("OCF", 25, 2025, 1), ("OCF", 24, 2024, 2), ("REV", 26, 2025, 1), ("REV", 24, 2024, 4),
        ("REV", 9, 2024, None)))
    assert rows(out, "metric_name", "comparison_type", "current_period", "previous_period") == [
        ("OCF", "QOQ", "Q2 2025", "Q1 2025"), ("OCF", "YOY", "Q2 2025", "Q2 2024"), ("REV", "QOQ", "Q1 2025", "Q4 2024")]


def test_missing_counterparts(spark, rows):
    out = periods.missing_periods(points(spark, ("REV", 26, 2025, 1), ("REV", 9, 2024, None)))
    assert rows(out, "comparison_type", "missing_period") == [("QOQ", "Q4 2024"), ("YOY", "FY2023"), ("YOY", "Q1 2024")]


def test_best_point_keeps_confidence_then_first(spark):
    df = spark.createDataFrame([
        ("b", "r", "c", "REV", D(2), 2024, None, D("0.9")), ("a", "r", "c", "REV", D(1), 2024, None, D("0.9")),
        ("c", "r", "c", "REV", D(3), 2024, None, D("0.5"))], METRIC)
    assert [r["metric_id"] for r in periods.best_points(df).collect()] == ["a"]


def reports(spark, *rows):
    return spark.createDataFrame(
        [(f"{c}{y}{q}", c, "10-K" if q is None else "10-Q", y, q) for c, y, q in rows],
        "report_id string, company_id string, report_type string, year int, quarter int"
    ).withColumn("uploaded_at", F.current_timestamp())


def test_previous_report_rules_differ(spark, rows):
    r = reports(spark, ("a", 2023, None), ("a", 2024, 1), ("a", 2024, 4), ("a", 2024, None))
    prior = dict(rows(periods.prior_report(r), "report_id", "prior_report_id"))
    assert prior["a20241"] == "a2023None" and prior["a2023None"] is None
    assert {prior["a20244"], prior["a2024None"]} == {"a20241", "a20244"}      # annual counts as quarter 4
    assert rows(periods.latest_report(r), "report_id") == [("a2024None",)]    # NULL quarter is newest
    earlier = dict(rows(periods.strictly_earlier_report(r, r), "report_id", "previous_report_id"))
    assert earlier["a2024None"] == "a2023None" and earlier["a20244"] == "a20241"


def test_prior_report_with_one_company_owning_everything(spark):
    r = reports(spark, *[("hot", 1950 + i // 4, i % 4 + 1) for i in range(200)])
    got = {x["report_id"]: x["prior_report_id"] for x in periods.prior_report(r).collect()}
    ids = [f"hot{1950 + i // 4}{i % 4 + 1}" for i in range(200)]
    assert all(got[b] == a for a, b in zip(ids, ids[1:])) and got[ids[0]] is None


def test_healthy_growth_scenario(spark):
    values = {"REVENUE": 1000, "GROSS_PROFIT": 600, "OPERATING_INCOME": 200, "NET_INCOME": 150, "TOTAL_DEBT": 200,
              "OPERATING_CASH_FLOW": 250, "FREE_CASH_FLOW": 200}
    m = spark.createDataFrame(
        [(n, "r", "c", n, D(v), 2024, None, D("0.9")) for n, v in values.items()], METRIC)
    comparisons = spark.createDataFrame([
        ("REVENUE", "c", "REVENUE", "YOY", D(1000), D(800), D(200), D("0.25")),
        ("NET_INCOME", "c", "NET_INCOME", "YOY", D(150), D(80), D(70), D("0.87")),
        ("TOTAL_DEBT", "c", "TOTAL_DEBT", "YOY", D(200), D(200), D(0), D("0.00")),
        ("FREE_CASH_FLOW", "c", "FREE_CASH_FLOW", "YOY", D(200), D(100), D(100), D("1.00")),
    ], "metric_id string, company_id string, metric_name string, comparison_type string, current_value decimal(22,6), previous_value decimal(22,6), absolute_change decimal(22,6), percentage_change decimal(18,2)")
    out = {r["signal_code"]: r for r in analytics.build_analytics(m, comparisons).collect()}
    assert {c: float(out[c]["value"]) for c in ("GROSS_MARGIN", "OPERATING_MARGIN", "NET_MARGIN", "DEBT_TO_REVENUE", "CASH_FLOW_MARGIN")} == {
        "GROSS_MARGIN": .6, "OPERATING_MARGIN": .2, "NET_MARGIN": .15, "DEBT_TO_REVENUE": .2, "CASH_FLOW_MARGIN": .25}
    assert out["REVENUE_GROWTH_YOY"]["severity"] == "VERY_POSITIVE"
    assert out["DEBT_CHANGE_YOY"]["classification"] == "DEBT_UNCHANGED"
    assert out["LEVERAGE_IMPROVEMENT_YOY"]["severity"] == "POSITIVE"
    assert out["CASH_GENERATION_IMPROVEMENT_YOY"]["signal_type"] == "CASH_FLOW"
    assert out["REVENUE_GROWTH_YOY"]["explanation"] == "Revenue grew by +25.00% YOY (from 800.00 to 1,000.00)."
    assert out["GROSS_MARGIN"]["explanation"] == "Gross Margin is 60.00%"


def test_literal_and_scaled_percentages(spark):
    c = spark.createDataFrame(
        [("m", "c", "r", "REVENUE", "YOY", D(101), D(100), D(1), D("1.00"))],
        "metric_id string, company_id string, report_id string, metric_name string, comparison_type string, current_value decimal(22,6), previous_value decimal(22,6), absolute_change decimal(22,6), percentage_change decimal(18,2)")
    cls = lambda **kw: analytics.comparison_signals(c, **kw).first()["classification"]
    assert cls() == "STRONG_GROWTH" and cls(pct_scale=100) == "LOW_GROWTH"


def test_impossible_ratio_is_dropped(spark):
    m = spark.createDataFrame([("a", "r", "c", "GROSS_MARGIN", D("43.3"), 2024, None, D(".9"))], METRIC)
    assert analytics.valid_ratios(analytics.ratios(m)).count() == 0


@pytest.mark.parametrize("text, value, currency, unit", [
    ("$96.7 billion", "96700000000", "USD", "BILLION"), ("$96,700 million", "96700000000", "USD", "MILLION"),
    ("28.5%", "28.5", None, "PERCENT"), ("(1,234) million", "1234", None, "ABSOLUTE"), ("(1,234)", "-1234", None, "ABSOLUTE"),
    ("€3.1bn", "3100000000", "EUR", "BILLION"), ("about 28.5 percent", "28.5", None, "PERCENT"), ("-12", "-12", None, "ABSOLUTE"),
])
def test_values(spark, text, value, currency, unit):
    v = spark.createDataFrame([(text,)], "t string").select(money.find_values(F.col("t"))[0].alias("v")).first()["v"]
    if text == "(1,234) million":       # the closing parenthesis comes before the scale word
        assert v["value"] == D("-1234") and v["unit"] == "ABSOLUTE"
    else:
        assert (v["value"], v["currency"], v["unit"]) == (D(value), currency, unit)


def test_values_of_many_digits_keep_their_scale(spark, rows, tmp_path):
    from ledgerlens import plans

    texts = [(7, "b89aa5fcc 12345678901234b or 5 million"), (14, "(9,999,999,999,999,999.5 trillion)"), (21, "99999999999999999k")]
    found = spark.createDataFrame(texts, "i long, t string").select("i", money.find_values(F.col("t")).alias("v"))
    assert [r["value"] for r in found.filter("i = 14").first()["v"]] == [D("-9999999999999999.5").scaleb(12)]
    assert D("12345678901234000000000") in [r["value"] for r in found.filter("i = 7").first()["v"]]
    assert [r["value"] for r in found.filter("i = 21").first()["v"]] == [None]  # seventeen digits are no amount
    spark.createDataFrame([(i, t, "en", "web", 9) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["chunk_id"]: r["raws"].split("|") for r in plans.QUERIES["metric_values_in_text"](spark, str(tmp_path)).collect()}
    assert "12345678901234b" in out["7"] and "(9,999,999,999,999,999.5 trillion)" in out["14"] and "99999999999999999k" in out["21"]


def test_schemas_parse(spark):
    for ddl in schemas.TABLES.values():
        assert spark.createDataFrame([], ddl).count() == 0
