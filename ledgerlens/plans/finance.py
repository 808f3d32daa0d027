"""Registered queries over metrics, comparisons, ratios and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions import money
from ledgerlens.operators import analytics, periods, reads, summaries
from ledgerlens.plans import sql as S
from ledgerlens.plans.registry import query
from ledgerlens.session import cut_lineage
from ledgerlens.sources import derive

_FLAT = "* EXCLUDE (flags, report_id), array_to_string(flags, ',') AS flags"


def _comparisons(spark, sf, *, located=False):
    m = derive.metrics(spark, sf)
    return periods.compare_periods(m, deduped=True, carry=("report_id",) if located else ())


@query("period_comparison", S.with_tables(f"SELECT {_FLAT} FROM point_comparisons"))
def period_comparison(spark, sf):
    out = periods.compare_periods(derive.candidate_metrics(spark, sf))
    return out.withColumn("flags", F.array_join("flags", ","))


@query("best_metric_points", S.with_tables(
    "SELECT metric_id, company_id, normalized_metric_name, fiscal_year, fiscal_quarter, value, confidence_score FROM points_t"))
def best_metric_points(spark, sf):
    return periods.best_points(derive.candidate_metrics(spark, sf)).select(
        "metric_id", "company_id", "normalized_metric_name", "fiscal_year", "fiscal_quarter", "value", "confidence_score")


@query("missing_periods", S.with_tables(f"""
SELECT metric_id, company_id, normalized_metric_name AS metric_name, comparison_type, {S.label("py", "pq")} AS missing_period
FROM wanted_points w
WHERE NOT EXISTS (SELECT 1 FROM points_t p WHERE p.company_id = w.company_id AND p.normalized_metric_name = w.normalized_metric_name
                  AND p.fiscal_year = w.py AND p.fiscal_quarter IS NOT DISTINCT FROM w.pq)"""))
def missing_periods(spark, sf):
    return periods.missing_periods(derive.candidate_metrics(spark, sf))


@query("comparison_run_stats", S.with_tables("""
WITH m AS (SELECT w.company_id, w.metric_id, p.metric_id AS pid FROM wanted_points w LEFT JOIN points_t p
  ON p.company_id = w.company_id AND p.normalized_metric_name = w.normalized_metric_name
 AND p.fiscal_year = w.py AND p.fiscal_quarter IS NOT DISTINCT FROM w.pq)
SELECT t.company_id, t.points, count(pid) AS comparisons, count(*) - count(pid) AS missing,
       round_even(count(DISTINCT CASE WHEN pid IS NOT NULL THEN m.metric_id END) / t.points, 4) AS coverage
FROM (SELECT company_id, count(*) AS points FROM points_t GROUP BY 1) t JOIN m USING (company_id) GROUP BY 1, 2"""))
def comparison_run_stats(spark, sf):
    return periods.comparison_run_stats(derive.candidate_metrics(spark, sf))


@query("prior_report", S.with_tables("""
SELECT company_id, report_id, year * 4 + coalesce(quarter, 4) AS period_ord,
       lag(report_id) OVER (PARTITION BY company_id ORDER BY year * 4 + coalesce(quarter, 4), report_id) AS prior_report_id
FROM reports_t"""))
def prior_report(spark, sf):
    return periods.prior_report(derive.reports(spark, sf))


_LATEST = "ORDER BY year DESC, quarter DESC NULLS FIRST, uploaded_s DESC, report_id"


@query("latest_report", S.with_tables(f"""
SELECT company_id, report_id, year, quarter FROM reports_t
QUALIFY row_number() OVER (PARTITION BY company_id {_LATEST}) = 1"""))
def latest_report(spark, sf):
    return periods.latest_report(derive.reports(spark, sf)).select("company_id", "report_id", "year", "quarter")


@query("strictly_earlier_report", S.with_tables(f"""
SELECT c.company_id, c.report_id, p.report_id AS previous_report_id
FROM reports_t c JOIN reports_t p ON c.company_id = p.company_id
 AND (p.year < c.year OR (p.year = c.year AND p.quarter < c.quarter))
QUALIFY row_number() OVER (PARTITION BY c.company_id, c.report_id
        ORDER BY p.year DESC, p.quarter DESC NULLS FIRST, p.uploaded_s DESC, p.report_id) = 1"""))
def strictly_earlier_report(spark, sf):
    r = derive.reports(spark, sf)
    return periods.strictly_earlier_report(r, r)


# --- ratios and signals ----------------------------------------------------------------
_RATIO_CELLS = [
    ("GROSS_MARGIN", "GROSS_PROFIT", "GROSS_MARGIN"), ("OPERATING_MARGIN", "OPERATING_INCOME", "OPERATING_MARGIN"),
    ("NET_MARGIN", "NET_INCOME", "NET_MARGIN"), ("DEBT_TO_REVENUE", "TOTAL_DEBT", None),
    ("CASH_FLOW_MARGIN", "OPERATING_CASH_FLOW", None),
]


def _value(name):
    return f"max(CASE WHEN normalized_metric_name = '{name}' THEN value END)"


def _ratio_sql(code, top, given):
    made = f"CASE WHEN {_value('REVENUE')} <> 0 THEN CAST({_value(top)} AS DOUBLE) / CAST({_value('REVENUE')} AS DOUBLE) END"
    expr = f"coalesce({made}, CAST({_value(given)} AS DOUBLE))" if given else made
    return (f"SELECT company_id, report_id, '{code}' AS signal_code, CAST({expr} AS DECIMAL(22,6)) AS value "
            f"FROM metrics_t GROUP BY 1, 2 HAVING {expr} IS NOT NULL")


S.TABLES["ratios_t"] = " UNION ALL ".join(_ratio_sql(*c) for c in _RATIO_CELLS)


@query("ratios", S.with_tables("SELECT * FROM ratios_t WHERE abs(value) <= 20"))
def ratios(spark, sf):
    r = analytics.valid_ratios(analytics.ratios(derive.metrics(spark, sf)))
    return r.select("company_id", "report_id", "signal_code", "value")


_TREND = ("CASE WHEN percentage_change > 0.15 THEN 'STRONG_GROWTH' WHEN percentage_change >= 0.05 THEN 'MODERATE_GROWTH' "
          "WHEN percentage_change >= 0 THEN 'LOW_GROWTH' ELSE 'DECLINING' END")


def _sign(c, up, down, flat):
    return f"CASE WHEN {c} > 0 THEN '{up}' WHEN {c} < 0 THEN '{down}' ELSE '{flat}' END"


S.TABLES["signals_t"] = f"""
SELECT company_id, report_id, CASE WHEN metric_name = 'REVENUE' THEN 'GROWTH' WHEN metric_name IN ('NET_INCOME', 'EBITDA') THEN 'PROFITABILITY' ELSE 'CASH_FLOW' END AS signal_type,
       metric_name || '_GROWTH_' || comparison_type AS signal_code, metric_name, CAST(percentage_change AS DECIMAL(22,6)) AS value,
       {_TREND} AS classification,
       CASE {_TREND} WHEN 'STRONG_GROWTH' THEN 'VERY_POSITIVE' WHEN 'MODERATE_GROWTH' THEN 'POSITIVE' WHEN 'LOW_GROWTH' THEN 'NEUTRAL' ELSE 'NEGATIVE' END AS severity
FROM comparisons_t WHERE percentage_change IS NOT NULL AND metric_name IN {S.in_list(vocab.GROWTH_SIGNAL_TYPES)}
UNION ALL
SELECT company_id, report_id, 'PROFITABILITY', metric_name || '_CHANGE_' || comparison_type, metric_name, absolute_change,
       {_sign("absolute_change", "MARGIN_EXPANSION", "MARGIN_COMPRESSION", "MARGIN_UNCHANGED")},
       {_sign("absolute_change", "POSITIVE", "NEGATIVE", "NEUTRAL")}
FROM comparisons_t WHERE metric_name IN {S.in_list(vocab.MARGIN_METRICS)}
UNION ALL
SELECT company_id, report_id, 'LEVERAGE', 'DEBT_CHANGE_' || comparison_type, metric_name, CAST(percentage_change AS DECIMAL(22,6)),
       {_sign("percentage_change", "DEBT_INCREASE", "DEBT_REDUCTION", "DEBT_UNCHANGED")},
       {_sign("percentage_change", "NEGATIVE", "POSITIVE", "NEUTRAL")}
FROM comparisons_t WHERE metric_name = 'TOTAL_DEBT' AND percentage_change IS NOT NULL
UNION ALL
SELECT company_id, report_id, 'CASH_FLOW', CASE WHEN percentage_change > 0 THEN 'CASH_GENERATION_IMPROVEMENT' ELSE 'CASH_FLOW_DETERIORATION' END || '_' || comparison_type,
       metric_name, CAST(percentage_change AS DECIMAL(22,6)),
       CASE WHEN percentage_change > 0 THEN 'CASH_GENERATION_IMPROVEMENT' ELSE 'CASH_FLOW_DETERIORATION' END,
       {_sign("percentage_change", "POSITIVE", "NEGATIVE", "NEUTRAL")}
FROM comparisons_t WHERE metric_name = 'FREE_CASH_FLOW' AND percentage_change <> 0"""
S.TABLES["leverage_t"] = f"""
SELECT company_id, report_id, 'LEVERAGE' AS signal_type, cls || '_' || comparison_type AS signal_code, 'DEBT_TO_REVENUE' AS metric_name, CAST(gap AS DECIMAL(22,6)) AS value, cls AS classification,
       {_sign("gap", "NEGATIVE", "POSITIVE", "NEUTRAL")} AS severity
FROM (SELECT *, {_sign("gap", "LEVERAGE_DETERIORATION", "LEVERAGE_IMPROVEMENT", "LEVERAGE_UNCHANGED")} AS cls
      FROM (SELECT d.company_id, d.report_id, d.comparison_type,
                   CAST(d.current_value AS DOUBLE) / CAST(r.current_value AS DOUBLE) - CAST(d.previous_value AS DOUBLE) / CAST(r.previous_value AS DOUBLE) AS gap
            FROM comparisons_t d JOIN comparisons_t r USING (company_id, report_id, comparison_type)
            WHERE d.metric_name = 'TOTAL_DEBT' AND r.metric_name = 'REVENUE' AND r.current_value <> 0 AND r.previous_value <> 0))"""
S.TABLES["guidance_points"] = """
SELECT g.*, lag(value) OVER (PARTITION BY company_id, normalized_metric_name ORDER BY ord) AS before_value
FROM (SELECT company_id, normalized_metric_name, fiscal_year * 4 + coalesce(fiscal_quarter, 4) AS ord, max_by(value, metric_id) AS value
      FROM metrics_t WHERE normalized_metric_name IN ('REVENUE_GUIDANCE', 'MARGIN_GUIDANCE') GROUP BY 1, 2, 3) g"""
S.TABLES["guidance_t"] = f"""
SELECT company_id, report_id, 'GUIDANCE' AS signal_type, CASE WHEN metric_name = 'MARGIN_GUIDANCE' THEN 'MARGIN_' ELSE '' END || cls AS signal_code,
       metric_name, gap AS value, cls AS classification, {_sign("gap", "VERY_POSITIVE", "VERY_NEGATIVE", "NEUTRAL")} AS severity
FROM (SELECT m.company_id, m.report_id, m.normalized_metric_name AS metric_name, CAST(m.value - g.before_value AS DECIMAL(22,6)) AS gap,
             {_sign("m.value - g.before_value", "GUIDANCE_RAISED", "GUIDANCE_LOWERED", "GUIDANCE_MAINTAINED")} AS cls
      FROM metrics_t m JOIN guidance_points g ON g.company_id = m.company_id AND g.normalized_metric_name = m.normalized_metric_name
       AND g.ord = m.fiscal_year * 4 + coalesce(m.fiscal_quarter, 4) WHERE g.before_value IS NOT NULL)
UNION ALL
SELECT m.company_id, m.report_id, 'GUIDANCE', CASE WHEN m.value > a.value THEN 'GUIDANCE_ABOVE_ACTUAL' ELSE 'GUIDANCE_BELOW_ACTUAL' END,
       'REVENUE_GUIDANCE', CAST(m.value - a.value AS DECIMAL(22,6)), CASE WHEN m.value > a.value THEN 'GUIDANCE_ABOVE_ACTUAL' ELSE 'GUIDANCE_BELOW_ACTUAL' END,
       CASE WHEN m.value > a.value THEN 'POSITIVE' ELSE 'NEGATIVE' END
FROM metrics_t m JOIN guidance_points g ON g.company_id = m.company_id AND g.normalized_metric_name = m.normalized_metric_name
 AND g.ord = m.fiscal_year * 4 + coalesce(m.fiscal_quarter, 4)
JOIN metrics_t a ON a.report_id = m.report_id AND a.normalized_metric_name = 'REVENUE'
WHERE g.before_value IS NULL AND m.normalized_metric_name = 'REVENUE_GUIDANCE'"""

_SIG = ["company_id", "report_id", "signal_type", "signal_code", "metric_name", "value", "classification", "severity"]


@query("comparison_signals", S.with_tables("SELECT * FROM signals_t"))
def comparison_signals(spark, sf):
    return analytics.comparison_signals(_comparisons(spark, sf, located=True)).select(*_SIG)


@query("leverage_signals", S.with_tables("SELECT * FROM leverage_t"))
def leverage_signals(spark, sf):
    return analytics.leverage_signals(_comparisons(spark, sf, located=True)).select(*_SIG)


@query("guidance_signals", S.with_tables("SELECT * FROM guidance_t"))
def guidance_signals(spark, sf):
    return analytics.guidance_signals(derive.metrics(spark, sf)).select(*_SIG)


S.TABLES["analytics_t"] = """
SELECT * FROM signals_t UNION ALL SELECT * FROM leverage_t UNION ALL SELECT * FROM guidance_t UNION ALL
SELECT company_id, report_id, CASE WHEN signal_code = 'DEBT_TO_REVENUE' THEN 'LEVERAGE' WHEN signal_code = 'CASH_FLOW_MARGIN' THEN 'CASH_FLOW' ELSE 'PROFITABILITY' END,
       signal_code, signal_code, value, 'RATIO', 'NEUTRAL' FROM ratios_t WHERE abs(value) <= 20"""


def _analytics(spark, sf):
    # several branches read the metrics: the sums they are made of are written once, a tenth of their size
    m = derive.metrics(spark, sf, cut_lineage(derive.quarter_sums(spark, sf)))
    return analytics.build_analytics(m, periods.compare_periods(m, deduped=True, carry=("report_id",)))


@query("report_analytics", S.with_tables("SELECT * FROM analytics_t"))
def report_analytics(spark, sf):
    return _analytics(spark, sf).select(*_SIG)


@query("analytics_explanations")
def analytics_explanations(spark, sf):
    return _analytics(spark, sf).select("report_id", "signal_code", "explanation")


@query("ratio_signal_split", S.with_tables(f"""
SELECT company_id, signal_code IN {S.in_list(vocab.RATIO_CODES)} AS is_ratio, count(*) AS rows_found FROM analytics_t GROUP BY 1, 2"""))
def ratio_signal_split(spark, sf):
    a = _analytics(spark, sf)
    both = reads.ratios_only(a).withColumn("is_ratio", F.lit(True)).unionByName(
        reads.signals_only(a).withColumn("is_ratio", F.lit(False)))
    return both.groupBy("company_id", "is_ratio").agg(F.count(F.lit(1)).alias("rows_found"))


@query("trend_classes_scaled", S.with_tables(f"""
SELECT metric_name, comparison_type, {_TREND.replace("percentage_change", "(percentage_change / 100.0)")} AS trend, count(*) AS n
FROM comparisons_t WHERE percentage_change IS NOT NULL GROUP BY 1, 2, 3"""))
def trend_classes_scaled(spark, sf):
    rate = (F.col("percentage_change").cast("decimal(22,6)") / F.lit(100)).cast("decimal(22,6)")
    return _comparisons(spark, sf).filter("percentage_change is not null").groupBy(
        "metric_name", "comparison_type", analytics.growth_trend(rate).alias("trend")
    ).agg(F.count(F.lit(1)).alias("n"))


# --- summaries and reads -----------------------------------------------------------------
@query("metric_summary", S.with_tables("""
SELECT report_id, count(*) AS total, CAST(round_even(CAST(avg(confidence_score) AS DOUBLE), 4) AS DOUBLE) AS avg_confidence,
       count(*) FILTER (metric_category = 'PROFITABILITY') AS profitability, count(*) FILTER (extraction_method = 'RULE_BASED') AS rule_based
FROM metrics_t GROUP BY 1"""))
def metric_summary(spark, sf):
    out = summaries.metric_summary(derive.metrics(spark, sf))
    return out.select(
        "report_id", "total", "avg_confidence",
        F.coalesce(F.col("by_category")["PROFITABILITY"], F.lit(0)).alias("profitability"),
        F.coalesce(F.col("by_method")["RULE_BASED"], F.lit(0)).alias("rule_based"))


@query("comparison_summary", S.with_tables("""
SELECT company_id, comparison_type, metric_name, count(*) AS n FROM comparisons_t
GROUP BY GROUPING SETS ((company_id), (company_id, comparison_type), (company_id, metric_name))"""))
def comparison_summary(spark, sf):
    return summaries.counts_by(_comparisons(spark, sf), "company_id", ["comparison_type", "metric_name"])


@query("analytics_summary", S.with_tables("""
SELECT company_id, signal_type, severity, count(*) AS n FROM analytics_t
GROUP BY GROUPING SETS ((company_id), (company_id, signal_type), (company_id, severity))"""))
def analytics_summary(spark, sf):
    return summaries.counts_by(_analytics(spark, sf), "company_id", ["signal_type", "severity"])


@query("comparisons_of_reports", S.with_tables("SELECT report_id, metric_id, comparison_type, percentage_change FROM comparisons_t"))
def comparisons_of_reports(spark, sf):
    # a comparison carries the report of its current metric, so no metric is looked up by its id
    return _comparisons(spark, sf, located=True).select("report_id", "metric_id", "comparison_type", "percentage_change")


@query("company_metric_history", S.with_tables("""
SELECT m.company_id, m.metric_id, r.year, r.quarter, r.report_type, m.value FROM metrics_t m JOIN reports_t r USING (report_id)"""))
def company_metric_history(spark, sf):
    m = derive.metrics(spark, sf).select("metric_id", "report_id", "value")
    return reads.with_report(m, derive.reports(spark, sf)).select(
        "company_id", "metric_id", "year", "quarter", "report_type", "value")


@query("chart_series", S.with_tables("""
SELECT company_id, metric_name, comparison_type, current_period, current_value FROM comparisons_t WHERE contains(lower(metric_name), 'revenue')"""))
def chart_series(spark, sf):
    return reads.chart_series(_comparisons(spark, sf), "revenue").select(
        "company_id", "metric_name", "comparison_type", "current_period", "current_value")


@query("headline_margin", S.with_tables("""
SELECT r.report_id, coalesce(m.value, a.value) AS value, CASE WHEN m.report_id IS NOT NULL THEN 'metric' WHEN a.report_id IS NOT NULL THEN 'analytic' END AS source_kind
FROM reports_t r LEFT JOIN (SELECT * FROM metrics_t WHERE normalized_metric_name = 'GROSS_MARGIN') m ON r.report_id = m.report_id
LEFT JOIN (SELECT * FROM ratios_t WHERE signal_code = 'GROSS_MARGIN' AND abs(value) <= 20) a ON r.report_id = a.report_id"""))
def headline_margin(spark, sf):
    m = derive.metrics(spark, sf)
    a = analytics.ratio_rows(analytics.valid_ratios(analytics.ratios(m)))
    return reads.headline(derive.reports(spark, sf), m, a, "GROSS_MARGIN").select("report_id", "value", "source_kind")


@query("display_amounts")
def display_amounts(spark, sf):
    m = derive.metrics(spark, sf)
    return m.select("metric_id", reads.display_amount(F.col("value"), F.col("unit"), F.col("currency")).alias("shown"))


@query("metric_list_page", S.with_tables("""
SELECT metric_id, report_id, value, count(*) OVER () AS total FROM metrics_t WHERE metric_category = 'PROFITABILITY'
ORDER BY report_id, metric_id LIMIT 50 OFFSET 100"""))
def metric_list_page(spark, sf):
    m = reads.select_where(derive.metrics(spark, sf), metric_category="PROFITABILITY")
    return reads.page(m.select("metric_id", "report_id", "value"), [F.col("report_id"), F.col("metric_id")], limit=50, offset=100)


@query("metric_problems", S.with_tables("""
SELECT metric_id, array_to_string(list_filter([
    CASE WHEN unit = 'PERCENT' AND abs(value) > 10000 THEN 'percent_out_of_range' END,
    CASE WHEN unit <> 'PERCENT' AND abs(value) >= 1000000000000000 THEN 'value_out_of_range' END], lambda x: x IS NOT NULL), ',') AS fatal,
  array_to_string(list_filter([
    CASE WHEN unit = 'PERCENT' AND abs(value) > 200 AND abs(value) <= 10000 THEN 'percent_unusual' END,
    CASE WHEN unit <> 'PERCENT' AND value < 0 AND normalized_metric_name IN ('REVENUE', 'TOTAL_DEBT', 'CAPEX', 'REVENUE_GUIDANCE') THEN 'unexpected_negative' END,
    'empty_source_text'], lambda x: x IS NOT NULL), ',') AS warnings
FROM metrics_t"""))
def metric_problems(spark, sf):
    from ledgerlens.operators import quality

    m = derive.metrics(spark, sf).withColumn("source_text", F.lit(None).cast("string"))
    out = quality.check(m, quality.METRIC_RULES, keep=["metric_id"])
    return out.withColumn("fatal", F.array_join("fatal", ",")).withColumn("warnings", F.array_join("warnings", ","))


@query("comparison_problems", S.with_tables("""
SELECT comparison_type, metric_name, count(*) AS rows_seen, 0 AS dropped, count(*) FILTER (list_contains(flags, 'negative_base')) AS negative_base,
       count(*) FILTER (list_contains(flags, 'division_by_zero')) AS division_by_zero FROM comparisons_t GROUP BY 1, 2"""))
def comparison_problems(spark, sf):
    from ledgerlens.operators import quality

    out = quality.check_comparisons(_comparisons(spark, sf))
    return out.groupBy("comparison_type", "metric_name").agg(
        F.count(F.lit(1)).alias("rows_seen"), F.count_if(F.size("fatal") > 0).cast("int").alias("dropped"),
        F.count_if(F.array_contains("warnings", "negative_base")).alias("negative_base"),
        F.count_if(F.array_contains("warnings", "division_by_zero")).alias("division_by_zero"))


@query("report_progress", S.with_tables(f"""
SELECT report_id, status, completed_stage, CAST(coalesce(CASE WHEN status = 'FAILED' THEN s.p ELSE t.p END, 0) AS INTEGER) AS progress
FROM reports_t LEFT JOIN {S.rows(vocab.PROGRESS.items(), "k, p").replace("AS v", "AS s")} ON s.k = completed_stage
LEFT JOIN {S.rows(vocab.PROGRESS.items(), "k, p").replace("AS v", "AS t")} ON t.k = status"""))
def report_progress(spark, sf):
    r = derive.reports(spark, sf)
    return r.select("report_id", "status", "completed_stage", reads.progress(F.col("status"), F.col("completed_stage")).alias("progress"))


@query("status_funnel", S.with_tables(f"""
SELECT report_type, count(*) AS total, count(*) FILTER (status IN {S.in_list(vocab.DONE_STATUSES)}) AS processed,
       count(*) FILTER (status = 'FAILED') AS failed FROM reports_t GROUP BY 1"""))
def status_funnel(spark, sf):
    return summaries.status_funnel(derive.reports(spark, sf), "report_type")


@query("stage_work_list", S.with_tables(f"""
SELECT report_id, completed_stage FROM reports_t
WHERE completed_stage IS NULL OR completed_stage IN ('PROCESSED', 'SECTIONED', 'CHUNKED', 'EMBEDDED')"""))
def stage_work_list(spark, sf):
    from ledgerlens.sources import sinks

    return sinks.gate_stage(derive.reports(spark, sf), "METRICS_READY").select("report_id", "completed_stage")


@query("companies_with_reports", S.with_tables("SELECT DISTINCT company_id FROM reports_t"))
def companies_with_reports(spark, sf):
    return derive.reports(spark, sf).select("company_id").distinct()


@query("company_labels", S.with_tables("SELECT company_id, coalesce(ticker, name) AS company FROM companies_t"))
def company_labels(spark, sf):
    from ledgerlens.operators import chunks

    return chunks.company_label(derive.companies(spark, sf))


@query("rule_violations", S.with_tables("""
SELECT 'metrics' AS table_name, 'confidence_range' AS rule, count(*) FILTER (confidence_score NOT BETWEEN 0 AND 1) AS violations FROM metrics_t
UNION ALL SELECT 'metrics', 'unit_known', count(*) FILTER (unit NOT IN ('ABSOLUTE', 'THOUSAND', 'MILLION', 'BILLION', 'TRILLION', 'PERCENT')) FROM metrics_t
UNION ALL SELECT 'metrics', 'quarter_range', count(*) FILTER (fiscal_quarter NOT BETWEEN 1 AND 4) FROM metrics_t
UNION ALL SELECT 'reports', 'year_range', count(*) FILTER (year NOT BETWEEN 1900 AND 2200) FROM reports_t
UNION ALL SELECT 'reports', 'has_pages', count(*) FILTER (total_pages < 1) FROM reports_t
UNION ALL SELECT 'reports', 'annual_has_no_quarter', count(*) FILTER (report_type = '10-K' AND quarter IS NOT NULL) FROM reports_t"""))
def rule_violations(spark, sf):
    from ledgerlens.operators import quality

    c = F.col
    m = quality.violations(derive.metrics(spark, sf), "metrics", {
        "confidence_range": c("confidence_score").between(0, 1), "unit_known": c("unit").isin(vocab.KNOWN_UNITS),
        "quarter_range": c("fiscal_quarter").between(1, 4)})
    r = quality.violations(derive.reports(spark, sf), "reports", {
        "year_range": c("year").between(1900, 2200), "has_pages": c("total_pages") >= 1,
        "annual_has_no_quarter": ~((c("report_type") == "10-K") & c("quarter").isNotNull())})
    return m.unionByName(r)
