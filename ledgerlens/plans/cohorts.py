"""Registered queries over cohorts: profiles, ranks, scores, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.operators import analytics, benchmark, periods, risks, tone
from ledgerlens.plans import filings  # noqa: F401  (defines tables used below)
from ledgerlens.plans import sql as S
from ledgerlens.plans.registry import query
from ledgerlens.session import cut_lineage
from ledgerlens.sources import derive

# --- SQL for the profile -----------------------------------------------------------------
S.TABLES["latest_t"] = """
SELECT * FROM reports_t QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY year DESC, quarter DESC NULLS FIRST, uploaded_s DESC, report_id) = 1"""
S.TABLES["which_t"] = """
SELECT company_id, report_id, 'now' AS slot FROM latest_t
UNION ALL
SELECT c.company_id, p.report_id, 'prev' FROM latest_t c JOIN reports_t p ON c.company_id = p.company_id
 AND (p.year < c.year OR (p.year = c.year AND p.quarter < c.quarter))
QUALIFY row_number() OVER (PARTITION BY c.company_id ORDER BY p.year DESC, p.quarter DESC NULLS FIRST, p.uploaded_s DESC, p.report_id) = 1"""


def _first(words, slot):
    hit = f"(normalized_metric_name IN {S.in_list(words)} OR upper(metric_name) IN {S.in_list(words)})"
    return f"min_by(CAST(value AS DOUBLE), metric_id) FILTER ({hit} AND slot = '{slot}')"


S.TABLES["picks_t"] = "SELECT w.company_id, " + ", ".join(
    [f"{_first(ws, s)} AS {k}_{s}" for k, ws in vocab.PROFILE_ALIASES.items() for s in ("now", "prev")]
    + [f"{_first([w + '_GROWTH' for w in ws], 'now')} AS {k}_grown" for k, ws in vocab.PROFILE_ALIASES.items()]
) + " FROM metrics_t m JOIN which_t w ON m.report_id = w.report_id GROUP BY 1"
S.TABLES["yoy_t"] = "SELECT company_id, " + ", ".join(
    f"min_by(CAST(percentage_change AS DOUBLE), metric_id) FILTER (metric_name IN {S.in_list(vocab.PROFILE_ALIASES[k])}) AS {k}_yoy"
    for k in sorted(set(benchmark.GROWTHS.values()))
) + """ FROM comparisons_t WHERE comparison_type = 'YOY' AND percentage_change IS NOT NULL
 AND report_id IN (SELECT report_id FROM latest_t) GROUP BY 1"""

# the same text jobs as for filings, over chunks attached to supplier companies
S.TABLES["newest_t"] = """
SELECT company_id, report_id, row_number() OVER (PARTITION BY company_id ORDER BY year DESC, quarter DESC NULLS FIRST) AS n FROM reports_t"""
S.TABLES["holders_t"] = """
SELECT company_id, row_number() OVER (ORDER BY CAST(company_id AS BIGINT)) AS c, count(*) OVER () AS holders, reports
FROM (SELECT company_id, count(*) AS reports FROM reports_t GROUP BY 1)"""
S.TABLES["held_reports"] = """
SELECT CAST(doc_id AS VARCHAR) AS chunk_id, r.company_id, r.report_id FROM documents
JOIN holders_t h ON h.c = doc_id % (SELECT count(*) FROM holders_t) + 1
JOIN newest_t r ON r.company_id = h.company_id AND r.n = doc_id // h.holders % h.reports + 1"""
S.TABLES["held_tones"] = "SELECT t.* REPLACE (h.company_id AS company_id, h.report_id AS report_id) FROM tones_t t JOIN held_reports h ON t.report_id = h.chunk_id"
S.TABLES["held_risks"] = """
SELECT h.report_id || '|' || normalized_risk_name AS risk_id, h.company_id, h.report_id, c.normalized_risk_name, c.kw_title || ' Risk' AS risk_name, c.category, c.severity
FROM risk_candidates_t c JOIN held_reports h ON c.chunk_id = h.chunk_id
QUALIFY row_number() OVER (PARTITION BY h.report_id, normalized_risk_name ORDER BY CASE WHEN section_match THEN 0 ELSE 1 END, c.chunk_id, pos, place) = 1"""
S.TABLES["held_steps"] = "SELECT report_id, lag(report_id) OVER (PARTITION BY company_id ORDER BY year * 4 + coalesce(quarter, 4), report_id) AS prior_report_id FROM reports_t"
S.matched_risks("held", "held_risks", "held_steps")
S.TABLES["held_moves"] = f"""
SELECT c.risk_id, c.report_id, CASE WHEN m.previous_risk_id IS NULL THEN 'NEW_RISK' WHEN {filings._step("c.severity", "p.severity")} > 0 THEN 'ESCALATED_RISK' ELSE 'OTHER' END AS kind
FROM held_matches m JOIN held_risks c ON c.risk_id = m.current_risk_id LEFT JOIN held_risks p ON p.risk_id = m.previous_risk_id"""
_D = "CAST({c} AS DECIMAL(10,8))"
_NET = f"({_D.format(c='positive_score')} - {_D.format(c='negative_score')})"
S.TABLES["tone_dims"] = f"""
SELECT w.company_id, CAST(avg({_NET}) FILTER (slot = 'now') AS DOUBLE) AS s, CAST(avg({_D.format(c='confidence_score')}) FILTER (slot = 'now') AS DOUBLE) AS c,
       CAST(avg({_D.format(c='hedging_score')}) FILTER (slot = 'now') AS DOUBLE) AS h, stddev_pop(CAST({_NET} AS DOUBLE)) FILTER (slot = 'now') AS sd,
       CAST(avg({_D.format(c='confidence_score')}) FILTER (slot = 'prev') AS DOUBLE) AS b
FROM held_tones t JOIN which_t w ON t.report_id = w.report_id GROUP BY 1"""


def _grow(k):
    return f"coalesce({k}_yoy, {k}_grown, CASE WHEN {k}_prev <> 0 THEN ({k}_now - {k}_prev) / {k}_prev * 100.0::DOUBLE END)"


def _share(given, top):
    return f"coalesce({given}_now, CASE WHEN revenue_now <> 0 THEN {top}_now / revenue_now * 100.0::DOUBLE END)"


_PROFILE = {
    **{n: _grow(k) for n, k in benchmark.GROWTHS.items() if n != "DEBT_GROWTH"},
    "OPERATING_MARGIN": _share("operating_margin", "operating_income"), "NET_MARGIN": _share("net_margin", "net_income"),
    "DEBT_TO_REVENUE": _share("debt_to_revenue", "debt"), "CASH_FLOW_MARGIN": _share("cash_flow_margin", "ocf"),
    "CAPEX": "capex_now", "DEBT_REDUCTION": "-" + _grow("debt"),
    "CASH_DEPLOYMENT": "capex_now + abs(coalesce(dividends_now, 0)) + abs(coalesce(buybacks_now, 0))",
    "DIVIDEND_METRICS": "dividends_now", "BUYBACK_METRICS": "buybacks_now",
    "TOTAL_RISKS": "coalesce(k.total, 0)::DOUBLE", "HIGH_SEVERITY_RISKS": "coalesce(k.high, 0)::DOUBLE",
    "CRITICAL_RISKS": "coalesce(k.critical, 0)::DOUBLE", "NEW_RISKS": "coalesce(v.fresh, 0)::DOUBLE",
    "ESCALATED_RISKS": "coalesce(v.escalated, 0)::DOUBLE",
    "RISK_DENSITY": "coalesce(k.total, 0)::DOUBLE / coalesce(nullif(l.total_pages, 0), 1)",
    "SENTIMENT_SCORE": "d.s", "CONFIDENCE_SCORE": "d.c", "HEDGING_SCORE": "d.h",
    "TONE_STABILITY": "CASE WHEN d.s IS NOT NULL THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - d.sd) END", "CONFIDENCE_EVOLUTION": "d.c - d.b",
}
S.TABLES["profile_t"] = "SELECT l.company_id, " + ", ".join(
    f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in _PROFILE.items()) + """
FROM latest_t l LEFT JOIN picks_t USING (company_id) LEFT JOIN yoy_t USING (company_id) LEFT JOIN tone_dims d USING (company_id)
LEFT JOIN (SELECT report_id, count(*) AS total, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'CRITICAL') AS critical FROM held_risks GROUP BY 1) k ON k.report_id = l.report_id
LEFT JOIN (SELECT report_id, count(*) FILTER (kind = 'NEW_RISK') AS fresh, count(*) FILTER (kind = 'ESCALATED_RISK') AS escalated FROM held_moves GROUP BY 1) v ON v.report_id = l.report_id"""
S.TABLES["long_t"] = " UNION ALL ".join(
    f"SELECT company_id, '{d}' AS dimension, '{m}' AS metric_name, {m} AS value, {str(up).lower()} AS up FROM profile_t"
    for d, ms in vocab.METRIC_DIRECTIONS.items() for m, up in ms.items())
S.TABLES["scored_t"] = """
SELECT cohort_id, company_id, dimension, metric_name, value,
       CASE WHEN value IS NOT NULL THEN CAST(rank() OVER (PARTITION BY cohort_id, metric_name, value IS NULL ORDER BY o) AS DOUBLE) END AS rank,
       count(value) OVER w AS m, CASE WHEN value IS NULL THEN NULL WHEN max(value) OVER w - min(value) OVER w < 1e-9 THEN 100.0
            WHEN up THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 100.0::DOUBLE
            ELSE (max(value) OVER w - value) / (max(value) OVER w - min(value) OVER w) * 100.0::DOUBLE END AS score
FROM (SELECT c.cohort_id, l.*, CASE WHEN up THEN -value ELSE value END AS o FROM cohorts_t c JOIN long_t l USING (company_id)
      WHERE cohort_id IN (SELECT cohort_id FROM cohorts_t GROUP BY 1 HAVING count(*) >= 2))
WINDOW w AS (PARTITION BY cohort_id, metric_name)"""
S.TABLES["dims_t"] = "SELECT cohort_id, company_id, " + ", ".join(
    f"CAST(avg(CAST(round(score, 9) AS DECIMAL(14,9))) FILTER (dimension = '{d}') AS DOUBLE) AS {d.lower()}_score" for d in vocab.DIMENSIONS
) + " FROM scored_t GROUP BY 1, 2"
_W = vocab.DEFAULT_WEIGHTS
S.TABLES["summaries_t"] = f"""
SELECT *, CASE WHEN overall_score IS NOT NULL THEN CAST(rank() OVER (PARTITION BY cohort_id, overall_score IS NULL ORDER BY round(overall_score, 9) DESC) AS DOUBLE) END AS rank FROM (
SELECT *, CASE WHEN base >= 1e-9 THEN ({" + ".join(f"coalesce({k}_score * {v}::DOUBLE, 0)" for k, v in _W.items())}) / base END AS overall_score
FROM (SELECT *, {" + ".join(f"CASE WHEN {k}_score IS NOT NULL THEN {v}::DOUBLE ELSE 0 END" for k, v in _W.items())} AS base FROM dims_t))"""


# --- queries ------------------------------------------------------------------------------
def _profile(spark, sf):
    # each stage that several branches read is written once; metrics are made again from the sums, ten times smaller
    quarters = cut_lineage(derive.quarter_sums(spark, sf))
    reports = cut_lineage(derive.reports(spark, sf, quarters))
    metrics = derive.metrics(spark, sf, quarters)
    text = derive.company_chunks(spark, sf, reports)
    found = cut_lineage(risks.extract_risks(text))
    comparisons = periods.compare_periods(metrics, deduped=True, carry=("report_id",))
    moves = risks.risk_evolution(found, reports, unique_names=True)
    profile = benchmark.company_profile(reports, metrics, comparisons, found, moves, tone.score_tone(text))
    names = [m for ms in vocab.METRIC_DIRECTIONS.values() for m in ms]
    return profile.select("company_id", *[F.round(n, 6).alias(n) for n in names])


def _names():
    return ", ".join(m for ms in vocab.METRIC_DIRECTIONS.values() for m in ms)


@query("company_profile", S.with_tables(f"SELECT company_id, {_names()} FROM profile_t"))
def company_profile(spark, sf):
    return _profile(spark, sf)


@query("cohort_scores", S.with_tables("""
SELECT cohort_id, company_id, dimension, metric_name, value, rank, round(CASE WHEN rank IS NOT NULL THEN greatest(0, least(100, (m - rank + 0.5) / m * 100.0)) END, 6) AS percentile,
       round(score, 6) AS score FROM scored_t"""))
def cohort_scores(spark, sf):
    out = benchmark.score_cohorts(derive.cohorts(spark, sf), cut_lineage(_profile(spark, sf)))
    return out.select(
        "cohort_id", "company_id", "dimension", "metric_name", "value", "rank",
        F.round("percentile", 6).alias("percentile"), F.round("score", 6).alias("score"))


@query("cohort_benchmark", S.with_tables(
    "SELECT cohort_id, company_id, " + ", ".join(f"round({k}_score, 6) AS {k}_score" for k in _W)
    + ", round(overall_score, 6) AS overall_score, rank FROM summaries_t"))
def cohort_benchmark(spark, sf):
    scored = benchmark.score_cohorts(derive.cohorts(spark, sf), cut_lineage(_profile(spark, sf)))
    out = benchmark.summarize_cohorts(scored)
    return out.select(
        "cohort_id", "company_id", *[F.round(f"{k}_score", 6).alias(f"{k}_score") for k in _W],
        F.round("overall_score", 6).alias("overall_score"), "rank")


def _latest_values(spark, sf):
    """All companies with one metric of one period are a cohort.

    Ranks read the values twice, so the line items are joined and summed once for both.
    """
    period = F.concat_ws("-", "normalized_metric_name", "fiscal_year", F.coalesce(F.concat(F.lit("Q"), "fiscal_quarter"), F.lit("FY")))
    metrics = derive.metrics(spark, sf, cut_lineage(derive.quarter_sums(spark, sf)))
    return metrics.select(period.alias("cohort"), "company_id", F.floor(F.col("value") / 1000).cast("double").alias("value"))


_VALUES = "(SELECT normalized_metric_name || '-' || fiscal_year || '-' || coalesce('Q' || fiscal_quarter, 'FY') AS cohort, company_id, CAST(floor(value / 1000) AS DOUBLE) AS value FROM metrics_t)"
_RANKS = {
    "min": "CAST(rank() OVER w AS DOUBLE)", "dense": "CAST(dense_rank() OVER w AS DOUBLE)",
    "average": "rank() OVER w + (count(*) OVER (PARTITION BY cohort, value) - 1) / 2.0::DOUBLE",
}


def _rank_query(tie):
    @query(f"rank_ties_{tie}", S.with_tables(f"SELECT cohort, company_id, value, {_RANKS[tie]} AS rank FROM {_VALUES} WINDOW w AS (PARTITION BY cohort ORDER BY value DESC)"))
    def run(spark, sf):
        return benchmark.rank_items(_latest_values(spark, sf), ["cohort"], tie=tie).select("cohort", "company_id", "value", "rank")
    return run


for _tie in _RANKS:
    _rank_query(_tie)


@query("cohort_problems", S.with_tables("""
SELECT cohort_id, count(*) AS companies, CASE WHEN count(*) < 2 THEN 'too_few_companies' END AS reason FROM cohorts_t GROUP BY 1"""))
def cohort_problems(spark, sf):
    return benchmark.cohort_problems(derive.cohorts(spark, sf))


@query("cohort_podium", S.with_tables("""
SELECT cohort AS cohort_id, company_id, CAST(place AS INTEGER) AS place FROM (
 SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY r, company_id) AS place
 FROM (SELECT *, rank() OVER (PARTITION BY cohort ORDER BY value DESC) AS r FROM """ + _VALUES + """)) WHERE place <= 3"""))
def cohort_podium(spark, sf):
    ranked = benchmark.rank_items(_latest_values(spark, sf), ["cohort"]).withColumnRenamed("cohort", "cohort_id")
    return benchmark.podium(ranked).select("cohort_id", "company_id", "place")


@query("run_weights", """
WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CAST(o_orderkey % 3 * 20 AS DOUBLE) AS a, CAST(40 - o_orderkey % 3 * 20 AS DOUBLE) AS b, 35.0::DOUBLE AS c, CAST(o_orderkey % 2 * 25 AS DOUBLE) AS d FROM orders)
SELECT run_id, CASE WHEN abs(a + b + c + d - 100) <= 1e-5 THEN a / 100 END AS financial, CASE WHEN abs(a + b + c + d - 100) <= 1e-5 THEN b / 100 END AS risk,
       CASE WHEN abs(a + b + c + d - 100) <= 1e-5 THEN c / 100 END AS tone, CASE WHEN abs(a + b + c + d - 100) <= 1e-5 THEN d / 100 END AS capital_allocation,
       CASE WHEN abs(a + b + c + d - 100) > 1e-5 THEN 'weights_do_not_sum' END AS reason FROM r""")
def run_weights(spark, sf):
    k = F.col("o_orderkey")
    runs = derive.table(spark, sf, "orders").select(
        k.cast("string").alias("run_id"), (k % 3 * 20).cast("double").alias("financial"),
        (F.lit(40) - k % 3 * 20).cast("double").alias("risk"), F.lit(35.0).alias("tone"),
        (k % 2 * 25).cast("double").alias("capital_allocation"))
    return benchmark.weight_problems(runs)
