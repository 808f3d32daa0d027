"""The derived tables as SQL, for the side-by-side check of registered queries.

``with_tables(body)`` puts in front of a statement the definitions it refers to.
"""

from __future__ import annotations

import re

from ledgerlens import vocab
from ledgerlens.sources import derive


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def pick(values, by: str) -> str:
    return f"{items(values)}[CAST(({by}) % {len(values)} AS INTEGER) + 1]"


def rows(values, columns: str) -> str:
    """An inline table; each value is a tuple of strings, numbers or booleans."""
    def cell(v):
        return text(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    body = ", ".join("(" + ", ".join(cell(c) for c in row) + ")" for row in values)
    return f"(VALUES {body}) AS v({columns})"


WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}]"
EDGE = r"[^\p{L}\p{N}_]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def any_word(patterns) -> str:
    """Alternation in which a word boundary stands for a non-word character or an end.

    Only valid for testing whether a text contains a match.
    """
    return "(?i)" + "|".join(
        "(?:" + p.replace(r"\b", f"(?:^|$|{EDGE})") + ")" for p in patterns)


def sentences(c: str, gap: str = WS) -> str:
    """Split after . ! ? and a gap; the engine has no look-behind, so a mark is put in."""
    marked = f"regexp_replace({c}, '([.!?]){gap}+', '\\1' || chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: length(s) > 0)")


def phrase_total(c: str, phrases) -> str:
    return "(" + " + ".join(
        f"((length({c}) - length(replace({c}, {text(p)}, ''))) // {len(p)})" for p in phrases) + ")"


TABLES: dict[str, str] = {}

TABLES["companies_t"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS company_id, s_name AS name,
       CASE WHEN s_suppkey % 7 <> 0 THEN 'S' || s_suppkey END AS ticker, n_name AS sector
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

TABLES["cohorts_t"] = """
SELECT 'nation-' || s_nationkey AS cohort_id, CAST(s_suppkey AS VARCHAR) AS company_id FROM supplier"""

TABLES["quarter_sums"] = """
SELECT CAST(l_suppkey AS VARCHAR) AS company_id, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
       CAST(quarter(o_orderdate) AS INTEGER) AS fiscal_quarter,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(20,4)) AS rev,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(20,4)) AS tax,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(20,4)) AS disc,
       CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS BIGINT) AS qty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"""

TABLES["period_sums"] = """
SELECT * FROM quarter_sums
UNION ALL
SELECT company_id, fiscal_year, CAST(NULL AS INTEGER), CAST(sum(rev) AS DECIMAL(20,4)),
       CAST(sum(tax) AS DECIMAL(20,4)), CAST(sum(disc) AS DECIMAL(20,4)), CAST(sum(qty) AS BIGINT)
FROM quarter_sums GROUP BY 1, 2"""

_RID = "concat_ws('-', company_id, fiscal_year, coalesce('Q' || fiscal_quarter, 'FY'))"


def _d(v: str) -> str:
    return f"CAST({v} AS DECIMAL(4,2))"


_METRICS = [
    ("REVENUE", "REVENUE", "rev", "true"),
    ("GROSS_PROFIT", "PROFITABILITY", f"rev * {_d('0.60')} - tax", "qty % 5 <> 0"),
    ("GROSS_MARGIN", "MARGINS", "qty % 30 + 5", "qty % 5 = 0"),
    ("OPERATING_INCOME", "PROFITABILITY", f"rev * {_d('0.30')} - disc", "qty % 7 <> 0"),
    ("OPERATING_MARGIN", "MARGINS", "qty % 25 + 1", "qty % 3 = 0"),
    ("EBITDA", "PROFITABILITY", f"rev * {_d('0.35')} - disc", "true"),
    ("NET_INCOME", "PROFITABILITY", f"rev * {_d('0.05')} - tax * {_d('1.20')}", "true"),
    ("TOTAL_DEBT", "DEBT", "tax * 10", "true"),
    ("OPERATING_CASH_FLOW", "CASH_FLOW", f"rev * {_d('0.25')} - disc * 2", "true"),
    ("FREE_CASH_FLOW", "CASH_FLOW", f"rev * {_d('0.10')} - disc * 2", "true"),
    ("CAPEX", "CAPEX", "disc", "qty % 11 <> 0"),
    ("REVENUE_GUIDANCE", "GUIDANCE", f"rev * {_d('1.05')} - disc", "qty % 2 = 0"),
    ("MARGIN_GUIDANCE", "GUIDANCE", "qty % 40 + 5", "qty % 4 = 0"),
    ("DIVIDENDS", "OTHER", f"tax * {_d('0.10')}", "qty % 6 = 0"),
]
_PERCENT = "('GROSS_MARGIN', 'OPERATING_MARGIN', 'MARGIN_GUIDANCE')"
TABLES["metrics_t"] = f"""
SELECT report_id || '|' || name AS metric_id, report_id, company_id,
       array_to_string(list_transform(string_split(lower(name), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS metric_name,
       name AS normalized_metric_name, cat AS metric_category, value,
       CASE WHEN name NOT IN {_PERCENT} THEN 'USD' END AS currency,
       CASE WHEN name IN {_PERCENT} THEN 'PERCENT' ELSE 'ABSOLUTE' END AS unit,
       fiscal_year, fiscal_quarter,
       CASE WHEN qty % 4 = 0 THEN 'HYBRID_VALIDATED' ELSE 'RULE_BASED' END AS extraction_method,
       CAST(CAST(60 + (qty + length(name)) % 40 AS DECIMAL(7,3)) / 100 AS DECIMAL(4,3)) AS confidence_score
FROM (
{" UNION ALL ".join(
    f"SELECT {_RID} AS report_id, company_id, fiscal_year, fiscal_quarter, qty, {text(n)} AS name, {text(c)} AS cat, "
    f"CAST({v} AS DECIMAL(22,6)) AS value FROM period_sums WHERE {w}" for n, c, v, w in _METRICS)}
)"""

TABLES["candidate_metrics_t"] = """
SELECT * REPLACE (
         metric_id || '#' || v AS metric_id,
         CAST(CASE WHEN v = 'b' THEN value + 1 ELSE value END AS DECIMAL(22,6)) AS value,
         CAST(CASE WHEN v = 'b' AND length(normalized_metric_name) % 2 = 0 THEN confidence_score + CAST(0.01 AS DECIMAL(4,3))
                   ELSE confidence_score END AS DECIMAL(4,3)) AS confidence_score)
FROM (SELECT *, unnest(CASE WHEN (length(metric_id) + fiscal_year) % 3 = 0 THEN ['a', 'b'] ELSE ['a'] END) AS v FROM metrics_t)"""

TABLES["reports_t"] = f"""
SELECT {_RID} AS report_id, company_id,
       CASE WHEN fiscal_quarter IS NULL THEN '10-K' ELSE '10-Q' END AS report_type,
       fiscal_year AS year, fiscal_quarter AS quarter, CAST(qty % 120 AS INTEGER) AS total_pages,
       {pick(["UPLOADED", "CHUNKED", "EMBEDDED", "FAILED", "METRICS_READY", "RISKS", "READY"], "qty")} AS status,
       [NULL, {", ".join(text(s) for s in vocab.STAGES)}][CAST(qty % {len(vocab.STAGES) + 1} AS INTEGER) + 1] AS completed_stage,
       946684800 + qty * 3600 AS uploaded_s
FROM period_sums"""

TABLES["points_t"] = """
SELECT * FROM candidate_metrics_t
QUALIFY row_number() OVER (PARTITION BY company_id, normalized_metric_name, fiscal_year, fiscal_quarter
                           ORDER BY confidence_score DESC, metric_id) = 1"""

_LABEL = "CASE WHEN {y} IS NULL THEN 'UNKNOWN' WHEN {q} IS NULL THEN 'FY' || {y} ELSE 'Q' || {q} || ' ' || {y} END"


def label(y: str, q: str) -> str:
    return _LABEL.format(y=y, q=q)


_WANTED = """
SELECT c.*, 'YOY' AS comparison_type, fiscal_year - 1 AS py, fiscal_quarter AS pq FROM {src} c
UNION ALL
SELECT c.*, 'QOQ', CASE WHEN fiscal_quarter = 1 THEN fiscal_year - 1 ELSE fiscal_year END,
       CASE WHEN fiscal_quarter = 1 THEN 4 ELSE fiscal_quarter - 1 END
FROM {src} c WHERE fiscal_quarter IS NOT NULL"""
_COMPARE = f"""
SELECT w.metric_id, w.company_id, w.report_id, w.normalized_metric_name AS metric_name, w.comparison_type,
       {label("w.fiscal_year", "w.fiscal_quarter")} AS current_period, {label("w.py", "w.pq")} AS previous_period,
       w.value AS current_value, p.value AS previous_value,
       CAST(w.value - p.value AS DECIMAL(22,6)) AS absolute_change,
       CAST(CASE WHEN p.value <> 0 THEN round_even(CAST(w.value - p.value AS DOUBLE) * 100 / CAST(p.value AS DOUBLE), 2) END AS DECIMAL(18,2)) AS percentage_change,
       CASE WHEN p.value = 0 THEN ['division_by_zero'] WHEN p.value < 0 THEN ['negative_base'] ELSE [] END AS flags
FROM {{wanted}} w JOIN {{src}} p
  ON p.company_id = w.company_id AND p.normalized_metric_name = w.normalized_metric_name
 AND p.fiscal_year = w.py AND p.fiscal_quarter IS NOT DISTINCT FROM w.pq"""
TABLES["wanted_points"] = _WANTED.format(src="points_t")
TABLES["point_comparisons"] = _COMPARE.format(wanted="wanted_points", src="points_t")
TABLES["wanted_metrics"] = _WANTED.format(src="metrics_t")
TABLES["comparisons_t"] = _COMPARE.format(wanted="wanted_metrics", src="metrics_t")

# --- filings -----------------------------------------------------------------------------------
TABLES["filing_reports_t"] = """
SELECT CAST(doc_id AS VARCHAR) AS report_id, CAST(doc_id // 16 AS VARCHAR) AS company_id,
       CASE doc_id % 4 WHEN 3 THEN '10-K' WHEN 2 THEN 'TRANSCRIPT' ELSE '10-Q' END AS report_type,
       CAST(2018 + (doc_id % 16) // 4 AS INTEGER) AS year,
       CAST(CASE WHEN doc_id % 4 <> 3 THEN doc_id % 4 + 1 END AS INTEGER) AS quarter, source
FROM documents"""

TABLES["chunks_t"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS report_id, CAST(doc_id AS VARCHAR) AS chunk_id, 0 AS chunk_index,
       {pick(vocab.SECTIONS, "doc_id // 3")} AS section, source,
       concat_ws(' ', text, {pick(derive.RISK_SENTENCES, "doc_id")},
                 {pick(derive.RISK_THEMES, "doc_id // 4")} || {pick(derive.RISK_TAILS, "doc_id // 3")}, {pick(derive.TONE_SENTENCES, "doc_id")},
                 {pick(derive.METRIC_SENTENCES, "doc_id")}) AS chunk_text, doc_id,
       CAST(doc_id // 16 AS VARCHAR) AS company_id,
       CAST(2018 + (doc_id % 16) // 4 AS INTEGER) AS fiscal_year,
       CAST(CASE WHEN doc_id % 4 <> 3 THEN doc_id % 4 + 1 END AS INTEGER) AS fiscal_quarter
FROM documents"""

TABLES["vectors_t"] = f"""
SELECT vec_id, embedding, {pick(vocab.SECTIONS, "label")} AS section, label,
       'r' || (vec_id // 20) AS report_id, CAST(2020 + (vec_id // 20) % 5 AS INTEGER) AS year
FROM embeddings"""


def matched_risks(prefix: str, risks: str, steps: str) -> None:
    """Defines {prefix}_matches: every current and previous risk of a report once, paired or alone.

    Equal names pair first.  The others choose in order of their ids, one step of the
    recursion each, from the previous risks of their category that are still free and whose
    names share enough words, the best first.
    """
    words = f"list_filter(list_distinct(regexp_extract_all(lower(risk_name), '[\\p{{L}}\\p{{N}}_]+')), lambda w: w NOT IN {in_list(vocab.RISK_STOP_WORDS)})"
    TABLES[f"{prefix}_now"] = f"SELECT r.*, {words} AS words FROM {risks} r JOIN {steps} s ON r.report_id = s.report_id WHERE s.prior_report_id IS NOT NULL"
    TABLES[f"{prefix}_then"] = f"SELECT r.* REPLACE (s.report_id AS report_id), {words} AS words FROM {risks} r JOIN {steps} s ON r.report_id = s.prior_report_id"
    TABLES[f"{prefix}_equal"] = f"""
SELECT c.report_id, c.risk_id AS current_risk_id, p.risk_id AS previous_risk_id FROM {prefix}_now c JOIN {prefix}_then p
  ON c.report_id = p.report_id AND c.normalized_risk_name = p.normalized_risk_name"""
    TABLES[f"{prefix}_wishes"] = f"""
SELECT report_id, category, risk_id, row_number() OVER (PARTITION BY report_id, category ORDER BY risk_id) AS k, wishes FROM (
  SELECT c.report_id, c.category, c.risk_id, list({{'id': p.risk_id, 'score': score}} ORDER BY score DESC, p.risk_id) AS wishes
  FROM {prefix}_now c JOIN {prefix}_then p ON c.report_id = p.report_id AND c.category = p.category,
    LATERAL (SELECT len(list_intersect(c.words, p.words))::DOUBLE / (len(c.words) + len(p.words) - len(list_intersect(c.words, p.words))) AS score)
  WHERE len(c.words) > 0 AND len(p.words) > 0 AND score >= {vocab.RISK_FUZZY_THRESHOLD}::DOUBLE
    AND (c.report_id, c.risk_id) NOT IN (SELECT (report_id, current_risk_id) FROM {prefix}_equal)
    AND (p.report_id, p.risk_id) NOT IN (SELECT (report_id, previous_risk_id) FROM {prefix}_equal)
  GROUP BY 1, 2, 3)"""
    free = "list_filter(w.wishes, lambda x: NOT list_contains(s.used, x.id))"
    TABLES[f"{prefix}_chosen"] = f"""
SELECT report_id, category, 0::BIGINT AS k, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS current_risk_id, CAST(NULL AS VARCHAR) AS previous_risk_id, CAST(NULL AS DOUBLE) AS score
FROM {prefix}_wishes GROUP BY 1, 2
UNION ALL
SELECT w.report_id, w.category, w.k, CASE WHEN len({free}) > 0 THEN list_append(s.used, {free}[1].id) ELSE s.used END, w.risk_id, {free}[1].id, {free}[1].score
FROM {prefix}_chosen s JOIN {prefix}_wishes w ON w.report_id = s.report_id AND w.category = s.category AND w.k = s.k + 1"""
    TABLES[f"{prefix}_paired"] = f"""
SELECT report_id, current_risk_id, previous_risk_id, 'EXACT' AS match_type, 1.0::DOUBLE AS match_score FROM {prefix}_equal
UNION ALL SELECT report_id, current_risk_id, previous_risk_id, 'FUZZY', round_even(score, 3) FROM {prefix}_chosen WHERE previous_risk_id IS NOT NULL"""
    TABLES[f"{prefix}_matches"] = f"""
SELECT * FROM {prefix}_paired
UNION ALL SELECT report_id, risk_id, NULL, 'NONE', 0.0::DOUBLE FROM {prefix}_now WHERE (report_id, risk_id) NOT IN (SELECT (report_id, current_risk_id) FROM {prefix}_paired)
UNION ALL SELECT report_id, NULL, risk_id, 'NONE', 0.0::DOUBLE FROM {prefix}_then WHERE (report_id, risk_id) NOT IN (SELECT (report_id, previous_risk_id) FROM {prefix}_paired)"""


def with_tables(body: str) -> str:
    """``body`` preceded by the definitions of every derived table it uses, in order."""
    def needs(sql: str) -> set[str]:
        return {t for t in TABLES if re.search(rf"\b{t}\b", sql)}

    wanted, todo = set(), needs(body)
    while todo:
        wanted |= todo
        todo = set().union(*[needs(TABLES[t]) for t in todo]) - wanted
    if not wanted:
        return body.strip()
    parts = [f"{t} AS ({TABLES[t].strip()}\n)" for t in TABLES if t in wanted]
    body = body.strip()
    start = "WITH RECURSIVE " if any(re.search(rf"\b{t}\b", TABLES[t]) for t in wanted) else "WITH "
    if body.upper().startswith("WITH "):
        return start + ",\n".join(parts) + ",\n" + body[5:]
    return start + ",\n".join(parts) + "\n" + body
