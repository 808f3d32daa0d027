"""Metric extraction from chunk text and reconciliation with external candidates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions import money, text
from ledgerlens.functions.grouped import first_per
from ledgerlens.operators import dictionaries
from ledgerlens.operators.risks import risk_confidence
from ledgerlens.operators.tone import tone_confidence

_HITS = (
    "array<struct<metric:string,surface:string,pos:int,number:string,raw:string,percent:boolean,"
    "negative:boolean,currency:string,scale:string,snippet:string,marked:boolean>>"
)
_VALUE = re.compile(money.VALUE_PATTERN, re.IGNORECASE)
_YEAR = re.compile(r"\(*\d{4}\)*")
_ALIASES = sorted(
    ((alias, name) for name, spec in vocab.METRICS.items() for alias in spec[2]),
    key=lambda an: -len(an[0]),
)


def alias_spans(body: str) -> list[tuple[int, int, str]]:
    """Whole-word alias spans; the longest aliases claim their characters first."""
    lowered = body.lower()
    claimed = bytearray(len(lowered) + 1)
    spans = []
    for alias, metric in _ALIASES:
        at = lowered.find(alias)
        while at >= 0:
            end = at + len(alias)
            inside = (lowered[at - 1:at] or " "), (lowered[end:end + 1] or " ")
            if not any(ch.isalnum() or ch == "_" for ch in inside):
                if not any(claimed[at:end]):
                    claimed[at:end] = b"\x01" * len(alias)
                    spans.append((at, end, metric))
                at = lowered.find(alias, end)
            else:
                at = lowered.find(alias, at + 1)
    return sorted(spans)


def _grade(m: re.Match) -> int:
    """0 = carries currency, scale or percent; 1 = plain number; 2 = looks like a year."""
    _, cur, sign, num, attached, word, pct, _ = m.groups()
    if cur or attached or word or pct:
        return 0
    raw = m.group().strip()
    return 2 if _YEAR.fullmatch(raw) and 1900 <= int(float(num)) <= 2100 else 1


def _hit(body: str, start: int, end: int, metric: str, wants_percent: bool, window: int) -> dict | None:
    best = min(
        (m for m in _VALUE.finditer(body[end:end + window]) if bool(m.group(7)) == wants_percent),
        key=_grade, default=None,
    )
    if best is None:
        return None
    opened, cur, sign, num, attached, word, pct, closed = best.groups()
    return {
        "metric": metric, "surface": body[start:end], "pos": start, "number": num.replace(",", ""),
        "raw": best.group().strip(), "percent": bool(pct),
        "negative": bool(sign) or bool(opened and closed), "currency": cur,
        "scale": (attached or word or "").lower() or None, "marked": _grade(best) == 0,
        "snippet": body[max(0, start - 25):end + best.end() + 5].strip(),
    }


def _hit_finder(window: int):
    @F.pandas_udf(_HITS)
    def find(body: pd.Series) -> pd.Series:
        return pd.Series([
            [h for s, e, m in alias_spans(b) if (h := _hit(b, s, e, m, vocab.METRICS[m][1] == "percent", window))] for b in body
        ])

    return find


def _dictionary_hits(chunks: DataFrame, taxonomy: DataFrame, window: int) -> DataFrame:
    """Chunks with ``_h``, a value bound to an alias of the table, and ``_t``, the entry of that alias."""
    @F.pandas_udf("array<struct<h:" + _HITS[len("array<"):-1] + ",at:int>>")
    def bind(body: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([
            [{"h": h, "at": i} for i, s in enumerate(row) if (h := _hit(b, s["start"], s["end"], s["metric"], bool(s["percent"]), window))]
            for b, row in zip(body, spans)])

    keyed = chunks.withColumn("_key", F.concat_ws("\x01", "report_id", "chunk_id"))
    claims = dictionaries.word_claims(keyed, "_key", "chunk_text", taxonomy)
    bare = F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "metric", "percent")]))
    return keyed.join(claims, "_key").withColumn("_b", F.explode(bind("chunk_text", bare))).withColumn(
        "_h", F.col("_b.h")).withColumn("_t", F.get("spans", F.col("_b.at")))


def metric_confidence(
    method: Column, section_match: Column, marked: Column, external: Column | None = None,
    disagreement: Column | None = None,
) -> Column:
    """0.95(+.02+.02) agreed; 0.80(+.05+.05) or 0.60 rule; 0.60+.15c or 0.70 (+.05) external."""
    add = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    ext = F.lit(0.70)
    if external is not None:
        bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), external))
        ext = F.when(external.isNotNull(), F.lit(0.60) + F.lit(0.15) * bounded).otherwise(ext)
    score = (
        F.when(method == "HYBRID_VALIDATED", F.lit(0.95) + add(section_match, 0.02) + add(marked, 0.02))
        .when(method == "RULE_BASED", F.when(~section_match & ~marked, F.lit(0.60)).otherwise(
            F.lit(0.80) + add(section_match, 0.05) + add(marked, 0.05)))
        .when(method == "LLM_BASED", ext + add(section_match, 0.05))
        .otherwise(F.lit(0.50))
    )
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)
    return score if disagreement is None else F.when(disagreement, F.lit(0.45)).otherwise(score)


def _expected(metric: Column, section: Column) -> Column:
    flat = {f"{m}|{s}": "y" for m, spec in vocab.METRICS.items() for s in spec[3]}
    return money.mapping(flat)[F.concat(metric, F.lit("|"), section)].isNotNull()


def metric_candidates(chunks: DataFrame, *, window: int = 90, taxonomy: DataFrame | None = None) -> DataFrame:
    """Rule candidates: every alias with the value bound to it.

    Chunks without any alias never leave the JVM; the rest go through Arrow once.  With a
    ``taxonomy``, a table like :func:`dictionaries.metric_terms` of any size, its aliases are
    found by joins instead; chunk_id must then be unique in its report.
    """
    h = F.col("_h")
    if taxonomy is None:
        found = chunks.filter(
            text.contains_any(F.lower("chunk_text"), [a for a, _ in _ALIASES])
        ).withColumn("_h", F.explode(_hit_finder(window)(F.col("chunk_text"))))
        category = money.mapping({m: s[0] for m, s in vocab.METRICS.items()})[h["metric"]]
        expected = _expected(h["metric"], F.coalesce("section", F.lit("")))
    else:
        found = _dictionary_hits(chunks, taxonomy, window)
        category = F.col("_t.category")
        expected = F.coalesce(F.array_contains("_t.sections", F.col("section")), F.lit(False))
    label = F.when(~h["percent"], money.mapping(vocab.TEXT_SCALES)[h["scale"]])
    number = (h["number"].try_cast("decimal(22,6)") * money.scale_factor(label)).cast("decimal(28,6)")
    rows = found.select(
        "company_id", "report_id", "chunk_id", "chunk_index", "fiscal_year", "fiscal_quarter",
        h["metric"].alias("normalized_metric_name"), h["surface"].alias("metric_name"),
        category.alias("metric_category"), h["pos"].alias("pos"),
        F.when(h["negative"], -number).otherwise(number).alias("value"),
        F.when(~h["percent"], money.currency_code(h["currency"])).alias("currency"),
        F.when(h["percent"], F.lit("PERCENT")).otherwise(F.coalesce(label, F.lit("ABSOLUTE"))).alias("unit"),
        h["snippet"].alias("source_text"), h["marked"].alias("marked"),
        expected.alias("section_match"),
    )
    bonus = F.when(F.col("marked"), F.lit(0.10)).otherwise(F.lit(0.0)) + F.when(
        F.col("section_match"), F.lit(0.05)).otherwise(F.lit(0.0))
    return rows.withColumn("raw_confidence", F.bround(F.lit(0.70) + bonus, 2))


KEY = ["company_id", "report_id", "normalized_metric_name", "fiscal_year", "fiscal_quarter"]


def best_candidates(candidates: DataFrame) -> DataFrame:
    """Best per (report, metric, period): confidence, then first in (chunk, position) order."""
    return first_per(candidates, KEY, [
        -F.col("raw_confidence"), F.col("chunk_index"), F.col("chunk_id"), F.col("pos")])


def _both(rule: DataFrame, external: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on null-safe keys, each side as a struct (``r`` and ``x``)."""
    marker = F.lit("\x00")
    hashed = F.concat_ws("\x01", *[F.coalesce(F.col(k).cast("string"), marker) for k in keys])
    r = rule.select(hashed.alias("_k"), F.struct(*rule.columns).alias("r"))
    x = external.select(hashed.alias("_k"), F.struct(*external.columns).alias("x"))
    return r.join(x, "_k", "full_outer").drop("_k")


def resolve_metrics(rule: DataFrame, external: DataFrame, tolerance: str = vocab.AGREEMENT_TOLERANCE) -> DataFrame:
    """Rule values win; an external value confirms, disputes or stands alone."""
    j = _both(best_candidates(rule), best_candidates(external), KEY)
    r, x = F.col("r"), F.col("x")
    size = F.greatest(F.abs(r["value"]), F.abs(x["value"]))
    agree = F.abs(r["value"] - x["value"]) <= size * F.lit(tolerance).cast("decimal(6,4)")
    method = (
        F.when(r.isNotNull() & x.isNotNull() & agree, F.lit("HYBRID_VALIDATED"))
        .when(r.isNotNull(), F.lit("RULE_BASED")).otherwise(F.lit("LLM_BASED"))
    )
    disputed = F.coalesce(r.isNotNull() & x.isNotNull() & ~agree, F.lit(False))
    pick = lambda c: F.when(r.isNotNull(), r[c]).otherwise(x[c])
    match = F.when(
        r.isNotNull() & x.isNotNull() & agree, r["section_match"] | x["section_match"]
    ).otherwise(pick("section_match"))
    return j.select(
        *[pick(c).alias(c) for c in KEY], pick("metric_name").alias("metric_name"),
        pick("metric_category").alias("metric_category"), pick("value").alias("value"),
        pick("currency").alias("currency"), pick("unit").alias("unit"),
        pick("chunk_id").alias("source_chunk_id"), pick("source_text").alias("source_text"),
        method.alias("extraction_method"), disputed.alias("discrepancy"),
        metric_confidence(
            method, match, pick("marked"), external=x["raw_confidence"], disagreement=disputed
        ).alias("confidence_score"),
    )


def extract_metrics(
    chunks: DataFrame, external: DataFrame | None = None, *, window: int = 90, taxonomy: DataFrame | None = None,
) -> DataFrame:
    """Metrics per (report, metric, period), scored."""
    rule = metric_candidates(chunks, window=window, taxonomy=taxonomy)
    if external is None:
        external = rule.limit(0)
    return resolve_metrics(rule, external).withColumn(
        "metric_id", F.concat_ws(
            "|", "report_id", "normalized_metric_name",
            money.period_label(F.col("fiscal_year"), F.col("fiscal_quarter")))
    )


def resolve_risks(rule: DataFrame, external: DataFrame) -> DataFrame:
    """Rule x external risks on the normalized name; agreement is category and severity."""
    j = _both(rule, external, ["report_id", "normalized_risk_name"])
    r, x = F.col("r"), F.col("x")
    both = r.isNotNull() & x.isNotNull()
    agree = both & (r["category"] == x["category"]) & (r["severity"] == x["severity"])
    method = (
        F.when(agree, F.lit("HYBRID_VALIDATED")).when(r.isNotNull(), F.lit("RULE_BASED"))
        .otherwise(F.lit("LLM_BASED"))
    )
    pick = lambda c: F.when(r.isNotNull(), r[c]).otherwise(x[c])
    match = F.when(agree, r["section_match"] | x["section_match"]).otherwise(pick("section_match"))
    disputed = F.coalesce(both & ~agree, F.lit(False))
    names = ["report_id", "normalized_risk_name", "risk_name", "risk_description", "category", "severity"]
    return j.select(
        *[pick(c).alias(c) for c in names], method.alias("extraction_method"),
        disputed.alias("discrepancy"),
        risk_confidence(method, match, external=x["raw_confidence"], disagreement=disputed).alias("confidence_score"),
    )


def resolve_tones(rule: DataFrame, external: DataFrame) -> DataFrame:
    """Rule x external tone per chunk; agreement averages the scores to three places."""
    j = _both(rule, external, ["report_id", "source_chunk_id"])
    r, x = F.col("r"), F.col("x")
    both = r.isNotNull() & x.isNotNull()
    agree = F.coalesce(both & (r["sentiment"] == x["sentiment"])
                       & (r["confidence_level"] == x["confidence_level"]), F.lit(False))
    method = (
        F.when(agree, F.lit("HYBRID_VALIDATED")).when(r.isNotNull(), F.lit("RULE_BASED"))
        .otherwise(F.lit("LLM_BASED"))
    )
    pick = lambda c: F.when(r.isNotNull(), r[c]).otherwise(x[c])
    score = lambda c: F.when(agree, F.bround((r[c] + x[c]) / 2.0, 3)).otherwise(pick(c))
    return j.select(
        *[pick(c).alias(c) for c in ("report_id", "source_chunk_id", "source_type", "sentiment", "confidence_level")],
        *[score(c).alias(c) for c in ("hedging_score", "positive_score", "negative_score")],
        method.alias("extraction_method"), (both & ~agree).alias("discrepancy"),
        tone_confidence(method, external=x["confidence_score"], disagreement=both & ~agree).alias("confidence_score"),
    )
