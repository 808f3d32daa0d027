"""Validation as data: reasons per row, rule violation counts, phrase flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions import text
from ledgerlens.functions.grouped import first_per

c = F.col
Rules = dict[str, Callable[[], Column]]


def _reason(name: str | Column, when: Column) -> Column:
    return F.when(when, F.lit(name) if isinstance(name, str) else name)


def check(df: DataFrame, rules: dict[str, Callable[[], list[Column]]], keep: list[str]) -> DataFrame:
    """``fatal`` and ``warnings`` arrays of the reasons that apply to each row."""
    return df.select(*keep, *[F.array_compact(F.array(*make())).alias(kind) for kind, make in rules.items()])


def _labelled(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.coalesce(c(column).cast("string"), F.lit("None")))


METRIC_RULES = {
    "fatal": lambda: [
        _reason("non_numeric_value", c("value").isNull()),
        _reason("missing_metric_name", text.is_blank(c("normalized_metric_name"))),
        _reason(_labelled("unknown_category", "metric_category"), ~F.coalesce(c("metric_category").isin(vocab.METRIC_CATEGORIES), F.lit(False))),
        _reason(_labelled("unknown_unit", "unit"), ~F.coalesce(c("unit").isin(vocab.KNOWN_UNITS), F.lit(False))),
        _reason(_labelled("unknown_currency", "currency"), ~c("currency").isin(vocab.KNOWN_CURRENCIES)),
        _reason(_labelled("bad_fiscal_year", "fiscal_year"), ~c("fiscal_year").between(1900, 2200)),
        _reason(_labelled("bad_fiscal_quarter", "fiscal_quarter"), ~c("fiscal_quarter").between(1, 4)),
        _reason("percent_out_of_range", (c("unit") == "PERCENT") & (F.abs("value") > 10_000)),
        _reason("value_out_of_range", (c("unit") != "PERCENT") & (F.abs("value") >= 10 ** 15)),
    ],
    "warnings": lambda: [
        _reason("percent_unusual", (c("unit") == "PERCENT") & (F.abs("value") > 200) & (F.abs("value") <= 10_000)),
        _reason("unexpected_negative", (c("unit") != "PERCENT") & (c("value") < 0)
                & c("normalized_metric_name").isin(vocab.NON_NEGATIVE_METRICS)),
        _reason("empty_source_text", text.is_blank(c("source_text"))),
    ],
}
RISK_RULES = {
    "fatal": lambda: [
        _reason("missing_risk_name", text.is_blank(c("risk_name"))),
        _reason("missing_normalized_risk_name", text.is_blank(c("normalized_risk_name"))),
        _reason("missing_risk_description", text.is_blank(c("risk_description"))),
        _reason(_labelled("unknown_category", "category"), ~F.coalesce(c("category").isin(vocab.RISK_CATEGORIES), F.lit(False))),
        _reason(_labelled("unknown_severity", "severity"), ~F.coalesce(c("severity").isin(vocab.RISK_SEVERITIES), F.lit(False))),
        _reason("non_numeric_confidence", c("confidence_score").isNull()),
    ],
    "warnings": lambda: [
        _reason("confidence_out_of_range", ~c("confidence_score").between(0, 1)),
        _reason("empty_source_text", text.is_blank(c("source_text"))),
        _reason("very_short_description", F.length(text.strip(F.coalesce("risk_description", F.lit("")))) < 10),
    ],
}
TONE_RULES = {
    "fatal": lambda: [
        *[_reason(f"{s}_out_of_range", ~F.coalesce(c(s).between(0, 1), F.lit(False)))
          for s in ("hedging_score", "positive_score", "negative_score", "confidence_score")],
        _reason("empty_source_text", text.is_blank(c("source_text"))),
        _reason("empty_source_type", text.is_blank(c("source_type"))),
    ],
    "warnings": lambda: [
        _reason("positive_equals_negative", (c("positive_score") > 0) & (c("positive_score") == c("negative_score"))),
    ],
}
RISK_EVOLUTION_RULES = {
    "fatal": lambda: [
        _reason("missing_company_id", text.is_blank(c("company_id"))),
        _reason(_labelled("invalid_evolution_type", "evolution_type"), ~F.coalesce(c("evolution_type").isin(vocab.RISK_EVOLUTION_TYPES), F.lit(False))),
        _reason("missing_both_risk_ids", c("current_risk_id").isNull() & c("previous_risk_id").isNull()),
        _reason("new_risk_missing_current_id", (c("evolution_type") == "NEW_RISK") & c("current_risk_id").isNull()),
        _reason("removed_risk_missing_previous_id", (c("evolution_type") == "REMOVED_RISK") & c("previous_risk_id").isNull()),
        _reason("missing_explanation", text.is_blank(c("explanation"))),
    ],
}
TONE_EVOLUTION_RULES = {
    "fatal": lambda: [
        _reason("confidence_out_of_range", ~F.coalesce(c("confidence_score").between(0, 1), F.lit(False))),
        _reason("missing_both_tone_ids", c("current_tone_id").isNull() & c("previous_tone_id").isNull()),
        _reason("missing_explanation", text.is_blank(c("explanation"))),
    ],
}


def check_comparisons(comparisons: DataFrame) -> DataFrame:
    """Corrupt sources and repeated (metric, type) pairs are fatal; flags are warnings.

    The surviving row of a repeated pair is found by an aggregate and joined back.
    """
    keys = ["metric_id", "comparison_type"]
    order = F.struct("previous_period", "current_value", "previous_value")
    kept = comparisons.groupBy(*keys).agg(F.min(order).alias("_keep"), F.count(F.lit(1)).alias("_n"))
    return comparisons.join(kept, keys).select(
        *comparisons.columns,
        F.array_compact(F.array(
            _reason("corrupt_source:current_value", c("current_value").isNull()),
            _reason("corrupt_source:previous_value", c("previous_value").isNull()),
            _reason("duplicate_comparison", (c("_n") > 1) & (order != c("_keep"))),
        )).alias("fatal"),
        F.filter("flags", lambda f: f.isin("division_by_zero", "negative_base")).alias("warnings"),
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("fatal") == 0)


def violations(df: DataFrame, name: str, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule; NULL satisfies a rule, as in a table constraint.  One pass."""
    counts = df.agg(*[F.count_if(~rule).alias(r) for r, rule in rules.items()])
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in rules])
    return counts.select(F.lit(name).alias("table_name"), F.explode(cells).alias("_c")).select("table_name", "_c.*")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that should be unique and are not, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def phrase_flags(body: Column, patterns: list[str]) -> Column:
    """The patterns found in a text, in list order.  One scan rejects clean texts."""
    each = F.array_compact(F.array(*[
        F.when(text.matches_any(body, [p]), F.lit(p)) for p in patterns]))
    return F.when(text.matches_any(body, patterns), each).otherwise(F.array().cast("array<string>"))


def dedupe_signals(signals: DataFrame) -> DataFrame:
    return first_per(signals, ["report_id", "signal_code", "metric_name"], [F.array_join("supporting_metric_ids", "|")])
