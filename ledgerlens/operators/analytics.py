"""Ratios and signals computed from metrics and comparisons, for all reports at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions import money, text
from ledgerlens.functions.grouped import first_per

RATIO = "decimal(22,6)"
OUTPUT = [
    "company_id", "report_id", "metric_name", "signal_type", "signal_code", "value",
    "classification", "severity", "supporting_metric_ids", "explanation",
]


def _last_by_name(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Wide table, one row per report: for each name the metric that comes last in id order."""
    return metrics.filter(F.col("normalized_metric_name").isin(names)).groupBy(
        "company_id", "report_id"
    ).agg(*[
        F.max_by(
            F.when(F.col("normalized_metric_name") == n, F.struct("metric_id", "value")),
            F.when(F.col("normalized_metric_name") == n, F.col("metric_id")),
        ).alias(n)
        for n in names
    ])


def _pct(c: Column, *, sign: bool = True) -> Column:
    return F.concat(money.fixed(c * 100, 2, sign=sign), F.lit("%"))


def _money(c: Column) -> Column:
    return F.format_number(c, 2)


def ratios(metrics: DataFrame) -> DataFrame:
    """The five ratios, with the extracted margin standing in where a ratio cannot be formed."""
    names = [
        "REVENUE", "GROSS_PROFIT", "GROSS_MARGIN", "OPERATING_INCOME", "OPERATING_MARGIN",
        "NET_INCOME", "NET_MARGIN", "TOTAL_DEBT", "OPERATING_CASH_FLOW",
    ]
    wide = _last_by_name(metrics, names)
    rev = F.col("REVENUE")

    def over_revenue(code: str, top: str, stand_in: str | None) -> Column:
        usable = F.col(top).isNotNull() & (rev["value"] != 0)
        made = F.struct(
            F.lit(code).alias("name"),
            F.try_divide(F.col(top)["value"], rev["value"]).cast(RATIO).alias("value"),
            F.array(F.col(top)["metric_id"], rev["metric_id"]).alias("ids"),
        )
        out = F.when(usable, made)
        if stand_in:
            given = F.struct(
                F.lit(code).alias("name"), F.col(stand_in)["value"].cast(RATIO).alias("value"),
                F.array(F.col(stand_in)["metric_id"]).alias("ids"),
            )
            out = out.when(F.col(stand_in)["value"].isNotNull(), given)
        return out

    made = F.array_compact(F.array(
        over_revenue("GROSS_MARGIN", "GROSS_PROFIT", "GROSS_MARGIN"),
        over_revenue("OPERATING_MARGIN", "OPERATING_INCOME", "OPERATING_MARGIN"),
        over_revenue("NET_MARGIN", "NET_INCOME", "NET_MARGIN"),
        over_revenue("DEBT_TO_REVENUE", "TOTAL_DEBT", None),
        over_revenue("CASH_FLOW_MARGIN", "OPERATING_CASH_FLOW", None),
    ))
    return wide.select("company_id", "report_id", F.explode(made).alias("_r")).select(
        "company_id", "report_id", F.col("_r.name").alias("signal_code"),
        F.col("_r.value").alias("value"), F.col("_r.ids").alias("supporting_metric_ids"),
    )


def growth_trend(rate: Column, thresholds: dict[str, str] | None = None) -> Column:
    t = thresholds or vocab.TREND_THRESHOLDS
    limit = {k: F.lit(str(v)).cast("decimal(22,6)") for k, v in t.items()}
    return (
        F.when(rate > limit["strong"], F.lit("STRONG_GROWTH"))
        .when(rate >= limit["moderate"], F.lit("MODERATE_GROWTH"))
        .when(rate >= limit["low"], F.lit("LOW_GROWTH"))
        .otherwise(F.lit("DECLINING"))
    )


def _three_way(c: Column, up: str, down: str, flat: str) -> Column:
    return F.when(c > 0, F.lit(up)).when(c < 0, F.lit(down)).otherwise(F.lit(flat))


def _fields(sig_type, code, metric, value, classification, severity, ids, explanation) -> dict[str, Column]:
    return {
        "signal_type": sig_type, "signal_code": code, "metric_name": metric, "value": value.cast(RATIO), "classification": classification,
        "severity": severity, "supporting_metric_ids": ids, "explanation": explanation,
    }


def _emit(*parts) -> Column:
    return F.struct(*[c.alias(name) for name, c in _fields(*parts).items()])


def comparison_signals(
    comparisons: DataFrame, *, thresholds: dict[str, str] | None = None, pct_scale: int = 1
) -> DataFrame:
    """Growth, margin, debt and cash-generation signals; one scan, several rows per comparison.

    Stored percentages are in percent points while the thresholds are fractions.  The
    literal reading compares them as they are (``pct_scale=1``); ``pct_scale=100`` brings
    both to fractions.  Rows are multiplied by the kind of signal alone and worded afterwards,
    so words that nobody reads are not made.
    """
    m, kind = F.col("metric_name"), F.col("comparison_type")
    pct = F.try_divide(F.col("percentage_change").cast(RATIO), F.lit(pct_scale).cast("decimal(5,0)")).cast(RATIO)
    diff = F.col("absolute_change")
    ids = F.array("metric_id")
    label = text.title_words(m)
    amounts = F.concat(F.lit("(from "), _money(F.col("previous_value")), F.lit(" to "),
                       _money(F.col("current_value")), F.lit(")."))

    trend = growth_trend(pct, thresholds)
    growth = (
        m.isin(list(vocab.GROWTH_SIGNAL_TYPES)) & pct.isNotNull(),
        _fields(
            money.mapping(vocab.GROWTH_SIGNAL_TYPES)[m], F.concat(m, F.lit("_GROWTH_"), kind), m,
            pct, trend,
            money.mapping({"STRONG_GROWTH": "VERY_POSITIVE", "MODERATE_GROWTH": "POSITIVE",
                           "LOW_GROWTH": "NEUTRAL", "DECLINING": "NEGATIVE"})[trend],
            ids,
            F.concat(label, F.lit(" grew by "), _pct(pct), F.lit(" "), kind, F.lit(" "), amounts),
        ),
    )
    margin = (
        m.isin(vocab.MARGIN_METRICS) & diff.isNotNull(),
        _fields(
            F.lit("PROFITABILITY"), F.concat(m, F.lit("_CHANGE_"), kind), m, diff,
            _three_way(diff, "MARGIN_EXPANSION", "MARGIN_COMPRESSION", "MARGIN_UNCHANGED"),
            _three_way(diff, "POSITIVE", "NEGATIVE", "NEUTRAL"), ids,
            F.concat(label, F.lit(" changed by "), _pct(diff), F.lit(" "), kind,
                     F.lit(" (from "), _pct(F.col("previous_value")), F.lit(" to "),
                     _pct(F.col("current_value")), F.lit(").")),
        ),
    )
    debt = (
        (m == "TOTAL_DEBT") & pct.isNotNull(),
        _fields(
            F.lit("LEVERAGE"), F.concat(F.lit("DEBT_CHANGE_"), kind), m, pct,
            _three_way(pct, "DEBT_INCREASE", "DEBT_REDUCTION", "DEBT_UNCHANGED"),
            _three_way(pct, "NEGATIVE", "POSITIVE", "NEUTRAL"), ids,
            F.concat(F.lit("Total Debt changed by "), _pct(pct), F.lit(" "), kind, F.lit(" "), amounts),
        ),
    )
    cash_class = _three_way(pct, "CASH_GENERATION_IMPROVEMENT", "CASH_FLOW_DETERIORATION", "")
    cash = (
        (m == "FREE_CASH_FLOW") & (pct != 0),
        _fields(
            F.lit("CASH_FLOW"), F.concat(cash_class, F.lit("_"), kind), m, pct, cash_class,
            _three_way(pct, "POSITIVE", "NEGATIVE", "NEUTRAL"), ids,
            F.concat(
                F.lit("Free Cash Flow "), F.when(pct > 0, F.lit("grew by ")).otherwise(F.lit("decreased by ")),
                _pct(pct), F.lit(" "), kind, F.lit(", indicating "),
                F.when(pct > 0, F.lit("cash generation improvement."))
                .otherwise(F.lit("cash flow deterioration.")),
            ),
        ),
    )
    kinds = {"growth": growth, "margin": margin, "debt": debt, "cash": cash}
    found = comparisons.withColumn("_kind", F.explode(F.array_compact(F.array(*[
        F.when(applies, F.lit(k)) for k, (applies, _) in kinds.items()]))))

    def worded(name: str) -> Column:
        return F.coalesce(*[F.when(F.col("_kind") == k, fields[name]) for k, (_, fields) in kinds.items()])

    return found.select("company_id", "report_id", *[worded(name).alias(name) for name in growth[1]])


def leverage_signals(comparisons: DataFrame) -> DataFrame:
    """Debt-to-revenue now against before, from the two comparisons of one report and type."""
    sides = comparisons.filter(F.col("metric_name").isin("TOTAL_DEBT", "REVENUE")).groupBy(
        "company_id", "report_id", "comparison_type"
    ).agg(*[
        F.max_by(
            F.when(F.col("metric_name") == n,
                   F.struct("metric_id", "current_value", "previous_value")),
            F.when(F.col("metric_name") == n, F.col("metric_id")),
        ).alias(a)
        for n, a in (("TOTAL_DEBT", "d"), ("REVENUE", "r"))
    ])
    usable = (
        F.col("d").isNotNull() & (F.col("r.previous_value") != 0) & (F.col("r.current_value") != 0)
    )
    now = F.try_divide(F.col("d.current_value"), F.col("r.current_value"))
    was = F.try_divide(F.col("d.previous_value"), F.col("r.previous_value"))
    kind = F.col("comparison_type")
    gap = now - was
    cls = _three_way(gap, "LEVERAGE_DETERIORATION", "LEVERAGE_IMPROVEMENT", "LEVERAGE_UNCHANGED")
    four = lambda c: money.fixed(c, 4)
    moved = F.concat(
        F.when(gap < 0, F.lit("improved from ")).otherwise(F.lit("deteriorated from ")),
        four(was), F.lit(" to "), four(now),
    )
    return sides.filter(usable).select(
        "company_id", "report_id",
        _emit(
            F.lit("LEVERAGE"), F.concat(cls, F.lit("_"), kind), F.lit("DEBT_TO_REVENUE"),
            gap, cls,
            _three_way(gap, "NEGATIVE", "POSITIVE", "NEUTRAL"),
            F.array("d.metric_id", "r.metric_id"),
            F.concat(
                F.lit("Debt-to-Revenue ratio "),
                F.when(gap == 0, F.concat(F.lit("remained unchanged at "), four(now))).otherwise(moved),
                F.lit(" ("), kind, F.lit(")."),
            ),
        ).alias("_s"),
    ).select("company_id", "report_id", "_s.*")


def _previous_guidance(history: DataFrame, name: str) -> DataFrame:
    """The company's guidance points with the one before, one point per period position.

    The choice of the earlier point is the latest strictly earlier period, so a company's
    window holds at most one row per period, with the points of that period in a list.
    """
    points = history.filter(F.col("normalized_metric_name") == name).withColumn(
        "_ord", money.period_order(F.col("fiscal_year"), F.col("fiscal_quarter"))
    )
    now = F.struct("metric_id", "value")
    slots = points.groupBy("company_id", "_ord").agg(
        F.max_by(now, "metric_id").alias("_p"), F.collect_list(F.struct("report_id", now.alias("_now"))).alias("_here")
    )
    w = Window.partitionBy("company_id").orderBy("_ord")
    # a point without a company or period asks for nothing, though one without a period comes before all others
    placed = F.col("company_id").isNotNull() & F.col("_ord").isNotNull()
    return slots.withColumn("_before", F.lag("_p").over(w)).filter(placed).select(
        "company_id", "_before", F.explode("_here").alias("_h")
    ).select("company_id", "_h.report_id", "_h._now", "_before")


def guidance_signals(metrics: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Revenue and margin guidance against the earlier guidance.

    Revenue guidance without an earlier one is held against actual revenue; margin
    guidance without an earlier one says nothing.
    """
    history = metrics if history is None else history
    actual = metrics.filter(F.col("normalized_metric_name") == "REVENUE").groupBy(
        "company_id", "report_id"
    ).agg(F.max_by(F.struct("metric_id", "value"), "metric_id").alias("_actual"))

    def against(points: DataFrame, metric: str, prefix: str, label: str, show) -> DataFrame:
        now, before = F.col("_now.value"), F.col("_before.value")
        gap = (now - before).cast(RATIO)
        cls = _three_way(gap, "GUIDANCE_RAISED", "GUIDANCE_LOWERED", "GUIDANCE_MAINTAINED")
        moved = F.concat(
            F.when(gap > 0, F.lit("raised from ")).otherwise(F.lit("lowered from ")),
            show(before), F.lit(" to "), show(now),
        )
        words = F.concat(
            F.lit(label), F.lit(" "),
            F.when(gap == 0, F.concat(F.lit("maintained at "), show(now))).otherwise(moved), F.lit("."),
        )
        return points.filter(before.isNotNull() & now.isNotNull()).select(
            "company_id", "report_id",
            _emit(
                F.lit("GUIDANCE"), F.concat(F.lit(prefix), cls), F.lit(metric), gap, cls,
                _three_way(gap, "VERY_POSITIVE", "VERY_NEGATIVE", "NEUTRAL"),
                F.array("_now.metric_id", "_before.metric_id"), words,
            ).alias("_s"),
        )

    revenue = _previous_guidance(history, "REVENUE_GUIDANCE")
    margin = _previous_guidance(history, "MARGIN_GUIDANCE")
    now, act = F.col("_now.value"), F.col("_actual.value")
    cls = F.when(now > act, F.lit("GUIDANCE_ABOVE_ACTUAL")).otherwise(F.lit("GUIDANCE_BELOW_ACTUAL"))
    no_prior = (
        revenue.filter(F.col("_before.value").isNull() & now.isNotNull())
        .join(actual, ["company_id", "report_id"])
        .filter(act.isNotNull())
        .select(
            "company_id", "report_id",
            _emit(
                F.lit("GUIDANCE"), cls, F.lit("REVENUE_GUIDANCE"), now - act, cls,
                F.when(now > act, F.lit("POSITIVE")).otherwise(F.lit("NEGATIVE")),
                F.array("_now.metric_id", "_actual.metric_id"),
                F.concat(
                    F.lit("Revenue Guidance of "), _money(now), F.lit(" is "),
                    F.when(now > act, F.lit("above")).otherwise(F.lit("below")),
                    F.lit(" current actual revenue of "), _money(act), F.lit("."),
                ),
            ).alias("_s"),
        )
    )
    return (
        against(revenue, "REVENUE_GUIDANCE", "", "Revenue Guidance", _money)
        .unionByName(no_prior)
        .unionByName(against(margin, "MARGIN_GUIDANCE", "MARGIN_", "Margin Guidance", _pct))
        .select("company_id", "report_id", "_s.*")
    )


def attach_report(comparisons: DataFrame, metrics: DataFrame) -> DataFrame:
    """Comparisons with the report of their current metric."""
    return comparisons.join(metrics.select("metric_id", "report_id"), "metric_id")


def valid_ratios(r: DataFrame) -> DataFrame:
    """Drops ratios beyond 20 in size; flags gross margins above one."""
    return r.filter(F.abs("value") <= 20).withColumn(
        "warning", F.when((F.col("signal_code") == "GROSS_MARGIN") & (F.col("value") > 1),
                          F.lit("gross_margin_above_one")),
    )


def ratio_rows(r: DataFrame) -> DataFrame:
    """Ratios in the shape of the analytics table."""
    code = F.col("signal_code")
    percent_like = code != "DEBT_TO_REVENUE"
    shown = F.when(percent_like, _pct(F.col("value"), sign=False)).otherwise(
        money.fixed(F.col("value"), 4)
    )
    return r.select(
        "company_id", "report_id", code.alias("metric_name"),
        F.when(code.isin(vocab.MARGIN_METRICS), F.lit("PROFITABILITY"))
        .when(code == "DEBT_TO_REVENUE", F.lit("LEVERAGE"))
        .otherwise(F.lit("CASH_FLOW")).alias("signal_type"),
        code.alias("signal_code"), "value", F.lit("RATIO").alias("classification"),
        F.lit("NEUTRAL").alias("severity"), "supporting_metric_ids",
        F.concat(text.title_words(code), F.lit(" is "), shown).alias("explanation"),
    )


def build_analytics(
    metrics: DataFrame, comparisons: DataFrame, history: DataFrame | None = None, *,
    thresholds: dict[str, str] | None = None, pct_scale: int = 1,
) -> DataFrame:
    """All ratios and signals of every report in one table, validated and free of duplicates."""
    located = comparisons if "report_id" in comparisons.columns else attach_report(comparisons, metrics)
    # codes of different kinds differ and leverage has one row a code: duplicates are dropped
    # kind by kind, where rows lie already, and not after the union, which forgets where
    def unique(signals: DataFrame) -> DataFrame:
        return first_per(signals, ["company_id", "report_id", "signal_code", "metric_name"], [F.array_join("supporting_metric_ids", "|")])

    signals = (
        unique(comparison_signals(located, thresholds=thresholds, pct_scale=pct_scale))
        .unionByName(leverage_signals(located))
        .unionByName(unique(guidance_signals(metrics, history)))
        .filter(F.col("severity").isin(vocab.SIGNAL_SEVERITIES))
    )
    return ratio_rows(valid_ratios(ratios(metrics))).select(*OUTPUT).unionByName(signals.select(*OUTPUT))
