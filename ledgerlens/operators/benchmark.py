"""Cohort benchmarking: company profiles, ranks, scores and summaries.

Profiles aggregate every branch (metrics, comparisons, risks, tone) to one row per
company before joining, so branches never multiply each other.  Ranks work on distinct
values with their counts; a cohort of any size spreads over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions.grouped import number_rows, running_total, top_per
from ledgerlens.operators.periods import latest_report, strictly_earlier_report

GROWTHS = {
    "REVENUE_GROWTH": "revenue", "EBITDA_GROWTH": "ebitda", "NET_INCOME_GROWTH": "net_income",
    "FCF_GROWTH": "fcf", "CAPEX_GROWTH": "capex", "DEBT_GROWTH": "debt",
}


# --- ranks and scores -----------------------------------------------------------------
def rank_items(
    df: DataFrame, partition: list[str], value: str = "value", *,
    higher_is_better: Column | bool = True, tie: str = "min", bounded: bool = False,
) -> DataFrame:
    """Add ``rank`` and ``percentile`` per partition; NULL values get neither.

    Values that agree to nine places tie.  Ties: ``min`` 1,2,2,4; ``dense`` 1,2,2,3;
    ``average`` 1,2.5,2.5,4.  Percentile = (M - rank + .5) / M * 100 within 0..100.
    """
    better = higher_is_better if isinstance(higher_is_better, Column) else F.lit(higher_is_better)
    v = F.round(F.col(value), 9)
    keyed = df.withColumn("_o", F.when(better, -v).otherwise(v) + F.lit(0.0))
    counts = keyed.filter(F.col("_o").isNotNull()).groupBy(*partition, "_o").agg(
        F.count(F.lit(1)).alias("_n"))
    if tie == "dense":
        ranked = number_rows(counts, partition, [F.col("_o")], "_rank", bounded=bounded).withColumn(
            "_rank", F.col("_rank").cast("double"))
    else:
        upto = running_total(counts, partition, [F.col("_o")], "_n", "_cum", bounded=bounded)
        first = F.col("_cum") - F.col("_n") + 1
        mid = first + (F.col("_n") - 1) / F.lit(2.0)
        ranked = upto.withColumn("_rank", (first if tie == "min" else mid).cast("double"))
    sizes = counts.groupBy(*partition).agg(F.sum("_n").alias("_m"))
    ranked = ranked.select(*partition, "_o", "_rank").join(sizes, partition)
    share = (F.col("_m") - F.col("_rank") + 0.5) / F.col("_m") * 100.0
    return keyed.join(ranked, [*partition, "_o"], "left").withColumn("rank", F.col("_rank")).withColumn(
        "percentile", F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))
    ).withColumn("percentile", F.when(F.col("_rank").isNotNull(), F.col("percentile"))).drop("_o", "_rank", "_m")


def normalize_scores(
    df: DataFrame, partition: list[str], value: str = "value", *, higher_is_better: Column | bool = True
) -> DataFrame:
    """Min-max score 0..100 per partition; all values equal gives 100; NULL stays NULL."""
    better = higher_is_better if isinstance(higher_is_better, Column) else F.lit(higher_is_better)
    span = df.groupBy(*partition).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    v, lo, hi = F.col(value), F.col("_lo"), F.col("_hi")
    score = (
        F.when(v.isNull(), F.lit(None).cast("double"))
        .when(F.abs(hi - lo) < 1e-9, F.lit(100.0))
        .when(better, (v - lo) / (hi - lo) * 100.0)
        .otherwise((hi - v) / (hi - lo) * 100.0)
    )
    return df.join(span, partition).withColumn("score", score).drop("_lo", "_hi")


def with_direction(long: DataFrame) -> DataFrame:
    """Add the dimension's direction of each metric."""
    lower = [
        f"{d}|{m}" for d, ms in vocab.METRIC_DIRECTIONS.items() for m, up in ms.items() if not up
    ]
    return long.withColumn(
        "higher_is_better", ~F.concat_ws("|", "dimension", "metric_name").isin(lower))


def check_weights(weights: dict[str, float] | None) -> dict[str, float]:
    """Weights by lower-case dimension, summing to 1; given as fractions or as percentages."""
    if weights is None:
        return dict(vocab.DEFAULT_WEIGHTS)
    given = {k.lower(): float(v) for k, v in weights.items()}
    full = {k: given.get(k, 0.0) for k in vocab.DEFAULT_WEIGHTS}
    total = sum(full.values())
    unit = next((u for u in (1.0, 100.0) if abs(total - u) <= 1e-5), None)
    if unit is None:
        raise ValueError(f"weights must sum to 1 or 100, got {total}")
    if min(full.values()) < 0:
        raise ValueError("weights must not be negative")
    return {k: v / unit for k, v in full.items()}


def cohort_problems(cohorts: DataFrame) -> DataFrame:
    """Cohorts that cannot be ranked, with the reason."""
    sizes = cohorts.groupBy("cohort_id", "company_id").agg(F.count(F.lit(1)).alias("_n")).groupBy(
        "cohort_id").agg(F.count(F.lit(1)).alias("companies"), F.max("_n").alias("_max"))
    reason = F.when(F.col("companies") < 2, F.lit("too_few_companies")).when(
        F.col("_max") > 1, F.lit("duplicate_company"))
    return sizes.select("cohort_id", "companies", reason.alias("reason"))


def weight_problems(runs: DataFrame) -> DataFrame:
    """Weight rows of many runs: rescaled weights, or the reason they are refused."""
    dims = list(vocab.DEFAULT_WEIGHTS)
    w = {d: F.coalesce(F.col(d), F.lit(0.0)) for d in dims}
    total = sum(w.values(), F.lit(0.0))
    unit = F.when(F.abs(total - 1.0) <= 1e-5, F.lit(1.0)).when(F.abs(total - 100.0) <= 1e-5, F.lit(100.0))
    reason = F.when(unit.isNull(), F.lit("weights_do_not_sum")).when(
        F.least(*w.values()) < 0, F.lit("negative_weight"))
    return runs.select("run_id", *[(c / unit).alias(d) for d, c in w.items()], reason.alias("reason"))


# --- company profile ----------------------------------------------------------------------
def _scan_first(value: Column, order: Column, cond: Column) -> Column:
    return F.min_by(F.when(cond, value), F.when(cond, order))


def metric_picks(metrics: DataFrame, which: DataFrame) -> DataFrame:
    """For each company the first metric (by id) of every alias set, now and before.

    ``which`` lists (company_id, report_id, slot) with slot ``now`` or ``prev``; both
    reports are read in one pass over the metrics.
    """
    names = F.array(F.col("normalized_metric_name"), F.upper("metric_name"))
    val, order = F.col("value").cast("double"), F.col("metric_id")
    hit = lambda words: F.arrays_overlap(names, F.array(*[F.lit(w) for w in words]))
    aggs = []
    for key, words in vocab.PROFILE_ALIASES.items():
        for slot in ("now", "prev"):
            aggs.append(_scan_first(val, order, hit(words) & (F.col("slot") == slot)).alias(f"{key}_{slot}"))
        grown = [f"{w}_GROWTH" for w in words]
        aggs.append(_scan_first(val, order, hit(grown) & (F.col("slot") == "now")).alias(f"{key}_grown"))
    return metrics.drop("company_id").join(which, "report_id").groupBy("company_id").agg(*aggs)


def yoy_picks(comparisons: DataFrame, which: DataFrame, *, any_report: bool = False) -> DataFrame:
    """Stored year-over-year percentage of each alias set (first by metric id).

    Only the latest report's comparisons count; ``any_report=True`` takes any of the company's.
    """
    pool = comparisons.filter((F.col("comparison_type") == "YOY") & F.col("percentage_change").isNotNull())
    if not any_report:
        pool = pool.join(which.filter("slot = 'now'").select("report_id"), "report_id", "left_semi")
    pct = F.col("percentage_change").cast("double")
    return pool.groupBy("company_id").agg(*[
        _scan_first(pct, F.col("metric_id"), F.col("metric_name").isin(vocab.PROFILE_ALIASES[k])).alias(f"{k}_yoy")
        for k in sorted(set(GROWTHS.values()))
    ])


def risk_dimension(risks: DataFrame, evolutions: DataFrame, latest: DataFrame) -> DataFrame:
    """Risk counts of the latest report; zero, not NULL, when it has none."""
    now = latest.select("company_id", "report_id", "total_pages")
    counts = risks.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == "HIGH").alias("high"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
    )
    moved = evolutions.join(
        risks.select(F.col("risk_id").alias("current_risk_id"), F.col("report_id").alias("_r")), "current_risk_id"
    ).groupBy(F.col("_r").alias("report_id")).agg(
        F.count_if(F.col("evolution_type") == "NEW_RISK").alias("new"),
        F.count_if(F.col("evolution_type") == "ESCALATED_RISK").alias("escalated"),
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    pages = F.coalesce(F.nullif("total_pages", F.lit(0)), F.lit(1))
    return now.join(counts, "report_id", "left").join(moved, "report_id", "left").select(
        "company_id", z("total").alias("TOTAL_RISKS"), z("high").alias("HIGH_SEVERITY_RISKS"),
        z("critical").alias("CRITICAL_RISKS"), z("new").alias("NEW_RISKS"),
        z("escalated").alias("ESCALATED_RISKS"), (z("total") / pages).alias("RISK_DENSITY"),
    )


def tone_dimension(tones: DataFrame, which: DataFrame) -> DataFrame:
    """Tone means of the latest report and the change of confidence since the one before.

    Scores enter as decimals, which keeps sums independent of the order of rows.
    """
    d = lambda c: F.col(c).cast("decimal(10,8)")
    net = (d("positive_score") - d("negative_score")).cast("decimal(12,8)")
    now, prev = F.col("slot") == "now", F.col("slot") == "prev"
    mean = lambda cond, c: F.avg(F.when(cond, c)).cast("double")
    agg = tones.drop("company_id").join(which, "report_id").groupBy("company_id").agg(
        mean(now, net).alias("SENTIMENT_SCORE"), mean(now, d("confidence_score")).alias("CONFIDENCE_SCORE"),
        mean(now, d("hedging_score")).alias("HEDGING_SCORE"),
        mean(now, (net * net).cast("decimal(24,16)")).alias("_sq"),
        mean(prev, d("confidence_score")).alias("_before"),
    )
    spread = F.sqrt(F.greatest(F.lit(0.0), F.round(F.col("_sq") - F.col("SENTIMENT_SCORE") ** 2, 12)))
    return agg.select(
        "company_id", "SENTIMENT_SCORE", "CONFIDENCE_SCORE", "HEDGING_SCORE",
        F.when(F.col("SENTIMENT_SCORE").isNotNull(), F.greatest(F.lit(0.0), 1.0 - spread)).alias("TONE_STABILITY"),
        (F.col("CONFIDENCE_SCORE") - F.col("_before")).alias("CONFIDENCE_EVOLUTION"),
    )


def company_profile(
    reports: DataFrame, metrics: DataFrame, comparisons: DataFrame, risks: DataFrame,
    evolutions: DataFrame, tones: DataFrame, *, year: int | None = None, any_report: bool = False,
) -> DataFrame:
    """One wide row per company with the 25 benchmark metrics of its latest report.

    ``comparisons`` carry ``report_id`` (see :func:`analytics.attach_report`).
    """
    latest = latest_report(reports, year)
    earlier = strictly_earlier_report(latest, reports)
    which = latest.select("company_id", "report_id", F.lit("now").alias("slot")).unionByName(
        earlier.select("company_id", F.col("previous_report_id").alias("report_id"), F.lit("prev").alias("slot")))
    wide = (
        risk_dimension(risks, evolutions, latest)
        .join(metric_picks(metrics, which), "company_id", "left")
        .join(yoy_picks(comparisons, which, any_report=any_report), "company_id", "left")
        .join(tone_dimension(tones, which), "company_id", "left")
    )
    c = F.col

    def growth(key: str) -> Column:
        computed = F.when(
            c(f"{key}_prev") != 0, (c(f"{key}_now") - c(f"{key}_prev")) / c(f"{key}_prev") * 100.0)
        return F.coalesce(c(f"{key}_yoy"), c(f"{key}_grown"), computed)

    def of_revenue(given: str, top: str) -> Column:
        made = F.when(c("revenue_now") != 0, c(f"{top}_now") / c("revenue_now") * 100.0)
        return F.coalesce(c(f"{given}_now"), made)

    paid = lambda k: F.abs(F.coalesce(c(f"{k}_now"), F.lit(0.0)))
    growths = {name: growth(k) for name, k in GROWTHS.items()}
    values = {
        **{n: g for n, g in growths.items() if n != "DEBT_GROWTH"},
        "OPERATING_MARGIN": of_revenue("operating_margin", "operating_income"),
        "NET_MARGIN": of_revenue("net_margin", "net_income"),
        "DEBT_TO_REVENUE": of_revenue("debt_to_revenue", "debt"),
        "CASH_FLOW_MARGIN": of_revenue("cash_flow_margin", "ocf"),
        "CAPEX": c("capex_now"), "DEBT_REDUCTION": -growths["DEBT_GROWTH"],
        "CASH_DEPLOYMENT": c("capex_now") + paid("dividends") + paid("buybacks"),
        "DIVIDEND_METRICS": c("dividends_now"), "BUYBACK_METRICS": c("buybacks_now"),
    }
    direct = [m for d in ("RISK", "TONE") for m in vocab.METRIC_DIRECTIONS[d]]
    return wide.select("company_id", *[v.alias(n) for n, v in values.items()], *direct)


def unpivot_profile(profile: DataFrame) -> DataFrame:
    """(company, dimension, metric, value) rows, 25 per company."""
    cells = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.lit(m).alias("metric_name"),
                 F.col(m).cast("double").alias("value"))
        for d, ms in vocab.METRIC_DIRECTIONS.items() for m in ms
    ])
    return profile.select("company_id", F.explode(cells).alias("_c")).select("company_id", "_c.*")


def score_cohorts(
    cohorts: DataFrame, profile: DataFrame, *, tie: str = "min", places: int | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Value, rank, percentile and score of every (cohort, company, metric)."""
    ok = cohort_problems(cohorts).filter("reason is null").select("cohort_id")
    long = with_direction(
        cohorts.join(ok, "cohort_id", "left_semi").join(unpivot_profile(profile), "company_id"))
    if places is not None:
        long = long.withColumn("value", F.round("value", places))
    part = ["cohort_id", "dimension", "metric_name"]
    up = F.col("higher_is_better")
    ranked = rank_items(long, part, higher_is_better=up, tie=tie, bounded=bounded)
    return normalize_scores(ranked, part, higher_is_better=up)


def summarize_cohorts(
    scored: DataFrame, weights: dict[str, float] | None = None, *, bounded: bool = False
) -> DataFrame:
    """Dimension means, weighted overall score over present dimensions, and overall rank."""
    w = check_weights(weights)
    dims = scored.groupBy("cohort_id", "company_id").agg(*[
        F.avg(F.when(F.col("dimension") == d, F.round("score", 9).cast("decimal(14,9)"))).cast("double").alias(
            f"{d.lower()}_score")
        for d in vocab.DIMENSIONS
    ])
    present = [(F.col(f"{k}_score"), F.lit(v)) for k, v in w.items()]
    top = sum((F.coalesce(s * x, F.lit(0.0)) for s, x in present), F.lit(0.0))
    base = sum((F.when(s.isNotNull(), x).otherwise(F.lit(0.0)) for s, x in present), F.lit(0.0))
    overall = dims.withColumn("overall_score", F.when(base >= 1e-9, top / base))
    return rank_items(overall, ["cohort_id"], "overall_score", bounded=bounded).drop("percentile")


def podium(summaries: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` of each cohort by rank; unranked companies come last."""
    return top_per(summaries, ["cohort_id"], [F.col("rank").asc_nulls_last(), F.col("company_id")], k, "place")
