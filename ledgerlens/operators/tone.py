"""Management-tone scoring, evolution and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions import text
from ledgerlens.functions.grouped import number_rows
from ledgerlens.operators.periods import prior_report


def sentiment(positive: Column, negative: Column, margin: float = vocab.SENTIMENT_MARGIN) -> Column:
    gap = positive - negative
    return (
        F.when(gap > margin, F.lit("POSITIVE"))
        .when(gap < -margin, F.lit("NEGATIVE"))
        .otherwise(F.lit("NEUTRAL"))
    )


def confidence_level(confidence: Column, hedging: Column) -> Column:
    return (
        F.when((confidence >= 0.15) & (hedging <= 0.05), F.lit("VERY_CONFIDENT"))
        .when((confidence >= 0.05) & (hedging <= 0.10), F.lit("CONFIDENT"))
        .when((hedging >= 0.15) & (confidence <= 0.05), F.lit("VERY_CAUTIOUS"))
        .when(hedging >= 0.05, F.lit("CAUTIOUS"))
        .otherwise(F.lit("CONFIDENT"))
    )


def tone_confidence(
    method: Column, external: Column | None = None, disagreement: Column | None = None
) -> Column:
    disputed = F.lit(False) if disagreement is None else disagreement
    given = F.lit(None).cast("double") if external is None else external
    return (
        F.when(method == "HYBRID_VALIDATED", F.lit(0.95))
        .when(method == "RULE_BASED", F.when(disputed, F.lit(0.50)).otherwise(F.lit(0.70)))
        .when((method == "LLM_BASED") & given.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), given)))
        .when(method == "LLM_BASED", F.lit(0.80))
        .otherwise(F.lit(0.60))
    )


def hedging_strength(c: Column, phrases: list[str] = vocab.HEDGING_PHRASES) -> Column:
    """Hedging phrases per sentence, capped at one."""
    n = F.greatest(F.lit(1), text.sentence_count(c))
    return F.least(F.lit(1.0), text.phrase_total(F.lower(text.squeeze(c)), phrases) / n)


def score_tone(
    chunks: DataFrame, phrases: dict[str, list[str]] | None = None, *, place: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One tone row per non-blank chunk.  Column expressions only; no shuffle.

    ``place`` gives the scores the company and report that their chunks do not have yet.
    """
    p = phrases or {
        "positive": vocab.POSITIVE_PHRASES, "negative": vocab.NEGATIVE_PHRASES,
        "confidence": vocab.CONFIDENCE_PHRASES, "hedging": vocab.HEDGING_PHRASES,
    }
    base = chunks.filter(~text.is_blank(F.col("chunk_text"))).withColumn(
        "_lower", F.lower(text.squeeze(F.col("chunk_text")))
    ).withColumn("sentence_count", text.sentence_count(F.col("chunk_text")))
    counted = base.select("*", *[
        text.phrase_total(F.col("_lower"), words).alias(f"{name}_count") for name, words in p.items()
    ])
    n = F.greatest(F.lit(1), F.col("sentence_count"))
    share = {name: F.least(F.lit(1.0), F.col(f"{name}_count") / n) for name in p}
    scored = counted.select("*", *[c.alias(f"{name}_score") for name, c in share.items()])
    if place is not None:
        scored = place(scored.withColumn("chunk_text", F.substring("chunk_text", 1, 300)).drop("_lower"))
    return scored.select(
        F.concat_ws("|", "report_id", "chunk_id").alias("tone_id"), "company_id", "report_id",
        F.col("chunk_id").alias("source_chunk_id"),
        F.coalesce("section", F.lit(vocab.DEFAULT_TONE_SOURCE)).alias("source_type"),
        F.col("chunk_index").alias("seq"),
        sentiment(F.col("positive_score"), F.col("negative_score")).alias("sentiment"),
        confidence_level(F.col("confidence_score"), F.col("hedging_score")).alias("confidence_level"),
        "hedging_score", "positive_score", "negative_score",
        tone_confidence(F.lit("RULE_BASED")).alias("confidence_score"),
        F.lit("RULE_BASED").alias("extraction_method"),
        text.strip(F.substring("chunk_text", 1, 300)).alias("source_text"),
        "sentence_count", "positive_count", "negative_count", "confidence_count", "hedging_count",
    )


# --- evolution --------------------------------------------------------------------------
def match_tones(tones: DataFrame, reports: DataFrame) -> DataFrame:
    """The nth record of a source type pairs with the nth of the prior report; unmatched drop."""
    keys = ["report_id", "source_type"]
    numbered = number_rows(
        tones.select(
            "tone_id", "company_id", *keys, "seq", "sentiment", "confidence_level",
            "hedging_score", "confidence_score",
        ),
        keys, [F.col("seq"), F.col("tone_id")], "_n",
    )
    steps = prior_report(reports).filter("prior_report_id is not null").select("report_id", "prior_report_id")
    now = numbered.join(steps, "report_id")
    before = numbered.select(
        F.col("report_id").alias("prior_report_id"), "source_type", "_n",
        *[F.col(c).alias(f"p_{c}") for c in
          ("tone_id", "sentiment", "confidence_level", "hedging_score", "confidence_score")],
    )
    return now.join(before, ["prior_report_id", "source_type", "_n"])


def tone_evolution(tones: DataFrame, reports: DataFrame) -> DataFrame:
    """Sentiment first, then confidence level, then hedging; five outcomes are possible."""
    m = match_tones(tones, reports)
    order = F.array(*[F.lit(s) for s in reversed(vocab.SENTIMENTS)])
    levels = F.array(*[F.lit(s) for s in vocab.CONFIDENCE_LEVELS])
    mood = F.array_position(order, F.col("sentiment")) - F.array_position(order, F.col("p_sentiment"))
    level = F.array_position(levels, F.col("confidence_level")) - F.array_position(
        levels, F.col("p_confidence_level"))
    hedge = F.col("hedging_score") - F.col("p_hedging_score")
    kind = (
        F.when(mood > 0, F.lit("MORE_POSITIVE")).when(mood < 0, F.lit("MORE_NEGATIVE"))
        .when(level > 0, F.lit("MORE_CONFIDENT")).when(level < 0, F.lit("MORE_CAUTIOUS"))
        .when(hedge <= -vocab.HEDGING_STEP, F.lit("MORE_CONFIDENT"))
        .when(hedge >= vocab.HEDGING_STEP, F.lit("MORE_CAUTIOUS"))
        .otherwise(F.lit("UNCHANGED"))
    )
    sent, lev, src = F.col("sentiment"), F.col("confidence_level"), F.col("source_type")
    arrow = lambda a, b: F.concat(F.lit(" from "), a, F.lit(" to "), b)
    stayed = F.concat(F.lit("Sentiment remained "), sent)
    hedged = F.concat(
        stayed, F.lit(" and confidence level stayed "), lev,
        F.lit(", but hedging (uncertainty language) "),
        F.when(hedge < 0, F.lit("decreased")).otherwise(F.lit("increased")),
        arrow(F.col("p_hedging_score").cast("string"), F.col("hedging_score").cast("string")), F.lit("."),
    )
    explanation = (
        F.when(mood != 0, F.concat(
            F.lit("Sentiment "), F.when(mood > 0, F.lit("improved")).otherwise(F.lit("declined")),
            arrow(F.col("p_sentiment"), sent), F.lit(" in "), src, F.lit(".")))
        .when(level != 0, F.concat(
            stayed, F.lit(", but confidence "),
            F.when(level > 0, F.lit("increased")).otherwise(F.lit("decreased")),
            arrow(F.col("p_confidence_level"), lev), F.lit(".")))
        .when(F.abs(hedge) >= vocab.HEDGING_STEP, hedged)
        .otherwise(F.concat(
            F.lit("Tone remained unchanged at "), sent, F.lit(" ("), lev, F.lit(") with stable hedging.")))
    )
    return m.select(
        "company_id", "report_id", F.col("tone_id").alias("current_tone_id"),
        F.col("p_tone_id").alias("previous_tone_id"), kind.alias("evolution_type"),
        F.bround((F.col("confidence_score") + F.col("p_confidence_score")) / 2.0, 3).alias("confidence_score"),
        explanation.alias("explanation"),
    )


# --- summaries -----------------------------------------------------------------------------
def tone_summary(tones: DataFrame, key: str = "company_id") -> DataFrame:
    """Averages per (key, source type) and per key in one pass; the total row has ``is_total``.

    Scores are summed as decimals so the averages do not depend on the order of rows.
    """
    exact = lambda c: F.bround(F.avg(F.col(c).cast("decimal(12,9)")).cast("double"), 3)
    level = F.grouping("source_type")
    out = tones.rollup(key, "source_type").agg(
        F.grouping(key).alias("_all"), level.alias("is_total"),
        F.count(F.lit(1)).alias("record_count"),
        exact("positive_score").alias("average_positive"),
        exact("negative_score").alias("average_negative"),
        exact("hedging_score").alias("average_hedging"),
        exact("confidence_score").alias("average_confidence"),
        F.avg(F.col("positive_score").cast("decimal(12,9)")).cast("double").alias("_p"),
        F.avg(F.col("negative_score").cast("decimal(12,9)")).cast("double").alias("_n"),
    ).filter("_all = 0")
    return out.select(
        key, "source_type", F.col("is_total").cast("int").alias("is_total"), "record_count",
        "average_positive", "average_negative", "average_hedging", "average_confidence",
        sentiment(F.col("_p"), F.col("_n")).alias("dominant_sentiment"),
    )


def sentiment_profile(tones: DataFrame, key: str = "company_id") -> DataFrame:
    """Most frequent sentiment (first by name on a tie), neutral share and mean scores."""
    counts = {s: F.count_if(F.col("sentiment") == s) for s in vocab.SENTIMENTS}
    ranked = F.array_sort(F.array(*[
        F.struct((-counts[s]).alias("n"), F.lit(s).alias("s")) for s in vocab.SENTIMENTS
    ]))
    d = lambda c: F.col(c).cast("decimal(12,9)")
    return tones.groupBy(key).agg(
        F.count(F.lit(1)).alias("records"), ranked[0]["s"].alias("dominant_sentiment"),
        F.floor(counts["NEUTRAL"] * 100 / F.count(F.lit(1)) + F.lit(0.5)).cast("int").alias("neutral_pct"),
        F.bround(F.avg(d("positive_score") - d("negative_score")).cast("double"), 6).alias("mean_sentiment"),
        F.bround(F.avg(d("hedging_score")).cast("double"), 6).alias("mean_hedging"),
    )
