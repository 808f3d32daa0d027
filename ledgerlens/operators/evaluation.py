"""Evaluation against gold sets and of recorded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions import text


def rate(part: Column, whole: Column, places: int = 4) -> Column:
    """part / whole, zero when there is nothing to count."""
    return F.bround(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), places)


def gold_scores(expected: DataFrame, produced: DataFrame, keys: list[str], fields: list[str], *, group: str | None = None) -> DataFrame:
    """Precision, recall and value accuracy of produced rows against expected ones.

    Rows meet on ``keys``, NULL being equal to NULL; accuracy is the share of met rows
    whose ``fields`` all agree.
    """
    marker = F.lit("\x00")
    key = F.concat_ws("\x01", *[F.coalesce(F.col(k).cast("string"), marker) for k in keys])
    by = [group] if group else []
    e = expected.select(key.alias("_k"), *[F.col(f).alias(f"e_{f}") for f in fields], *by).withColumn("_e", F.lit(1))
    p = produced.select(key.alias("_k"), *[F.col(f).alias(f"p_{f}") for f in fields],
                        *[F.col(g).alias(f"p_{g}") for g in by]).withColumn("_p", F.lit(1))
    j = e.join(p, "_k", "full_outer")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"e_{f}").eqNullSafe(F.col(f"p_{f}"))
    met = F.col("_e").isNotNull() & F.col("_p").isNotNull()
    if group:
        j = j.withColumn(group, F.coalesce(group, f"p_{group}"))
    return j.groupBy(*by).agg(
        F.count("_e").alias("expected"), F.count("_p").alias("produced"), F.count_if(met).alias("matched"),
        F.count_if(met & same).alias("correct"),
    ).select(
        *by, "expected", "produced", "matched", "correct",
        rate(F.col("matched"), F.col("produced")).alias("precision"), rate(F.col("matched"), F.col("expected")).alias("recall"),
        rate(F.col("correct"), F.col("matched")).alias("value_accuracy"),
        rate(F.col("expected") - F.col("matched"), F.col("expected")).alias("failure_rate"))


def match_gold_risks(expected: DataFrame, produced: DataFrame, *, threshold: float = vocab.RISK_FUZZY_THRESHOLD) -> DataFrame:
    """Most similar produced risk of each expected one, within the same example.

    Names meet on shared words, so only overlapping pairs are formed.
    """
    def words(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            "id", F.col("normalized_risk_name").alias(f"{prefix}_name"), F.col("category").alias(f"{prefix}_category"),
            F.col("severity").alias(f"{prefix}_severity"),
            text.name_tokens(F.replace("normalized_risk_name", F.lit("_"), F.lit(" ")), vocab.RISK_STOP_WORDS).alias(f"{prefix}_w"),
        ).withColumn("word", F.explode(f"{prefix}_w"))

    pairs = words(expected, "e").join(words(produced, "p"), ["id", "word"]).withColumn(
        "score", text.jaccard(F.col("e_w"), F.col("p_w"))).filter(F.col("score") >= threshold)
    best = pairs.groupBy("id", "e_name", "e_category", "e_severity").agg(
        F.min_by(F.struct("p_name", "p_category", "p_severity", "score"), F.struct(-F.col("score"), F.col("p_name"))).alias("_b"))
    return best.select("id", "e_name", "e_category", "e_severity", "_b.*")


def answer_quality(answers: DataFrame, key: str) -> DataFrame:
    """Intent hits, citation rate and keyword grounding of recorded answers."""
    lowered = F.lower("answer")
    words = F.coalesce("answer_keywords", F.array().cast("array<string>"))
    grounded = (F.size(words) == 0) | F.exists(words, lambda w: lowered.contains(F.lower(w)))
    cited = F.col("citations") > 0
    share = lambda c: F.bround(F.avg(c.cast("int")), 6)
    return answers.groupBy(key).agg(
        F.count(F.lit(1)).alias("answers"), share(F.array_contains("expected_intent", F.col("intent"))).alias("intent_rate"),
        F.coalesce(share(F.when(F.col("expect_citations"), cited)), F.lit(1.0)).alias("citation_rate"),
        share(grounded).alias("grounding_rate"), share(cited).alias("evidence_coverage"))
