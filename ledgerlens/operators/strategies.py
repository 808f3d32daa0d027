"""What each step of a retrieval strategy is worth: ranked lists tagged by stage, scored in one pass.

A list is ``query_id``, ``stage``, ``rank``, ``chunk_id``, ``score``; its stages are the plain
search (``baseline``), what the strategy found (``retrieved``) and that in its final order
(``reranked``).  A query that failed is counted and gets no score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions.grouped import number_rows
from ledgerlens.operators.retrieval import judge

BASELINE, RETRIEVED, RERANKED = STAGES = ("baseline", "retrieved", "reranked")
MEASURES = ("recall", "precision", "mrr", "hit_rate", "ndcg", "candidate_reduction_pct", "reranking_gain", "query_rewriting_gain", "hyde_gain")


def tagged(stage: str, results: DataFrame) -> DataFrame:
    """``results`` (query_id, chunk_id, score) as the list of one stage; a query's list is bounded by its depth."""
    ranked = number_rows(results, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], "rank", bounded=True)
    return ranked.select(
        F.col("query_id").cast("string").alias("query_id"), F.lit(stage).alias("stage"), "rank", F.col("chunk_id").cast("string").alias("chunk_id"), "score")


def _ideal(hits: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), hits.cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))


def query_scores(
    lists: DataFrame, chunks: DataFrame, truth: DataFrame, totals: DataFrame, corpus: DataFrame, *, rewrite: bool, passage: bool,
    k: int = vocab.TOP_K_DEFAULT,
) -> DataFrame:
    """One row per query of ``truth``: measures of its final list, and what its steps gained in nDCG.

    ``lists`` is the union of the stages; ``chunks`` has chunk_id, section and report_id,
    ``truth`` what :func:`retrieval.judge` needs, ``totals`` the relevant chunks of each
    query and ``corpus`` one row with ``corpus_size``.  A query without results scores zero.
    Reranking gains final less retrieved; a hypothetical passage, or else a rewrite, gains
    retrieved less baseline.
    """
    facts = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "section", "report_id")
    judged = judge(lists.join(facts, "chunk_id"), truth.drop("category"))
    good = F.col("relevant") & (F.col("rank") <= k)
    sums = []
    for s in STAGES:
        at = F.col("stage") == s
        sums += [
            F.count_if(at & good).alias(f"hits_{s}"),
            F.bround(F.coalesce(F.sum(F.when(at & good, 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)), 9).alias(f"dcg_{s}")]
    final = F.col("stage") == RERANKED
    per = judged.groupBy("query_id").agg(
        *sums, F.count_if(final & (F.col("rank") <= k)).alias("returned"), F.min(F.when(final & F.col("relevant"), F.col("rank"))).alias("first_hit"),
        F.count_if(F.col("stage") == RETRIEVED).alias("candidates"))
    every = truth.select("query_id", "category").join(per, "query_id", "left").join(totals, "query_id", "left").crossJoin(F.broadcast(corpus))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    ndcg = {s: F.when(n(f"hits_{s}") > 0, F.col(f"dcg_{s}") / _ideal(F.col(f"hits_{s}"))).otherwise(F.lit(0.0)) for s in STAGES}
    hits, total, returned = n(f"hits_{RERANKED}"), n("total_relevant"), n("returned")
    found = F.bround(ndcg[RETRIEVED] - ndcg[BASELINE], 6)
    return every.select(
        "query_id", "category", returned.alias("returned"), total.alias("total_relevant"), n("candidates").alias("candidates"),
        F.bround(F.when(total > 0, hits / total).otherwise(F.lit(0.0)), 6).alias("recall"),
        F.bround(F.when(returned > 0, hits / returned).otherwise(F.lit(0.0)), 6).alias("precision"),
        F.bround(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)), 6).alias("mrr"),
        F.when(hits > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("hit_rate"), F.bround(ndcg[RERANKED], 6).alias("ndcg"),
        F.when(F.col("corpus_size") > 0, F.bround(F.greatest(F.lit(0.0), 1 - n("candidates") / F.col("corpus_size")) * 100, 2)).otherwise(F.lit(0.0)).alias(
            "candidate_reduction_pct"),
        F.bround(ndcg[RERANKED] - ndcg[RETRIEVED], 6).alias("reranking_gain"),
        (found if rewrite and not passage else F.lit(0.0)).alias("query_rewriting_gain"), (found if passage else F.lit(0.0)).alias("hyde_gain"))


def strategy_run(scores: DataFrame, requests: DataFrame) -> DataFrame:
    """Means over all queries (``is_total``) and per category, with the number of failures.

    ``requests`` has query_id, category, ``problem`` (NULL: none) and, where it was measured,
    ``latency_ms``.  A request with a problem is a failure: counted, and left out of all means.
    """
    timed = requests if "latency_ms" in requests.columns else requests.withColumn("latency_ms", F.lit(None).cast("double"))
    rows = timed.select("query_id", "category", "problem", "latency_ms").join(scores.drop("category"), "query_id", "left")
    ok = F.col("problem").isNull()
    mean = lambda c: F.bround(F.coalesce(F.avg(F.when(ok, F.col(c)).cast("decimal(14,6)")).cast("double"), F.lit(0.0)), 6)
    return rows.rollup("category").agg(
        F.grouping("category").cast("int").alias("is_total"), F.count_if(ok).alias("num_queries"), F.count_if(~ok).alias("failures"),
        *[mean(m).alias(m if m.endswith("gain") or m == "hit_rate" else f"mean_{m}") for m in MEASURES],
        F.bround(F.avg(F.when(ok, F.col("latency_ms")).cast("decimal(14,6)")).cast("double"), 6).alias("mean_latency_ms"))
