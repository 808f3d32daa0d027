"""Strategy evaluation: stages of a ranking, what each gains, and failures that count but do not score."""

import math

from pyspark.sql import functions as F

from ledgerlens.operators import retrieval, strategies


def ndcg(flags, k):
    gains = [1 / math.log2(i + 2) for i, f in enumerate(flags[:k]) if f]
    return sum(gains) / sum(1 / math.log2(i + 2) for i in range(len(gains))) if gains else 0.0


def scored(spark, lists, truth, *, rewrite=True, passage=False, k=3):
    sections = sorted({s for flags in lists.values() for s in flags})
    rows = [(q, stage, i + 1, f"{s}{i}", 1.0) for (q, stage), flags in lists.items() for i, s in enumerate(flags)]
    chunks = spark.createDataFrame([(f"{s}{i}", s, "r") for s in sections for i in range(12)], "chunk_id string, section string, report_id string")
    truths = spark.createDataFrame(
        [(q, c, None, [s], None) for q, c, s in truth],
        "query_id string, category string, expected_chunk_ids array<string>, expected_sections array<string>, expected_report_ids array<string>")
    totals = truths.select("query_id", F.lit(4).cast("long").alias("total_relevant"))
    frame = spark.createDataFrame(rows, "query_id string, stage string, rank int, chunk_id string, score double")
    corpus = spark.createDataFrame([(100,)], "corpus_size long")
    return strategies.query_scores(frame, chunks, truths, totals, corpus, rewrite=rewrite, passage=passage, k=k)


LISTS = {
    ("q1", "baseline"): "bba", ("q1", "retrieved"): "babaa", ("q1", "reranked"): "aab",
    ("q2", "baseline"): "ab", ("q2", "retrieved"): "bbbb", ("q2", "reranked"): "bb",
}
TRUTH = [("q1", "RISK", "a"), ("q2", "RISK", "a"), ("q3", "TONE", "a")]


def test_gains_are_differences_between_stages(spark):
    rows = {r["query_id"]: r for r in scored(spark, LISTS, TRUTH).collect()}
    for q in ("q1", "q2"):
        of = {s: ndcg([x == "a" for x in LISTS[q, s]], 3) for s in strategies.STAGES}
        assert math.isclose(rows[q]["reranking_gain"], of["reranked"] - of["retrieved"], abs_tol=1e-6)
        assert math.isclose(rows[q]["query_rewriting_gain"], of["retrieved"] - of["baseline"], abs_tol=1e-6)
        assert rows[q]["hyde_gain"] == 0
    assert (rows["q1"]["recall"], rows["q1"]["candidates"], rows["q1"]["candidate_reduction_pct"]) == (0.5, 5, 95.0)
    assert rows["q2"]["mrr"] == 0 and rows["q1"]["mrr"] == 1
    # a query that found nothing scores zero
    assert (rows["q3"]["returned"], rows["q3"]["ndcg"], rows["q3"]["hit_rate"]) == (0, 0, 0)


def test_a_passage_takes_the_gain_of_the_search(spark):
    rows = {r["query_id"]: r for r in scored(spark, LISTS, TRUTH, passage=True).collect()}
    assert rows["q1"]["query_rewriting_gain"] == 0 and rows["q1"]["hyde_gain"] != 0
    plain = scored(spark, LISTS, TRUTH, rewrite=False).filter("query_rewriting_gain <> 0 OR hyde_gain <> 0")
    assert plain.count() == 0


def test_failures_are_counted_and_not_scored(spark):
    scores = scored(spark, LISTS, TRUTH)
    requests = spark.createDataFrame(
        [("q1", "RISK", None, 10.0), ("q2", "RISK", "empty_query", 90.0), ("q3", "TONE", None, 30.0)],
        "query_id string, category string, problem string, latency_ms double")
    run = {r["category"]: r for r in strategies.strategy_run(scores, requests).collect()}
    total = run[None]
    assert (total["is_total"], total["num_queries"], total["failures"], total["mean_latency_ms"]) == (1, 2, 1, 20.0)
    assert total["hit_rate"] == 0.5 and run["RISK"]["num_queries"] == 1 and run["RISK"]["hit_rate"] == 1
    q1 = scores.filter("query_id = 'q1'").first()
    assert run["RISK"]["reranking_gain"] == q1["reranking_gain"]
    untimed = strategies.strategy_run(scores, requests.drop("latency_ms")).filter("is_total = 1").first()
    assert untimed["mean_latency_ms"] is None and untimed["failures"] == 1


def test_stages_of_a_whole_strategy(spark):
    embed = retrieval.hashing_embedder(16)
    texts = ["supply chain risk grows", "revenue guidance raised", "a calm tone of management", "risk factors and breach", "margin and revenue"]
    chunks = spark.createDataFrame(
        [(f"c{i}", t, 5, "r1", "Risk Factors", 2024, 1) for i, t in enumerate(texts)],
        "chunk_id string, chunk_text string, token_count int, report_id string, section string, year int, start_page int").withColumn("embedding", embed(F.col("chunk_text")))
    requests = spark.createDataFrame([("a", "What supply chain risk is there?"), ("b", "revenue and margin")], "query_id string, query string")
    lists = retrieval.staged_results(requests, chunks, embed, strategy="RISK_ANALYSIS").collect()
    assert {r["stage"] for r in lists} == set(strategies.STAGES)
    for q in ("a", "b"):
        for stage in strategies.STAGES:
            own = sorted((r for r in lists if r["query_id"] == q and r["stage"] == stage), key=lambda r: r["rank"])
            assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
            assert [r["score"] for r in own] == sorted((r["score"] for r in own), reverse=True)
    _, detail = retrieval.retrieve_and_assemble(requests, chunks, embed, strategy="RISK_ANALYSIS")
    assert {(r["query_id"], r["chunk_id"], r["score"]) for r in detail.collect()} == {
        (r["query_id"], r["chunk_id"], r["score"]) for r in lists if r["stage"] == "reranked"}
