import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions.grouped import number_rows, running_total
from ledgerlens.operators import benchmark, memo, quality, reads, retrieval, summaries
from ledgerlens.sources import ingest, sinks


def skewed(spark):
    return spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("g"),
        ((F.col("id") * 7919) % 3001).alias("o"), (F.col("id") % 11).alias("v")).withColumn(
            "g", F.when(F.col("o") % 97 == 0, None).otherwise(F.col("g")))


def test_positions_and_totals_of_hot_groups_equal_windows(spark, rows):
    df = skewed(spark)
    order = [F.col("o")]
    assert rows(number_rows(df, ["g"], order, "n"), "g", "o", "n") == rows(number_rows(df, ["g"], order, "n", bounded=True), "g", "o", "n")
    assert rows(running_total(df, ["g"], order, "v", "t"), "g", "o", "t") == rows(running_total(df, ["g"], order, "v", "t", bounded=True), "g", "o", "t")


@pytest.mark.parametrize("tie, want", [("min", [4, 2, 2, 1]), ("dense", [3, 2, 2, 1]), ("average", [4, 2.5, 2.5, 1])])
def test_rank_ties(spark, tie, want):
    df = spark.createDataFrame([("x", "A", 10.), ("x", "B", 20.), ("x", "C", 20.), ("x", "D", 30.), ("x", "E", None)], "p string, k string, value double")
    out = {r["k"]: (r["rank"], r["percentile"]) for r in benchmark.rank_items(df, ["p"], tie=tie).collect()}
    assert [out[k][0] for k in "ABCD"] == want and out["E"] == (None, None)
    assert out["D"][1] == (4 - 1 + .5) / 4 * 100


def test_scores_and_weights(spark):
    df = spark.createDataFrame([("x", 10.), ("x", 20.), ("x", 30.), ("y", 5.), ("y", 5.)], "p string, value double")
    assert sorted(r["score"] for r in benchmark.normalize_scores(df, ["p"]).collect()) == [0, 50, 100, 100, 100]
    down = benchmark.normalize_scores(df.filter("p = 'x'"), ["p"], higher_is_better=False)
    assert {r["value"]: r["score"] for r in down.collect()} == {10.: 100., 20.: 50., 30.: 0.}
    assert benchmark.check_weights({"FINANCIAL": 40, "risk": 60})["financial"] == .4
    for bad in ({"financial": .5}, {"financial": 1.5, "risk": -.5}):
        with pytest.raises(ValueError):
            benchmark.check_weights(bad)


def test_overall_score_skips_missing_dimensions(spark):
    scored = spark.createDataFrame(
        [("x", c, d, "m", s) for c in "ab" for d, s in (("FINANCIAL", 80.), ("RISK", 60.), ("CAPITAL_ALLOCATION", 100.))] + [("x", "a", "TONE", "m", None)],
        "cohort_id string, company_id string, dimension string, metric_name string, score double")
    r = benchmark.summarize_cohorts(scored, bounded=True).collect()
    assert all(abs(x["overall_score"] - (32 + 15 + 20) / .85) < 1e-9 and x["tone_score"] is None and x["rank"] == 1 for x in r)


# --- search --------------------------------------------------------------------------------
def vectors(spark, n=200, dim=6):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=dim)] if i % 10 else [1.0] * dim, f"s{i % 3}", 2020 + i % 4) for i in range(n)]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<double>, section string, year int")


def brute(data, queries, k, ok):
    out = set()
    for qid, q, row in queries:
        scored = []
        for vid, v, sec, year in data:
            if ok(row, sec, year):
                a, b = np.array(q), np.array(v)
                scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), vid))
        out |= {(qid, vid, i + 1) for i, (_, vid) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("block", [20_000, 7])
def test_knn_equals_brute_force_within_and_beyond_one_block(spark, block):
    data, v = vectors(spark)
    q = v.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = retrieval.knn(q, v.repartition(5), 7, query_block=block, vector_block=60).collect()
    want = brute(data, [(d[0], d[1], d) for d in data[:20]], 7, lambda *_: True)
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in got} == want


def test_filtered_knn(spark):
    data, v = vectors(spark)
    q = spark.createDataFrame(
        [(1, data[1][1], ["s0", "s1"], 2021), (2, data[2][1], None, None), (3, data[3][1], [], 2019)],
        "query_id long, vector array<double>, section array<string>, year int")
    got = retrieval.knn(q, v, 5, filters=("section", "year")).collect()
    keep = {1: lambda s, y: s in ("s0", "s1") and y == 2021, 2: lambda s, y: True, 3: lambda s, y: y == 2019}
    want = brute(data, [(i, data[i][1], i) for i in (1, 2, 3)], 5, lambda i, s, y: keep[i](s, y))
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in got} == want
    counts = {r["query_id"]: r["candidates"] for r in retrieval.candidate_counts(q, v, ("section", "year")).collect()}
    assert counts == {i: sum(keep[i](s, y) for _, _, s, y in data) for i in (1, 2, 3)}


def test_retrieval_measures(spark):
    flags = [False, True, False, True]
    judged = spark.createDataFrame([("q", "c", i + 1, f) for i, f in enumerate(flags)], "query_id string, category string, rank int, relevant boolean")
    totals = spark.createDataFrame([("q", 4)], "query_id string, total_relevant long")
    r = retrieval.evaluate(judged, totals, 10).first()
    assert (r["recall"], r["precision"], r["mrr"], r["hit_rate"]) == (.5, .5, .5, 1.0)
    dcg, ideal = 1 / np.log2(3) + 1 / np.log2(5), 1 + 1 / np.log2(3)
    assert r["ndcg"] == round(dcg / ideal, 6)


def test_budget_stops_at_first_overflow(spark, rows):
    r = spark.createDataFrame([("q", "a", .9, 3000, 2024), ("q", "b", .8, 2000, 2024), ("q", "c", .7, 10, 2024)],
                              "query_id string, chunk_id string, score double, token_count int, year int")
    assert rows(retrieval.admit(r, 4000), "chunk_id", "citation_id") == [("a", 1)]


def test_query_understanding(spark):
    q = spark.createDataFrame([("What are revenue and margin trends?",), ("lawsuit and guidance?",), ("hello",)], "q string")
    out = q.select(retrieval.classify_query(F.col("q")).alias("c"), retrieval.sub_queries(F.col("q")).alias("s")).collect()
    assert [tuple(r["c"]) for r in out] == [("FINANCIAL_METRIC", .85), ("MIXED", .7), ("GENERAL", .5)]
    assert out[0]["s"] == ["What are revenue", "margin trends?"]


def test_embedding_provider_batches_isolate_failures(spark):
    df = spark.range(250).select(F.col("id").cast("string").alias("chunk_id"), F.lit("t").alias("chunk_text")).coalesce(1)

    def embed(texts):
        if len(texts) < 100:
            raise RuntimeError("short batch")
        return [[1.0]] * len(texts)

    out = retrieval.embed_batches(df, embed)
    assert out.filter("error is null").count() == 200 and out.filter("embedding is null").count() == 50


def test_trailing_counts_equal_brute_force(spark):
    data = [(i, "u" if i % 3 else "v", (i * i * 37) % 5000) for i in range(400)]
    df = spark.createDataFrame(data, "id long, u string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["in_window"] for r in summaries.trailing_counts(df, "u", "ts", seconds=60, limit=2).collect()}
    assert got == {i: sum(1 for _, u2, s2 in data if u2 == u and s - 60 < s2 <= s) for i, u, s in data}


# --- memo, sources, sinks --------------------------------------------------------------------
def test_grounding_band(spark):
    texts = spark.createDataFrame([("a", "Sales 1,020 and 55% in 2024; 7 items, 9999 lost"), ("b", "300 301 302 303 304")], "memo_id string, body string")
    allowed = spark.createDataFrame([("a", 1000.), ("a", 55.9)], "memo_id string, value double")
    out = {r["memo_id"]: (r["ungrounded"], r["failed"]) for r in memo.check_grounding(texts, allowed).collect()}
    assert out == {"a": (1, False), "b": (5, True)}


def test_file_acceptance_gives_the_first_reason(spark):
    rows_ = [("", "application/pdf", 10, "%PDF-"), ("a.txt", None, 0, ""), ("a.pdf", "text/html", 1, "%PDF-"), ("a.PDF", None, 0, "%PDF-"),
             ("a.pdf", None, vocab.MAX_FILE_BYTES + 1, "%PDF-"), ("a.pdf", None, 9, "<html"), ("a.pdf", "application/pdf", 9, "%PDF-1")]
    df = spark.createDataFrame(rows_, "filename string, content_type string, length bigint, head string")
    assert [r["reason"] for r in ingest.accept_files(df).collect()] == [
        "missing_filename", "unsupported_extension", "unsupported_content_type", "empty_file", "file_too_large", "not_a_pdf", None]


def test_file_acceptance_of_pages_too_long_for_an_int(spark, rows, tmp_path):
    from ledgerlens import plans

    pages = [(6, "u", "x" * 107_374), (36, "u", "x" * 107_375), (96, "u", "x" * 250_000), (16, "u", "x" * 250_000), (81, "u", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = plans.QUERIES["file_acceptance"](spark, str(tmp_path))
    assert dict(out.dtypes) == {"page_id": "bigint", "reason": "string"}
    assert rows(out, "page_id", "reason") == [(16, None), (36, "file_too_large"), (6, "file_too_large"), (81, "not_a_pdf"), (96, "file_too_large")]


def test_external_candidates(spark):
    raw = spark.createDataFrame([
        ("c", "r1", "k1", 0, "MD&A", "text", 2024, None, '[{"metric_name": "net sales", "value": 12, "unit": "Millions.", "currency": "$", "period": "Q2 2021", "confidence": 7}, {"metric_name": "?", "value": 1}]'),
        ("c", "r2", "k2", 0, "MD&A", "text", 2024, None, "oops")],
        "company_id string, report_id string, chunk_id string, chunk_index int, section string, chunk_text string, fiscal_year int, fiscal_quarter int, response string")
    out = ingest.metric_candidates(raw).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["normalized_metric_name"], int(r["value"]), r["unit"], r["currency"], r["fiscal_year"], r["fiscal_quarter"], r["raw_confidence"]) == (
        "REVENUE", 12_000_000, "MILLION", "USD", 2021, 2, 1.0)


def test_replace_is_idempotent(spark, rows):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "report_id string, x int")
    new = spark.createDataFrame([("a", 9)], "report_id string, x int")
    once = sinks.replace_by_key(old, new)
    assert rows(once, "report_id", "x") == rows(sinks.replace_by_key(once, new), "report_id", "x") == [("a", 9), ("b", 3)]


def test_replace_evolution_conditions(spark, rows):
    ev = "current_risk_id string, previous_risk_id string, tag string"
    old = spark.createDataFrame([("n1", "p1", "drop"), ("x", "n1", "drop"), (None, "p2", "drop"), ("y", "p2", "keep"), (None, "q", "keep")], ev)
    new = spark.createDataFrame([("n1", None, "new")], ev)
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    out = sinks.replace_evolution(old, new, ids("n1"), ids("p1", "p2"))
    assert rows(out, "tag") == [("keep",), ("keep",), ("new",)]


def test_bucketed_write_replaces_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.range(100).select(F.col("id").cast("string").alias("report_id"), F.lit(1).alias("x"))
    sinks.write_bucketed(first, path, buckets=8)
    bucket = F.pmod(F.xxhash64("report_id"), F.lit(8))
    again = spark.read.parquet(path).drop("bucket").filter(bucket == 3).withColumn("x", F.lit(2))
    sinks.write_bucketed(again, path, buckets=8)
    got = spark.read.parquet(path)
    assert got.count() == 100 and got.filter("x = 2").count() == got.filter("bucket = 3").count() > 0


def test_stage_gate_and_progress(spark):
    r = spark.createDataFrame([("CHUNKED", "FAILED"), (None, "FAILED"), ("odd", "READY"), ("READY", "TONE")], "completed_stage string, status string")
    assert sinks.gate_stage(r, "EMBEDDED").count() == 3
    assert [x[0] for x in r.select(reads.progress(F.col("status"), F.col("completed_stage"))).collect()] == [40, 0, 100, 92]


def test_phrase_flags(spark):
    df = spark.createDataFrame([("Rating : SELL now",), ("a strong  buyer",), ("strong buy",)], "t string")
    assert [len(r[0]) for r in df.select(quality.phrase_flags(F.col("t"), vocab.PROHIBITED_PHRASES)).collect()] == [1, 0, 1]


def test_display_values(spark):
    from decimal import Decimal as D
    df = spark.createDataFrame([(D("1250000000"), None, None), (D("96.70"), "BILLION", "EUR"), (D("-1500"), None, "USD"), (None, None, None)],
                               "v decimal(22,6), u string, c string")
    shown = [r[0] for r in df.select(reads.display_amount(F.col("v"), F.col("u"), F.col("c"))).collect()]
    assert shown == ["$1.25B", "EUR 96.7B", "$-1.5K", "—"]


def test_reports_are_joined_only_where_a_filter_needs_them(spark):
    v = spark.createDataFrame([(i, f"r{i % 4}" if i else None, "s0") for i in range(12)], "vec_id long, report_id string, section string")
    reports = spark.createDataFrame(
        [("r0", "c1", 2020, None), ("r1", "c1", 2021, 1), ("r2", "c2", 2020, 2), ("r3", "c2", None, 3)],
        "report_id string, company_id string, year int, quarter int")
    q = spark.createDataFrame([(1, [1.0], 2020, "c1"), (2, [1.0], 2020, None)], "query_id long, vector array<double>, year int, company_id string")
    assert retrieval.report_base(q, v, reports, ("section",)) is v
    joined = retrieval.report_base(q, v, reports, ("section", "year", "company_id"))
    assert joined.columns == ["report_id", "vec_id", "section", "year", "company_id"]
    # the second question takes any company of 2020; vectors of 2021 and without a year or a report go
    assert sorted(r["vec_id"] for r in joined.collect()) == [2, 4, 6, 8, 10]
    one = retrieval.report_base(q.filter("query_id = 1"), v, reports, ("year", "company_id"))
    assert sorted(r["vec_id"] for r in one.collect()) == [4, 8]
    open_ = retrieval.report_base(q.drop("year", "company_id"), v, reports, ("quarter",))
    assert open_.count() == 11
    assert retrieval.report_base(q.limit(0), v, reports, ("year",)).count() == 0


def test_lists_by_several_keys_have_nulls_last(spark):
    from ledgerlens.operators import reads

    df = spark.createDataFrame([("a", 2020, None, 1), ("a", 2020, 4, 2), ("a", None, 1, 3), ("a", 2019, None, 4), ("a", 2020, 4, 5), ("b", 1, 1, 6)],
                               "who string, year int, quarter int, id int")
    for bounded in (True, False):
        got = reads.listed(df, ["who"], ["year", "quarter"], tie="id", bounded=bounded).collect()
        assert {r["id"]: r["place"] for r in got} == {4: 1, 2: 2, 5: 3, 1: 4, 3: 5, 6: 1}


def test_every_document_finds_a_report_of_a_company(spark, sf):
    from ledgerlens.sources import derive

    documents, held = derive.table(spark, sf, "documents"), derive.company_chunks(spark, sf)
    assert held.count() == documents.count() == held.select("doc_id").distinct().count()
    assert held.join(derive.reports(spark, sf), ["report_id", "company_id"]).count() == held.count()


def test_knn_leaves_out_own_vectors_and_rows_without_id_or_vector(spark):
    data, v = vectors(spark)
    odd = v.unionByName(v.filter("vec_id = 3")).unionByName(v.limit(1).withColumn("vec_id", F.lit(None).cast("long"))).unionByName(
        v.limit(1).withColumn("vec_id", F.lit(-1).cast("long")).withColumn("embedding", F.lit(None).cast(dict(v.dtypes)["embedding"])))
    q = v.filter("vec_id < 6").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("made_from"))
    q = q.unionByName(q.limit(1).withColumn("query_id", F.lit(99).cast("long")).withColumn("vector", F.lit(None).cast(dict(q.dtypes)["vector"])))
    got = retrieval.knn(q, odd, 4, own="made_from", query_block=3, vector_block=50).collect()
    want = set()
    for qid, a, *_ in data[:6]:
        a, scored = np.array(a), []
        for vid, b, *_ in [*data, data[3]]:
            if vid != qid:
                b = np.array(b)
                scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), vid))
        want |= {(qid, vid, i + 1) for i, (_, vid) in enumerate(sorted(scored)[:4])}
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in got} == want and len(got) == 24


def test_knn_of_no_queries_no_vectors_and_text_ids(spark):
    _, v = vectors(spark)
    q = v.limit(3).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert retrieval.knn(q.limit(0), v, 3).count() == 0
    assert retrieval.knn(q, v.limit(0), 3).count() == 0
    named = v.withColumn("vec_id", F.concat(F.lit("chunk-"), F.col("vec_id")))
    asked = q.withColumn("query_id", F.concat(F.lit("q"), F.col("query_id")))
    got = {(r["query_id"][1:], r["vec_id"][6:]) for r in retrieval.knn(asked, named, 1).collect()}
    assert got == {(str(r["query_id"]),) * 2 for r in q.collect()}


def test_knn_sends_one_plan_at_every_size(spark):
    """Queries reach the tasks by the same exchange, in one block or many, and equal scores rank by id."""
    v = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(90)], "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    plans, answers = [], []
    for block in (20_000, 10):
        out = retrieval.knn(q, v, 4, query_block=block, vector_block=30)
        plans.append([line.split("(")[0] for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "MapInArrow" in line or "Repartition" in line])
        answers.append({(r["query_id"], r["vec_id"], r["rank"]) for r in out.collect()})
    assert len(plans[0]) == len(plans[1]) == 2
    assert answers[0] == answers[1] == {(i, i % 3 + 3 * j, j + 1) for i in range(90) for j in range(4)}


def test_trailing_counts_of_a_burst_of_one_user_ties_and_missing_values(spark):
    rng = np.random.default_rng(5)
    times = [int(t) for t in rng.integers(0, 40, 400)] + [0, 60, 60, 61]  # one user, many ties, exact borders
    data = [(i, "hot", t) for i, t in enumerate(times)] + [(1000, None, 5), (1001, None, 5), (1002, "b", None), (1003, "b", 7)]
    df = spark.createDataFrame(data, "id long, u string, t long").withColumn("ts", F.timestamp_seconds("t")).repartition(6)
    out = summaries.trailing_counts(df, "u", "ts", seconds=60, limit=2)
    got = {r["id"]: (r["in_window"], r["limited"]) for r in out.collect()}
    want = {i: 0 if t is None else sum(v == u and x is not None and t - 60 < x <= t for _, v, x in data) for i, u, t in data}
    assert got == {i: (n, n > 2) for i, n in want.items()}
    assert summaries.trailing_counts(df.limit(0), "u", "ts", seconds=60, limit=2).count() == 0
    # no window is partitioned by the user alone: totals run within a range partition
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Window [" in line and "_part" not in line]


def test_contexts_for_every_conversation(spark, sf):
    from ledgerlens.plans import search

    want = {r[0] for r in search._asked(spark, sf).select(F.sha2("query", 256)).collect()}
    got = [r["query_id"] for r in search.general_context(spark, sf).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("name", ["general_context", "assembled_context"])
def test_no_conversation_is_left_out_of_the_contexts(spark, tmp_path, name):
    from ledgerlens import plans
    from ledgerlens.plans import search

    said = [(c, t, "user", f"words {c} and {t}") for c in (0, 1, 99, 100, 101, None) for t in (0, 1)] + [(7, 0, None, None), (14, 7, "user", None)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    filed = [(i, f"Filing {i} on supply risk and revenue.", "en", "web", 30) for i in range(60)]
    spark.createDataFrame(filed, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {r["query"] for r in search._asked(spark, str(tmp_path)).collect()}
    assert len(want) == 13  # the two rows without a text ask the same
    got = [r["query_id"] for r in plans.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(hashlib.sha256(q.encode()).hexdigest() for q in want)
