"""Registered queries over vectors, requests, contexts and retrieval quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions import text
from ledgerlens.functions.grouped import number_rows
from ledgerlens.operators import chunks, retrieval, strategies
from ledgerlens.plans import sql as S
from ledgerlens.plans.registry import query
from ledgerlens.session import cut_lineage
from ledgerlens.sources import derive

_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"
S.TABLES["knn_t"] = f"""
SELECT query_id, vec_id, score, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn
  FROM (SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score FROM vectors_t q CROSS JOIN vectors_t v)) WHERE rn <= 10"""


def _queries(v):
    return v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _knn(spark, sf):
    v = derive.vectors(spark, sf)
    return retrieval.knn(_queries(v), v, 10)


@query("vector_search", S.with_tables("SELECT * FROM knn_t"))
def vector_search(spark, sf):
    return _knn(spark, sf)


_PROFILES = [vocab.PROFILES[p] for p in ("GENERAL", "RISK_ANALYSIS", "FINANCIAL_STATEMENTS", "GUIDANCE")]
_SETS = "[" + ", ".join(f"CAST({S.items(p)} AS VARCHAR[])" if p else "CAST([] AS VARCHAR[])" for p in _PROFILES) + "]"
S.TABLES["requests_t"] = f"""
SELECT vec_id AS query_id, embedding, CASE WHEN vec_id % 3 = 0 THEN CAST(2020 + vec_id % 5 AS INTEGER) END AS want_year,
       {_SETS}[CAST(vec_id % 4 AS INTEGER) + 1] AS want_sections FROM embeddings"""
_PASS = "(want_year IS NULL OR want_year = v.year) AND (len(want_sections) = 0 OR list_contains(want_sections, v.section))"


def _requests(spark, sf):
    i = F.col("vec_id")
    sets = F.array(*[F.array(*[F.lit(s) for s in p]).cast("array<string>") for p in _PROFILES])
    return derive.table(spark, sf, "embeddings").select(
        i.alias("query_id"), F.col("embedding").alias("vector"),
        F.when(i % 3 == 0, (F.lit(2020) + i % 5).cast("int")).alias("year"),
        F.element_at(sets, (i % 4 + 1).cast("int")).alias("section"))


@query("filtered_vector_search", S.with_tables(f"""
SELECT query_id, vec_id, score, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn
  FROM (SELECT q.query_id, v.vec_id, {_COS} AS score FROM requests_t q JOIN vectors_t v ON {_PASS})) WHERE rn <= 10"""))
def filtered_vector_search(spark, sf):
    return retrieval.knn(_requests(spark, sf), derive.vectors(spark, sf), 10, filters=("year", "section"))


# year and type belong to the report; two years are asked for, a third of the questions names a type
S.TABLES["filed_t"] = f"SELECT DISTINCT report_id, year, {S.pick(vocab.REPORT_TYPES, 'vec_id // 20')} AS report_type FROM vectors_t"


@query("report_filtered_search", S.with_tables(f"""
SELECT query_id, vec_id, score, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn
  FROM (SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score FROM embeddings q
        JOIN (vectors_t v JOIN filed_t r USING (report_id)) ON r.year = 2020 + q.vec_id % 2 AND (q.vec_id % 3 <> 0 OR r.report_type = '10-K'))) WHERE rn <= 10"""))
def report_filtered_search(spark, sf):
    v, i = derive.vectors(spark, sf), F.col("vec_id")
    filed = v.select("report_id", "year", derive.pick(vocab.REPORT_TYPES, F.floor(i / 20)).alias("report_type")).distinct()
    asked = _queries(v).withColumn("year", (F.lit(2020) + F.col("query_id") % 2).cast("int")).withColumn(
        "report_type", F.when(F.col("query_id") % 3 == 0, F.lit("10-K")))
    filters = ("year", "report_type")
    return retrieval.knn(asked, retrieval.report_base(asked, v.drop("year"), filed, filters), 10, filters=filters)


@query("candidate_counts", S.with_tables(f"""
SELECT q.query_id, count(v.vec_id) AS candidates, round_even(greatest(0, 1 - count(v.vec_id) / (SELECT count(*) FROM vectors_t)) * 100, 2) AS reduction_pct
FROM requests_t q LEFT JOIN vectors_t v ON {_PASS} GROUP BY 1"""))
def candidate_counts(spark, sf):
    return retrieval.candidate_counts(_requests(spark, sf), derive.vectors(spark, sf), ("year", "section"))


@query("fused_results", S.with_tables("""
SELECT query_id // 2 AS query_id, vec_id AS chunk_id, max(score) AS score FROM knn_t GROUP BY 1, 2"""))
def fused_results(spark, sf):
    r = _knn(spark, sf).select(F.floor(F.col("query_id") / 2).alias("query_id"), F.col("vec_id").alias("chunk_id"), "score")
    return retrieval.fuse(r)


# a judged question is made from a stored vector, which it must not find
S.TABLES["unowned_t"] = f"""
SELECT query_id, vec_id, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn
  FROM (SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score FROM vectors_t q JOIN vectors_t v ON v.vec_id <> q.vec_id)) WHERE rn <= 10"""
S.TABLES["judged_t"] = """
SELECT k.query_id, k.rank, q.section AS category, v.section = q.section AS relevant FROM unowned_t k
JOIN vectors_t v ON v.vec_id = k.vec_id JOIN vectors_t q ON q.vec_id = k.query_id"""
S.TABLES["quality_t"] = """
SELECT j.query_id, category, returned, total_relevant, CASE WHEN total_relevant > 0 THEN round_even(hits / total_relevant, 6) ELSE 0.0::DOUBLE END AS recall, round_even(hits / returned, 6) AS precision,
       round_even(coalesce(1.0::DOUBLE / first_hit, 0), 6) AS mrr, CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_rate,
       round_even(CASE WHEN hits > 0 THEN dcg / list_sum(list_transform(range(1, hits + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) ELSE 0.0::DOUBLE END, 6) AS ndcg
FROM (SELECT query_id, category, count(*) AS returned, count(*) FILTER (relevant) AS hits, min(rank) FILTER (relevant) AS first_hit,
             sum(1.0::DOUBLE / log2(rank + 1)) FILTER (relevant) AS dcg FROM judged_t GROUP BY 1, 2) j
JOIN (SELECT section, count(*) - 1 AS total_relevant FROM vectors_t GROUP BY 1) t ON t.section = category"""


def _quality(spark, sf):
    v = derive.vectors(spark, sf)
    strings = F.lit(None).cast("array<string>")
    truth = v.select(
        F.col("vec_id").alias("query_id"), F.col("section").alias("category"), strings.alias("expected_chunk_ids"),
        F.array("section").alias("expected_sections"), strings.alias("expected_report_ids"))
    asked = _queries(v).withColumn("made_from", F.col("query_id"))
    results = retrieval.knn(asked, v, 10, own="made_from").join(v.select("vec_id", "section", "report_id"), "vec_id").withColumn(
        "chunk_id", F.col("vec_id").cast("string"))
    totals = retrieval.total_relevant(truth, v).withColumn("total_relevant", F.col("total_relevant") - 1)
    return retrieval.evaluate(retrieval.judge(results, truth), totals, 10)


@query("retrieval_quality", S.with_tables("SELECT * FROM quality_t"))
def retrieval_quality(spark, sf):
    return _quality(spark, sf)


_MEAN = "round_even(CAST(avg(CAST({c} AS DECIMAL(12,6))) AS DOUBLE), 6)"


@query("retrieval_run", S.with_tables(f"""
SELECT category, CAST(grouping(category) AS INTEGER) AS is_total, count(*) AS num_queries, {_MEAN.format(c="recall")} AS mean_recall, {_MEAN.format(c="precision")} AS mean_precision,
       {_MEAN.format(c="mrr")} AS mean_mrr, {_MEAN.format(c="hit_rate")} AS hit_rate, {_MEAN.format(c="ndcg")} AS mean_ndcg
FROM quality_t GROUP BY GROUPING SETS ((), (category))"""))
def retrieval_run(spark, sf):
    return retrieval.aggregate_run(_quality(spark, sf))


@query("latest_evaluation_runs", """
SELECT event_type AS retrieval_type, max_by(event_id, ts) AS run_id, max_by(value, ts) AS mean_recall FROM events WHERE value IS NOT NULL GROUP BY 1""")
def latest_evaluation_runs(spark, sf):
    runs = derive.table(spark, sf, "events").filter("value is not null").select(
        F.col("event_type").alias("retrieval_type"), F.col("event_id").alias("run_id"), "ts", F.col("value").alias("mean_recall"))
    return retrieval.latest_runs(runs).select("retrieval_type", "run_id", "mean_recall")


@query("strategy_deltas", """
WITH l AS (SELECT event_type AS k, max_by(value, ts) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT round_even(max(v) FILTER (k = 'view') - max(v) FILTER (k = 'click'), 6) AS delta_mean_recall FROM l""")
def strategy_deltas(spark, sf):
    v = F.col("value")
    runs = derive.table(spark, sf, "events").filter("value is not null").select(
        F.col("event_type").alias("retrieval_type"), F.col("event_id").alias("run_id"), "ts",
        *[v.alias(f"mean_{m}") for m in ("recall", "precision", "mrr", "ndcg")])
    return retrieval.compare_runs(runs, "click", "view").select("delta_mean_recall")


# --- vectors ----------------------------------------------------------------------------------
@query("unit_vectors", """
SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: (x / n) * (x / n))), 6) AS unit, round((embedding[1]::DOUBLE) / n, 6) AS first_value
FROM (SELECT *, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)""")
def unit_vectors(spark, sf):
    u = derive.table(spark, sf, "embeddings").withColumn("u", retrieval.l2_normalize(F.col("embedding")))
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)
    return u.select("vec_id", F.round(total, 6).alias("unit"), F.round(F.col("u")[0], 6).alias("first_value"))


@query("embedding_problems", """
SELECT vec_id, CASE vec_id % 6 WHEN 0 THEN 'null_embedding' WHEN 1 THEN 'empty_vector' WHEN 2 THEN 'wrong_dimension: 8 != 64' WHEN 3 THEN 'zero_vector'
       WHEN 4 THEN 'duplicate_generation' ELSE '' END AS fatal FROM embeddings""")
def embedding_problems(spark, sf):
    e = derive.table(spark, sf, "embeddings")
    k, v = F.col("vec_id") % 6, F.col("embedding")
    broken = (
        F.when(k == 0, F.lit(None)).when(k == 1, F.slice(v, 1, 0)).when(k == 2, F.slice(v, 1, 8))
        .when(k == 3, F.transform(v, lambda x: x * 0)).otherwise(v))
    status = F.when(k == 4, F.lit("COMPLETED")).otherwise(F.lit("PENDING"))
    return e.select("vec_id", F.array_join(retrieval.embedding_issues(broken, 64, status), ",").alias("fatal"))


_STATUS = ["COMPLETED", "COMPLETED", "PENDING", "FAILED", "PROCESSING"]
S.TABLES["stored_t"] = f"""
SELECT *, {S.pick(_STATUS, "vec_id")} AS embedding_status, CASE WHEN vec_id % 5 < 2 THEN embedding END AS stored, CAST(50 + vec_id % 700 AS INTEGER) AS token_count FROM vectors_t"""


def _stored(spark, sf):
    i = F.col("vec_id")
    return derive.vectors(spark, sf).select(
        "vec_id", "report_id", "section", derive.pick(_STATUS, i).alias("embedding_status"),
        F.when(i % 5 < 2, F.col("embedding")).alias("embedding"), (F.lit(50) + i % 700).cast("int").alias("token_count"))


@query("embedding_progress", S.with_tables("""
SELECT report_id, count(*) AS total_chunks, count(*) FILTER (embedding_status = 'PENDING') AS pending, count(*) FILTER (embedding_status = 'PROCESSING') AS processing,
       count(*) FILTER (embedding_status = 'COMPLETED') AS completed, count(*) FILTER (embedding_status = 'FAILED') AS failed, count(stored) AS embedded_chunks,
       count(*) - count(stored) AS missing_chunks, round_even(count(stored) * 100 / count(*), 1) AS coverage_pct, count(stored) = count(*) AS fully_embedded,
       count(stored) > 0 AS retrieval_ready FROM stored_t GROUP BY 1"""))
def embedding_progress(spark, sf):
    return chunks.embedding_progress(_stored(spark, sf))


@query("embedding_cost", S.with_tables("""
SELECT report_id, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, CAST(ceil(count(*) / 100) AS BIGINT) AS batches,
       round_even(CAST(sum(token_count) AS DOUBLE) / 1000000 * 0.15, 6) AS cost_usd FROM stored_t WHERE stored IS NULL GROUP BY 1"""))
def embedding_cost(spark, sf):
    return chunks.embedding_cost(_stored(spark, sf))


@query("embedding_batches", S.with_tables(f"""
SELECT section, batch, count(*) AS items FROM (SELECT section, (row_number() OVER (PARTITION BY section ORDER BY vec_id) - 1) // {vocab.EMBED_BATCH} AS batch FROM stored_t WHERE stored IS NULL) GROUP BY 1, 2"""))
def embedding_batches(spark, sf):
    todo = _stored(spark, sf).filter("embedding is null").select("section", "vec_id")
    numbered = number_rows(todo, ["section"], [F.col("vec_id")], "n")
    return numbered.groupBy("section", F.floor((F.col("n") - 1) / vocab.EMBED_BATCH).alias("batch")).agg(F.count(F.lit(1)).alias("items"))


@query("hashed_vectors")
def hashed_vectors(spark, sf):
    d = derive.table(spark, sf, "documents")
    v = d.select("doc_id", retrieval.hashing_embedder(64)(F.col("text")).alias("h"), retrieval.content_vector(64)(F.col("text")).alias("c"))
    return v.select("doc_id", F.round(retrieval.norm(F.col("h")), 6).alias("hash_norm"), F.round(retrieval.norm(F.col("c")), 6).alias("content_norm"))


# --- requests ------------------------------------------------------------------------------------
_ASK = [
    "What is the revenue guidance and outlook?", "Which supply chain risk may hurt?", "How did management tone change?",
    "Give a company overview.", "Is there a breach or lawsuit?", "Hello there.", "What did the CEO say on margins?"]
_ASKED = f"(SELECT conv_id, turn, {S.pick(_ASK, 'conv_id + turn')} || ' ' || text AS query FROM conversations)"


def _asked(spark, sf):
    c = derive.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.concat_ws(
        " ", derive.pick(_ASK, F.col("conv_id") + F.col("turn")), F.col("text")).alias("query"))


def _hits(words, weight):
    return "(" + " + ".join(f"CAST(contains(lower(query), {S.text(w)}) AS INTEGER)" for w in words) + f") * {weight}"


_NAMES = list(vocab.QUERY_KEYWORDS)
S.TABLES["classified_t"] = f"""
SELECT *, CASE WHEN active >= 2 THEN 'MIXED' WHEN greatest({", ".join("s" + str(i) for i in range(5))}) = 0 THEN 'GENERAL' ELSE
  {S.items(_NAMES)}[list_position([{", ".join("s" + str(i) for i in range(5))}], greatest({", ".join("s" + str(i) for i in range(5))}))] END AS query_class
FROM (SELECT *, {" + ".join(f"CAST(s{i} > 1 AS INTEGER)" for i in range(5))} AS active FROM (
  SELECT *, {", ".join(f"{_hits(vocab.QUERY_KEYWORDS[n], 1 if n == 'GENERAL' else 2)} AS s{i}" for i, n in enumerate(_NAMES))} FROM {_ASKED}))"""


@query("query_classes", S.with_tables("SELECT conv_id, turn, query_class FROM classified_t"))
def query_classes(spark, sf):
    a = _asked(spark, sf)
    return a.select("conv_id", "turn", retrieval.classify_query(F.col("query"))["query_class"].alias("query_class"))


_TERMS = "CASE query_class " + " ".join(
    f"WHEN '{k}' THEN {S.items(v)}" for k, v in vocab.QUERY_EXPANSIONS.items() if k != "GENERAL"
) + f" ELSE {S.items(vocab.QUERY_EXPANSIONS['GENERAL'])} END"
_EDGE = "[?,.!:;\"'']+"
_KW = (f"list_filter(list_transform(list_filter(string_split_regex(query, '{S.WS}+'), lambda w: length(w) > 0), lambda w: regexp_replace(w, '^{_EDGE}|{_EDGE}$', '', 'g')), "
       f"lambda w: length(w) > 2 AND lower(w) NOT IN {S.in_list(vocab.QUERY_STOP_WORDS)})")


@query("query_rewrites", S.with_tables(f"""
SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_transform(list_distinct(words), lambda w: {{'p': list_position(words, w), 'w': w}})), lambda s: s.w), ' ') AS rewritten,
       array_to_string(CASE WHEN contains(lower(query), ' and ') THEN list_transform(string_split(query, ' and '), lambda p: {S.strip("p")})
            WHEN contains(lower(query), ' or ') THEN list_transform(string_split(query, ' or '), lambda p: {S.strip("p")}) ELSE [{S.strip("query")}] END, ' / ') AS parts
FROM (SELECT *, list_concat({_KW}, {_TERMS}) AS words FROM classified_t)"""))
def query_rewrites(spark, sf):
    q = F.col("query")
    a = _asked(spark, sf).withColumn("_c", retrieval.classify_query(q)["query_class"])
    return a.select(
        "conv_id", "turn", retrieval.rewrite_query(q, F.col("_c")).alias("rewritten"),
        F.array_join(retrieval.sub_queries(q), " / ").alias("parts"))


@query("hypothetical_passages", f"""
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(query), 'supply chain|risk|concerns') THEN {S.text(vocab.PASSAGES["risk"])}
  WHEN regexp_matches(lower(query), 'margin|revenue|profit') THEN {S.text(vocab.PASSAGES["financial"])} WHEN regexp_matches(lower(query), 'sentiment|tone|management') THEN {S.text(vocab.PASSAGES["tone"])}
  ELSE 'Regarding the query ''' || query || ''', ' || {S.text(vocab.PASSAGES["other"])} END AS passage FROM {_ASKED}""")
def hypothetical_passages(spark, sf):
    return _asked(spark, sf).select("conv_id", "turn", retrieval.hypothetical_passage(F.col("query")).alias("passage"))


def _set(c):
    return f"list_distinct(list_filter(string_split_regex(lower({c}), '{S.WS}+'), lambda w: length(w) > 0))"


def _dealt(left, a, right, b):
    """Both sides joined by their ids modulo the lower count of ids, so that every row of either is read."""
    n = left.agg(F.max(a).alias("x")).unionByName(right.agg(F.max(b).alias("x"))).agg(F.min("x") + 1)
    return left.withColumn("_slot", F.pmod(a, n.scalar())).join(right.withColumn("_slot", F.pmod(b, n.scalar())), "_slot").drop("_slot")


_DEALT = "{a} % {n} = {b} % {n}"
_FEWER = "(SELECT least((SELECT max(conv_id) FROM conversations), (SELECT max(doc_id) FROM documents)) + 1)"


@query("lexical_rerank", f"""
SELECT conv_id, turn, doc_id, CAST(floor(d) + CASE WHEN d - floor(d) > 0.5 OR (d - floor(d) = 0.5 AND floor(d) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 10000.0::DOUBLE AS text_score
FROM (SELECT *, CAST(CAST(CASE WHEN a + b > s THEN least(1.0::DOUBLE, s / (a + b - s) + least(s * 0.05::DOUBLE, 0.5::DOUBLE)) ELSE 0.0::DOUBLE END AS VARCHAR) AS DECIMAL(20,18)) * 10000 AS d
FROM (SELECT conv_id, turn, doc_id, len(list_intersect(qw, dw)) AS s, len(qw) AS a, len(dw) AS b
      FROM (SELECT conv_id, turn, doc_id, {_set("c.text")} AS qw, {_set("d.text")} AS dw FROM conversations c JOIN documents d ON {_DEALT.format(a="conv_id", b="doc_id", n=_FEWER)})))""")  # rounded by the digits of the double, as its text shows them
def lexical_rerank(spark, sf):
    c = derive.table(spark, sf, "conversations").withColumnRenamed("text", "query")
    d = derive.table(spark, sf, "documents").select("doc_id", "text")
    j = _dealt(c, "conv_id", d, "doc_id")
    return j.select("conv_id", "turn", "doc_id", retrieval.lexical_score(F.col("query"), F.col("text")).alias("text_score"))


# --- strategies --------------------------------------------------------------------------------
# A strategy that asks the vectors of a pair for both of its members, and reranks by the words of section, report and year.
_ABOUT = "section || ' ' || report_id || ' ' || year"
S.TABLES["others_t"] = "SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM knn_t WHERE vec_id <> query_id"
S.TABLES["merged_t"] = """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT v.vec_id AS query_id, k.vec_id, max(k.score) AS score FROM vectors_t v JOIN knn_t k ON k.query_id // 2 = v.vec_id // 2 WHERE k.vec_id <> v.vec_id GROUP BY 1, 2)"""
S.TABLES["about_t"] = f"SELECT vec_id, section, {_ABOUT} AS about FROM vectors_t"
S.TABLES["blended_t"] = f"""
SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS rank FROM (
  SELECT query_id, vec_id, round_even(0.3::DOUBLE * score + 0.7::DOUBLE * round_even(least(1.0::DOUBLE, s / (a + b - s) + least(s * 0.05::DOUBLE, 0.5::DOUBLE)), 4), 6) AS score
  FROM (SELECT m.query_id, m.vec_id, m.score, len(list_intersect(qw, dw)) AS s, len(qw) AS a, len(dw) AS b
        FROM merged_t m JOIN (SELECT vec_id AS query_id, {_set("about")} AS qw FROM about_t) USING (query_id) JOIN (SELECT vec_id, {_set("about")} AS dw FROM about_t) USING (vec_id)))) WHERE rank <= 8"""
_STAGE = """SELECT l.query_id, '{stage}' AS stage, l.rank, v.section = q.section AS relevant FROM {table} l JOIN about_t v ON v.vec_id = l.vec_id JOIN about_t q ON q.vec_id = l.query_id"""
S.TABLES["staged_t"] = " UNION ALL ".join(_STAGE.format(stage=s, table=t) for s, t in zip(strategies.STAGES, ("others_t", "merged_t", "blended_t"), strict=True))
_NDCG = ("CASE WHEN h_{s} > 0 THEN round_even(d_{s}, 9) / list_sum(list_transform(range(1, h_{s} + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) ELSE 0.0::DOUBLE END")
_B, _F, _R = (_NDCG.format(s=s) for s in strategies.STAGES)
S.TABLES["stage_scores_t"] = f"""
SELECT t.query_id, t.category, coalesce(returned, 0) AS returned, total_relevant, coalesce(candidates, 0) AS candidates,
  round_even(coalesce(h_reranked, 0) / total_relevant, 6) AS recall, round_even(CASE WHEN returned > 0 THEN h_reranked / returned ELSE 0.0::DOUBLE END, 6) AS precision,
  round_even(coalesce(1.0::DOUBLE / first_hit, 0), 6) AS mrr, CASE WHEN h_reranked > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_rate, round_even({_R}, 6) AS ndcg,
  round_even(greatest(0.0::DOUBLE, 1 - coalesce(candidates, 0) / n) * 100, 2) AS candidate_reduction_pct,
  round_even({_R} - {_F}, 6) AS reranking_gain, round_even({_F} - {_B}, 6) AS query_rewriting_gain, 0.0::DOUBLE AS hyde_gain
FROM (SELECT CAST(vec_id AS VARCHAR) AS query_id, vec_id, section AS category FROM vectors_t) t
LEFT JOIN (SELECT query_id AS vec_id, count(*) FILTER (stage = 'reranked' AND rank <= 5) AS returned, count(*) FILTER (stage = 'retrieved') AS candidates,
  min(rank) FILTER (stage = 'reranked' AND relevant) AS first_hit,
  {", ".join(f"count(*) FILTER (stage = '{s}' AND relevant AND rank <= 5) AS h_{s}, coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (stage = '{s}' AND relevant AND rank <= 5), 0) AS d_{s}" for s in strategies.STAGES)}
  FROM staged_t GROUP BY 1) USING (vec_id)
JOIN (SELECT section AS category, count(*) AS total_relevant FROM vectors_t GROUP BY 1) USING (category), (SELECT count(*) AS n FROM vectors_t)"""


def _stage_scores(spark, sf):
    v = derive.vectors(spark, sf)
    words = F.concat_ws(" ", "section", "report_id", F.col("year").cast("string"))
    found = _knn(spark, sf).withColumnRenamed("vec_id", "chunk_id")
    own = found.filter(F.col("chunk_id") != F.col("query_id"))
    asks = v.select(F.col("vec_id").alias("query_id"), F.floor(F.col("vec_id") / 2).alias("pair"))
    both = found.select(F.floor(F.col("query_id") / 2).alias("pair"), "chunk_id", "score").join(asks, "pair").filter(F.col("chunk_id") != F.col("query_id"))
    merged = cut_lineage(retrieval.fuse(both))
    about = v.select("vec_id", words.alias("about"))
    pairs = merged.join(about.toDF("chunk_id", "chunk_text"), "chunk_id").join(about.toDF("query_id", "query"), "query_id")
    final = retrieval.rerank(pairs.withColumn("chunk_id", F.col("chunk_id").cast("string")), 8)
    lists = strategies.tagged("baseline", own).unionByName(strategies.tagged("retrieved", merged)).unionByName(
        strategies.tagged("reranked", final.select("query_id", "chunk_id", "score")))
    strings = F.lit(None).cast("array<string>")
    truth = v.select(
        F.col("vec_id").cast("string").alias("query_id"), F.col("section").alias("category"), strings.alias("expected_chunk_ids"),
        F.array("section").alias("expected_sections"), strings.alias("expected_report_ids"))
    corpus = v.agg(F.count(F.lit(1)).alias("corpus_size"))
    return truth, strategies.query_scores(
        lists, v.withColumnRenamed("vec_id", "chunk_id"), truth, retrieval.total_relevant(truth, v), corpus, rewrite=True, passage=False, k=5)


@query("strategy_gains", S.with_tables("SELECT * FROM stage_scores_t"))
def strategy_gains(spark, sf):
    return _stage_scores(spark, sf)[1]


_RUN_MEAN = "round_even(coalesce(CAST(avg(CAST({c} AS DECIMAL(14,6))) FILTER (ok) AS DOUBLE), 0), 6)"


@query("strategy_run", S.with_tables(f"""
SELECT category, CAST(grouping(category) AS INTEGER) AS is_total, count(*) FILTER (ok) AS num_queries, count(*) FILTER (NOT ok) AS failures,
  {", ".join(f"{_RUN_MEAN.format(c=m)} AS {m if m.endswith('gain') or m == 'hit_rate' else 'mean_' + m}" for m in strategies.MEASURES)},
  round_even(CAST(avg(CAST(CAST(query_id AS BIGINT) % 90 AS DECIMAL(14,6))) FILTER (ok) AS DOUBLE), 6) AS mean_latency_ms
FROM (SELECT *, CAST(query_id AS BIGINT) % 17 <> 0 AS ok FROM stage_scores_t) GROUP BY GROUPING SETS ((), (category))"""))
def strategy_run(spark, sf):
    truth, scores = _stage_scores(spark, sf)
    i = F.col("query_id").cast("bigint")
    none = F.lit(None).cast("string")
    asked = truth.select("query_id", "category", F.when(i % 17 == 0, F.lit(" ")).otherwise(F.lit("q")).alias("query"), F.lit(10).alias("top_k"),
                         F.lit(2020).alias("year"), F.lit(None).cast("int").alias("quarter"), none.alias("report_type"), none.alias("section"))
    timed = asked.join(retrieval.check_requests(asked), "query_id").withColumn("latency_ms", (i % 90).cast("double"))
    return strategies.strategy_run(scores, timed)


S.TABLES["costed_t"] = f"""
SELECT k.query_id, d.doc_id, k.score, v.year, d.tokens FROM knn_t k JOIN vectors_t v USING (vec_id) JOIN (
  SELECT e.vec_id, doc_id, len(regexp_extract_all(text, '{S.TOKEN}')) AS tokens FROM documents JOIN embeddings e
  ON {_DEALT.format(a="e.vec_id", b="doc_id", n="(SELECT least((SELECT max(vec_id) FROM embeddings), (SELECT max(doc_id) FROM documents)) + 1)")}) d USING (vec_id)"""


@query("budget_admission", S.with_tables("""
SELECT query_id, doc_id AS chunk_id, CAST(row_number() OVER w AS INTEGER) AS citation_id FROM (
  SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, year DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM costed_t)
WHERE used <= 4000 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, year DESC, doc_id)"""))
def budget_admission(spark, sf):
    v = derive.vectors(spark, sf).select("vec_id", "year")
    d = derive.table(spark, sf, "documents").select("doc_id", text.token_count(F.col("text")).alias("token_count"))
    chunks = _dealt(v, "vec_id", d, "doc_id").withColumnRenamed("doc_id", "chunk_id")
    r = _knn(spark, sf).join(chunks, "vec_id")
    return retrieval.admit(r, vocab.BUDGETS["SMALL"]).select("query_id", "chunk_id", "citation_id")


S.TABLES["asks_t"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS query_id, CASE WHEN o_orderkey % 50 = 0 THEN ' ' ELSE 'q' END AS query, CAST(o_orderkey % 60 AS INTEGER) AS top_k,
       CAST(CASE o_orderkey % 4 WHEN 0 THEN 1890 WHEN 1 THEN 2001 END AS INTEGER) AS year, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 6 END AS INTEGER) AS quarter,
       CASE o_orderkey % 5 WHEN 0 THEN '10-K' WHEN 1 THEN '8-K' END AS report_type, CASE WHEN o_orderkey % 7 = 0 THEN 'MD&A' WHEN o_orderkey % 7 = 1 THEN 'Nowhere' END AS section FROM orders"""


@query("request_problems", S.with_tables(f"""
SELECT query_id, CASE WHEN trim(query) = '' THEN 'empty_query' WHEN top_k NOT BETWEEN 5 AND 50 THEN 'bad_top_k' WHEN year NOT BETWEEN 1900 AND 2200 THEN 'bad_year'
  WHEN quarter NOT BETWEEN 1 AND 4 THEN 'bad_quarter' WHEN report_type NOT IN {S.in_list(vocab.REPORT_TYPES)} THEN 'unknown_report_type'
  WHEN section NOT IN {S.in_list(vocab.SECTIONS)} THEN 'unknown_section' WHEN quarter IS NOT NULL AND report_type = '10-K' THEN 'quarter_on_annual_report' END AS problem FROM asks_t"""))
def request_problems(spark, sf):
    k = F.col("o_orderkey")
    asks = derive.table(spark, sf, "orders").select(
        k.cast("string").alias("query_id"), F.when(k % 50 == 0, F.lit(" ")).otherwise(F.lit("q")).alias("query"),
        (k % 60).cast("int").alias("top_k"), F.when(k % 4 == 0, F.lit(1890)).when(k % 4 == 1, F.lit(2001)).alias("year"),
        F.when(k % 3 == 0, (k % 6).cast("int")).alias("quarter"),
        F.when(k % 5 == 0, F.lit("10-K")).when(k % 5 == 1, F.lit("8-K")).alias("report_type"),
        F.when(k % 7 == 0, F.lit("MD&A")).when(k % 7 == 1, F.lit("Nowhere")).alias("section"))
    return retrieval.check_requests(asks)


@query("request_targets", S.with_tables("""
SELECT q.query_id, CASE WHEN r.report_id IS NULL THEN 'report_not_found' WHEN q.company_id <> r.company_id THEN 'other_company' WHEN q.year <> r.year THEN 'other_year' END AS problem
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS query_id, CAST(o_custkey % 150 AS VARCHAR) || '-' || year(o_orderdate) || '-FY' AS report_id,
             CAST(o_custkey % 150 - o_orderkey % 2 AS VARCHAR) AS company_id, CAST(year(o_orderdate) - CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS year FROM orders) q
LEFT JOIN reports_t r ON r.report_id = q.report_id"""))
def request_targets(spark, sf):
    k, c, y = F.col("o_orderkey"), F.col("o_custkey") % 150, F.year("o_orderdate")
    q = derive.table(spark, sf, "orders").select(
        k.cast("string").alias("query_id"), F.concat(c, F.lit("-"), y, F.lit("-FY")).alias("report_id"),
        (c - k % 2).cast("string").alias("company_id"), (y - F.when(k % 5 == 0, F.lit(1)).otherwise(F.lit(0))).alias("year"),
        F.lit(None).cast("int").alias("quarter"), F.lit(None).cast("string").alias("report_type"))
    return retrieval.check_targets(q, derive.reports(spark, sf), derive.companies(spark, sf))


def _embedded_chunks(spark, sf):
    c = derive.document_chunks(spark, sf)
    return c.select(
        "chunk_id", "chunk_text", "report_id", "section", F.col("fiscal_year").alias("year"), F.lit(1).alias("start_page"),
        text.token_count(F.col("chunk_text")).alias("token_count"),
        retrieval.hashing_embedder(64)(F.col("chunk_text")).alias("embedding"))


def _assembled(spark, sf, strategy):
    # every row asks, against all chunks; each different question once, whoever asked it
    asked = _asked(spark, sf).select("query").distinct().withColumn("query_id", F.sha2("query", 256))
    return retrieval.retrieve_and_assemble(asked, _embedded_chunks(spark, sf), retrieval.hashing_embedder(64), strategy=strategy)


@query("assembled_context")
def assembled_context(spark, sf):
    context, _ = _assembled(spark, sf, "RISK_ANALYSIS")
    return context.select("query_id", "tokens_used", "budget_limit", F.size("citations").alias("citations"), F.length("context_text").alias("chars"))


@query("general_context")
def general_context(spark, sf):
    context, _ = _assembled(spark, sf, "GENERAL_ANALYSIS")
    return context.select("query_id", "tokens_used", F.size("citations").alias("citations"))


_WORDS = ["revenue", "risk", "le", "the"]


@query("answer_quality", f"""
SELECT role, count(*) AS answers, round_even(avg(CAST(len(list_filter({S.items(_WORDS)}, lambda w: contains(lower(text), w))) > 0 AS INTEGER)), 6) AS grounding_rate FROM conversations GROUP BY 1""")
def answer_quality(spark, sf):
    from ledgerlens.operators import evaluation

    answers = derive.table(spark, sf, "conversations").select(
        "role", F.col("text").alias("answer"), F.array(*[F.lit(w) for w in _WORDS]).alias("answer_keywords"),
        F.lit("RISK").alias("intent"), F.array(F.lit("RISK")).alias("expected_intent"),
        F.lit(False).alias("expect_citations"), F.lit(0).alias("citations"))
    return evaluation.answer_quality(answers, "role").select("role", "answers", "grounding_rate")
