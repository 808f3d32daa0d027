import json

from pyspark.sql import functions as F

from ledgerlens.operators import chunks, evaluation, memo, reads, risks
from ledgerlens.sources import ingest


def write(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(json.dumps(value), encoding="utf-8")
    return str(path)


def test_taxonomy_files(spark, tmp_path, rows):
    m = write(tmp_path, "m.json", {"metrics": [
        {"canonical": "A", "category": "REVENUE", "value_kind": "currency", "aliases": [" Sales ", "both"], "expected_sections": ["MD&A"]},
        {"canonical": "B", "category": "OTHER", "value_kind": "percent", "aliases": ["BOTH"], "expected_sections": []}]})
    assert rows(ingest.metric_taxonomy(spark, m), "alias", "canonical") == [("both", "A"), ("sales", "A")]
    s = write(tmp_path, "s.json", {"aliases": {"Our Business": "Business Overview"}})
    assert rows(ingest.section_taxonomy(spark, s), "alias", "section") == [("our business", "Business Overview")]
    r = write(tmp_path, "r.json", {"categories": {"LEGAL": {"keywords": ["suit", "patent"]}, "NOPE": {"keywords": ["x"]}}})
    assert rows(ingest.risk_taxonomy(spark, r), "category", "keyword") == [("LEGAL", "patent"), ("LEGAL", "suit")]


def test_gold_file(spark, tmp_path):
    g = write(tmp_path, "g.json", {"examples": [{"id": "a", "text": "t", "expected": [{"metric": "REVENUE", "value": 1}]}]})
    r = ingest.gold_examples(spark, g, "id:string,text:string,expected:array<struct<metric:string,value:decimal(22,6)>>").first()
    assert r["id"] == "a" and r["expected"][0]["metric"] == "REVENUE"


def test_gold_scores(spark):
    ddl = "id string, q int, v int"
    e = spark.createDataFrame([("a", None, 1), ("b", 1, 2), ("c", 1, 3)], ddl)
    p = spark.createDataFrame([("a", None, 1), ("b", 1, 9), ("z", 1, 3)], ddl)
    r = evaluation.gold_scores(e, p, ["id", "q"], ["v"]).first()
    assert (r["expected"], r["produced"], r["matched"], r["correct"], r["precision"], r["value_accuracy"]) == (3, 3, 2, 1, .6667, .5)


def test_gold_risks_take_the_most_similar_name(spark):
    ddl = "id string, normalized_risk_name string, category string, severity string"
    e = spark.createDataFrame([("x", "SUPPLY_CHAIN_RISK", "S", "HIGH")], ddl)
    p = spark.createDataFrame([("x", "SUPPLY_CHAIN_DELAY_RISK", "S", "LOW"), ("x", "SUPPLY_CHAIN", "S", "HIGH"), ("y", "SUPPLY_CHAIN", "S", "HIGH")], ddl)
    assert [(r["p_name"], r["score"]) for r in evaluation.match_gold_risks(e, p).collect()] == [("SUPPLY_CHAIN", 1.0)]


def test_evolutions_touching_a_report_on_either_side(spark, rows):
    r = spark.createDataFrame([("a1", "A"), ("b1", "B"), ("c1", "C")], "risk_id string, report_id string")
    e = spark.createDataFrame([("a1", "b1", 1), ("b1", "a1", 2), (None, "a1", 3), ("b1", "c1", 4), ("c1", None, 5)],
                              "current_risk_id string, previous_risk_id string, n int")
    wanted = spark.createDataFrame([("A",)], "report_id string")
    assert rows(risks.evolutions_of_reports(e, r, wanted), "n") == [(1,), (2,), (3,)]


def test_table_function(spark):
    chunks.register_chunk_text(spark)
    out = spark.sql("select t.* from (select repeat('word ', 1500) as body) d, lateral chunk_text(d.body, 'MD&A') t order by piece").collect()
    assert [r["token_count"] for r in out] == [700, 700, 250]   # 75 tokens are repeated


def test_citation_falls_back_to_the_most_similar_chunk(spark):
    c = spark.createDataFrame([("k1", "r", 3, 0, "MD&A", "sales rose in the north"), ("k2", "r", 4, 1, "MD&A", "costs fell in the south"), ("k3", "o", 1, 0, "X", "sales rose"),
                               *[(f"late{i:02d}", "r", 9, i, "MD&A", "sales rose") for i in range(30)]],
                              "chunk_id string, report_id string, start_page int, chunk_index int, section string, chunk_text string")
    k = spark.createDataFrame([("q", "r", "k2", "flood risk")], "risk_id string, report_id string, source_chunk_id string, risk_description string")
    raw = spark.createDataFrame([
        ("1", "r", "note", None, "sales rose", None), ("2", "r", "risk_factor", "q", None, None), ("3", "r", "financial_metric", None, None, "REVENUE"),
        ("4", "r", "text_chunk", "k3", "costs fell", None), ("5", "r", "text_chunk", "late29", "costs fell", None)],
        "citation_id string, report_id string, source_type string, ref_id string, text_snippet string, metric_name string").withColumn(
            "page_number", F.lit(None).cast("int")).withColumn("section_name", F.lit(None).cast("string"))
    out = {r["citation_id"]: r for r in memo.resolve_citations(raw, c, k).collect()}
    assert (out["1"]["chunk_id"][:4], out["1"]["page_number"], out["1"]["source_type"]) == ("late", 9, "text_chunk")
    assert (out["2"]["chunk_id"], out["2"]["section_name"]) == ("k2", "Risk Factors")
    assert out["3"]["text_snippet"] == "Financial Metric: REVENUE"
    assert out["4"]["chunk_id"] == "k2"          # k3 belongs to another report
    assert out["5"]["chunk_id"] == "k2"          # and late29 is not among the evidence of its package


def test_reads(spark, rows):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "a", 7)], "k int, c string, v int")
    assert rows(reads.select_where(df, c="a", v=None), "k") == [(1,), (3,)]
    assert [r["k"] for r in reads.sort_by(df, "v", descending=True).collect()] == [3, 2, 1]
    assert [r["k"] for r in reads.sort_by(df, "v").collect()] == [2, 3, 1]
    assert [(r["k"], r["total"]) for r in reads.page(df, [F.col("k")], limit=1, offset=1).collect()] == [(2, 3)]


def test_thread_history_with_gaps_and_repeated_turns(spark):
    rows_ = [("a", t, "user", f"t{t}") for t in (1, 2, 5, 9)] + [("a", 9, "user", "again"), ("b", 3, "user", "x")]
    df = spark.createDataFrame(rows_, "conv_id string, turn int, role string, text string")
    last = reads.thread_history(df, last=3).collect()
    assert sorted((r["conv_id"], r["text"], r["from_end"], r["messages"]) for r in last) == [
        ("a", "again", 1, 5), ("a", "t5", 3, 5), ("a", "t9", 2, 5), ("b", "x", 1, 1)]
    assert sorted(r["from_end"] for r in reads.thread_history(df).collect()) == [1, 1, 2, 3, 4, 5]
