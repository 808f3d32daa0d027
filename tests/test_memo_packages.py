"""Memos are made without moving the texts of documents or going through all comparisons of a company."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions import text
from ledgerlens.operators import analytics, memo, periods
from ledgerlens.plans import records
from ledgerlens.sources import derive


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two companies with line items in five quarters, one document for most of their reports, one without a number."""
    folder = str(tmp_path_factory.mktemp("tables"))
    dates = [datetime.date(2019 + k // 4, 1 + 3 * (k % 4), 5) for k in range(5)]
    lines = [(k, c, 5.0 + c, 90000.0 + 7000 * k * c, 0.1, 0.05) for k in range(5) for c in (1, 2)]
    texts = [(i, f"Filing {i}. " + "word " * (i * 60)) for i in range(9)] + [(9, None), (9, "Again."), (None, "Lost. It could disrupt us.")]
    made = {
        "orders": (list(enumerate(dates)), "o_orderkey long, o_orderdate date"),
        "lineitem": (lines, "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double"),
        "supplier": ([(1, "One", 0), (2, "Two", 0)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(0, "N")], "n_nationkey int, n_name string"),
        "documents": ([(i, t, "en", "web", 9) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def shuffled(df):
    """Names of the columns that exchanges of a plan send."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return {c.split("#")[0].strip() for cols in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan) for c in cols.split(",")}


def test_no_text_of_a_document_is_shuffled_for_a_memo(spark, tables):
    packages = records._packages(spark, tables)[0]
    for df in (memo.drafts(packages), memo.evidence_tables(packages)):
        sent = shuffled(df)
        assert "report_id" in sent and not sent & {"text", "chunk_text", "_lower", "explanation"}
    assert not shuffled(records.memo_sections(spark, tables)) & {"text", "chunk_text", "_lower"}


def test_memos_need_no_more_of_a_package_than_its_digests(spark, tables, rows):
    packages = records._packages(spark, tables)[0]
    whole = packages.drop("comparison_heads", "signal_values", "evidence_pages", "cited", "comparison_lines")
    columns = ["memo_id", "title", "executive_summary", "parts", "citations"]
    got = rows(memo.drafts(packages), *columns)
    assert got == rows(memo.drafts(whole), *columns) and len(got) == 2 * 7
    assert rows(memo.allowed_values(packages), "memo_id", "value") == rows(memo.allowed_values(whole), "memo_id", "value")
    for r in packages.filter("cited is not null").collect():
        assert r["cited"]["chunk_id"] == r["evidence"][0]["chunk_id"] and r["cited"]["snippet"] == r["evidence"][0]["chunk_text"][:200]


def test_risks_tones_and_evidence_are_those_of_the_documents_of_a_report(spark, tables):
    packages = {r["report_id"]: r for r in records._packages(spark, tables)[0].collect()}
    held = {x["chunk_id"]: r for r in packages.values() for x in r["evidence"] or []}
    assert set(held) == {str(i) for i in range(10)}  # a document without a number has no report
    for i, r in held.items():
        assert r["company_id"] == str(1 + int(i) % 2)
        assert len(r["tones"]) == len(r["evidence"]) == (2 if i == "9" else 1)
        assert all(k["source_chunk_id"] == i and k["page_number"] == 1 for k in r["risks"] or [])
        assert any("Filing" in x["chunk_text"] and len(x["chunk_text"]) > 300 * int(i) for x in r["evidence"]) == (i != "9")
    assert sum(bool(r["risks"]) for r in held.values()) > 5


def test_a_text_is_read_once_to_validate_it(spark, rows):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(body):
        reads.add(1)
        return body

    texts = spark.createDataFrame([("a", "x", "Up 500 and 777."), ("b", "x", "A strong buy at 777, 888."), ("c", "y", None)], "memo_id string, company_id string, body string")
    own = spark.createDataFrame([("a", 500.0)], "memo_id string, value double")
    shared = spark.createDataFrame([("x", 777.0)], "company_id string, value double")
    out = memo.validate_memos(texts.withColumn("body", told("body")), own, shared, places=memo.ROUNDED)
    assert rows(out, "memo_id", "ungrounded", "accepted") == [("a", 0, True), ("b", 1, False), ("c", 0, True)]
    assert reads.value == 3


def test_roundings_hold_where_numbers_meet_values(spark, rows):
    texts = spark.createDataFrame([("a", "at 25"), ("b", "at 25")], "memo_id string, body string")
    close = spark.createDataFrame([("a", 23.6), ("b", 23.4)], "memo_id string, value double")  # 24 is near 25, 23 is not
    assert rows(memo.check_grounding(texts, close), "memo_id", "ungrounded") == [("a", 1), ("b", 1)]
    assert rows(memo.check_grounding(texts, close, places=memo.ROUNDED), "memo_id", "ungrounded") == [("a", 0), ("b", 1)]
    many = [(m, 20 + i * 0.37 * (1 + m)) for m in range(4) for i in range(60)] + [(0, -25.5), (1, 0.0), (2, 1e9)]
    allowed = spark.createDataFrame(many, "memo_id int, value double").withColumn("memo_id", F.col("memo_id").cast("string"))
    texts = spark.createDataFrame([(str(m), " and ".join(f"{21.3 + k * 0.83 * (1 + m):.2f}" for k in range(80))) for m in range(4)], "memo_id string, body string")
    each = memo._with_roundings(allowed.withColumnRenamed("value", "_v"), "memo_id")
    want = rows(memo.check_grounding(texts, each), "memo_id", "ungrounded")
    assert any(n for _, n in want) and rows(memo.check_grounding(texts, allowed, places=memo.ROUNDED), "memo_id", "ungrounded") == want


def test_signals_are_worded_for_readers_of_words_only(spark, tables):
    quarters = derive.quarter_sums(spark, tables)
    signals = analytics.comparison_signals(periods.compare_periods(derive.metrics(spark, tables, quarters), deduped=True, carry=("report_id",)))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "format_number" in plan(signals) and "format_number" not in plan(signals.select("report_id", "value"))


@pytest.mark.parametrize("patterns", [vocab.PROHIBITED_PHRASES, vocab.RISK_TRIGGERS, [r"\bcat|dog\b", r"\bcow\b"]])
def test_patterns_with_a_common_boundary_match_as_before(spark, patterns):
    texts = ["a STRONG buy now", "astrong buy", "Rating : hold", "operating: holds", "éprice target", "price  target", "hotdog", "cats", "xcow", "cow!", "it may be", "maybe", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.col("t").rlike("(?iu)(?U)" + "|".join(f"(?:{p})" for p in patterns))
    got = df.select(text.matches_any(F.col("t"), patterns).alias("a"), plain.alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]
