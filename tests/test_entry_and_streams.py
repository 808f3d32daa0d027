import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerlens.streaming import streams

QUICK = ["period_comparison", "risk_extraction", "section_detection", "filing_chunks", "vector_search", "latency_stats", "memo_sections"]


def test_every_sql_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.parametrize("name", QUICK)
def test_queries_run(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_result_does_not_depend_on_partitions(spark, sf, rows):
    seen = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out = entry.queries()["risk_extraction"](spark, sf)
        seen.append(rows(out, *sorted(out.columns)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_pages_stream_into_tone_and_risk_tables(spark, tmp_path):
    src, tone_path, risk_path = (str(tmp_path / n) for n in ("in", "tone", "risk"))
    schema = streams.PAGES_SCHEMA
    first = [("a", 1, "Supply chain problems are a risk. We are on track."), ("b", 1, "Calm.")]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(f"{src}")

    def run():
        q = streams.stream_pages(streams.read_stream(spark, src, schema), tone_path, risk_path, str(tmp_path / "state"))
        q.awaitTermination()

    run()
    assert streams.read_latest(spark, tone_path).count() == 2
    spark.createDataFrame([("a", 1, "No news.")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    tones = streams.read_latest(spark, tone_path)
    assert tones.count() == 2 and tones.filter("report_id = 'a'").first()["source_text"] == "No news."


def test_pages_of_one_report_in_two_batches_all_stay(spark, tmp_path):
    src, tone_path, risk_path = (str(tmp_path / n) for n in ("in", "tone", "risk"))
    schema = streams.PAGES_SCHEMA

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        streams.stream_pages(streams.read_stream(spark, src, schema), tone_path, risk_path, str(tmp_path / "state")).awaitTermination()

    land([("a", 1, "Supply chain problems are a risk."), ("a", 2, "We are on track.")])
    land([("a", 3, "A data breach is a risk."), ("a", 2, "We are not on track.")])
    tones = {r["source_chunk_id"]: r["source_text"] for r in streams.read_latest(spark, tone_path).collect()}
    assert tones == {"a|1": "Supply chain problems are a risk.", "a|2": "We are not on track.", "a|3": "A data breach is a risk."}
    assert {r["source_chunk_id"] for r in streams.read_latest(spark, risk_path).collect()} == {"a|1", "a|3"}


def test_stream_dedupe_keeps_first(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("r", "same"), ("r", " same "), ("r", "other"), ("s", "same")], "report_id string, chunk_text string").withColumn(
        "ts", F.timestamp_seconds(F.lit(1700000000))).write.parquet(src)
    df = streams.stream_dedupe(streams.read_stream(spark, src, "report_id string, chunk_text string, ts timestamp"))
    streams.run_to_table(df, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_risks_of_a_report_do_not_depend_on_the_batches_its_pages_come_in(spark, tmp_path):
    schema = streams.PAGES_SCHEMA
    pages = [("a", 3, "Supply chain problems are a risk."), ("a", 1, "A data breach is a risk."), ("b", 1, "Supply chain problems are a risk."),
             ("a", 2, "Supply chain problems and a data breach are a risk."), (None, 1, "A data breach is a risk."), ("c", 1, None)]

    def landed(name, batches):
        src, out = str(tmp_path / name / "in"), str(tmp_path / name / "reports")
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            streams.stream_pages(streams.read_stream(spark, src, schema), str(tmp_path / name / "tone"), str(tmp_path / name / "risk"),
                                 str(tmp_path / name / "state"), out).awaitTermination()
        return out

    def table(path):
        return sorted(map(str, streams.read_latest(spark, path, ["report_id"]).select(
            "report_id", "risk_id", "normalized_risk_name", "source_chunk_id", "page_number", "confidence_score").collect()))

    one, three = landed("one", [pages]), landed("three", [pages[:2], pages[2:3], pages[3:]])
    assert table(one) == table(three) and len(table(one)) == 4
    # a page that no longer names a risk retracts it, and the next page that names it takes over
    src = str(tmp_path / "three" / "in")
    quiet = [("b", 1, "Calm."), ("a", 2, "Calm.")]
    spark.createDataFrame(quiet, schema).coalesce(1).write.mode("append").parquet(src)
    streams.stream_pages(streams.read_stream(spark, src, schema), *(str(tmp_path / "three" / n) for n in ("tone", "risk", "state", "reports"))).awaitTermination()
    left = {(r["report_id"], r["page_number"]) for r in streams.read_latest(spark, three, ["report_id"]).collect()}
    assert left == {("a", 3), ("a", 1), (None, 1)}
    before = table(three)
    assert streams.fold_batches(spark, three, ["report_id"]) == 3
    assert table(three) == before


def test_update_streams_write_what_changed_and_drop_late_rows(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "user_id bigint, t bigint"

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        events = streams.read_stream(spark, src, schema).withColumn("ts", F.timestamp_seconds("t"))
        streams.run_to_table(streams.stream_slices(events, slide="10 seconds", late="1 minute"), out, state, mode="update").awaitTermination()

    land([(1, 1000), (1, 1005), (1, 1012), (2, 1001), (None, 1003)])
    land([(1, 1019), (2, 1300)])
    land([(1, 1020), (2, 1301)])  # the first is over a minute behind the 1300 seen before
    written = spark.read.parquet(f"{out}/rows").groupBy("batch").count().filter("count > 0")
    per_batch = [r["count"] for r in written.orderBy("batch").collect()]
    assert per_batch[0] == 4 and sum(per_batch) == 7  # 4 slices, 2 changed, 1 changed
    slices = streams.read_merged(spark, out, ["slice_start", "user_id"])
    assert {tuple(r) for r in slices.select("slice_start", "user_id", "n").collect()} == {
        (1000, 1, 2), (1010, 1, 2), (1000, 2, 1), (1000, None, 1), (1300, 2, 2)}
    got = {(r["window_start"], r["user_id"]): (r["n"], r["limited"]) for r in streams.sliding_counts(slices, window=30, limit=3).collect()}
    assert got[(1000, 1)] == got[(990, 1)] == (4, True) and got[(980, 1)] == (2, False) and got[(1010, 1)] == (2, False)
    assert got[(980, None)] == (1, False) and len(got) == 4 + 3 + 3 + 3
    with pytest.raises(ValueError):
        streams.sliding_counts(slices, window=25)
