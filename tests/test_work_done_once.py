"""Large inputs are read and shuffled once, and what was shuffled is given back."""

import datetime
import glob
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens import plans, vocab
from ledgerlens.functions import chunking
from ledgerlens.functions.chunking import token_starts as starts
from ledgerlens.operators import chunks
from ledgerlens.session import CLEANUP, cut_lineage


@pytest.fixture
def line_items(spark, tmp_path):
    """Three companies; 1 and 2 have equal revenue in the first quarter, 3 more."""
    orders = [(k, datetime.date(2020, 1 + 3 * (k % 2), 5)) for k in range(6)]
    lines = [(k, 1 + k // 2, 5.0, 90000.0 if k // 2 == 2 else 50000.0, 0.0, 0.1) for k in range(6)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("tie, want", [("min", [1, 2, 2]), ("dense", [1, 2, 2]), ("average", [1, 2.5, 2.5])])
def test_ranks_sum_the_line_items_once(spark, line_items, tie, want):
    out = plans.QUERIES[f"rank_ties_{tie}"](spark, line_items)
    assert "l_extendedprice" not in out._jdf.queryExecution().toString()  # they read written sums
    got = {r["company_id"]: r["rank"] for r in out.filter("cohort = 'REVENUE-2020-Q1'").collect()}
    assert [got[c] for c in "321"] == want


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}


def test_a_checkpoint_gives_its_shuffle_files_back(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    counts = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    kept = cut_lineage(counts.join(counts.withColumnRenamed("count", "again"), "k").repartition(3))
    for _ in range(50):  # files are removed in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP) == setting
    assert kept.count() == 100 and kept.filter("count <> 100 OR again <> 100").isEmpty()


def test_equal_sections_are_cut_into_tokens_once(monkeypatch):
    seen = []
    monkeypatch.setattr(chunking, "token_starts", lambda body: seen.append(body) or starts(body))
    body = "Wörter, zwei; 3 marks! " * 40 + "\n\n" + "x_1 \u4e2d\u6587 \u2028 end. " * 30
    args = (pa.array([body] * 3 + [None, " "]), pa.array([70, 50, 70, 70, 70]), pa.array([80] * 5), pa.array([8] * 5), pa.array([False] * 5))
    made = chunks._cut_sections(*args).to_pylist()
    assert seen == [body] and made[0] == made[2] and made[3] == made[4] == []
    assert [(p["chunk_text"], p["token_count"]) for p in made[1]] == chunking.cut(body, 50, 80, 8, vocab.PROSE_SEPARATORS)


@pytest.mark.parametrize("text", ["", "a", " a-b  c_1\x85d\u0301e\xa0\u2167\xb2", "\u4e2d\u6587 \U0001f600 x", "\x1c\u2028,,."])
def test_token_starts_are_those_of_the_pattern(text):
    assert starts(text) == [m.start() for m in chunking._TOKEN.finditer(text)]
