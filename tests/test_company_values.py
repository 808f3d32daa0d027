"""What a company shares is not repeated for each of its memos."""

from ledgerlens.operators import memo


def test_values_of_a_company_hold_for_each_of_its_memos(spark, rows):
    texts = spark.createDataFrame([("m1", "x", "up 500 and 777"), ("m2", "x", "at 777"), ("m3", "y", "at 777")], "memo_id string, company_id string, body string")
    own = spark.createDataFrame([("m1", 500.0)], "memo_id string, value double")
    shared = memo.company_values(spark.createDataFrame([("x", 777.0, 3.0, None)], "company_id string, current_value double, previous_value double, percentage_change double"))
    out = memo.check_grounding(texts, own, shared, fail_at=1)
    assert rows(out, "memo_id", "ungrounded", "failed") == [("m1", 0, False), ("m2", 0, False), ("m3", 1, True)]
