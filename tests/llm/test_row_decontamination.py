import pytest

from ledgerlens.llm import benchmark_decontamination as m

ITEM = " ".join(f"q{i}" for i in range(20))
CLEAN = [" ".join(f"c{k}w{i}" for i in range(30)) for k in range(3)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, CLEAN[0]), (1, f"before {ITEM} after"), (None, CLEAN[1]), (None, f"{ITEM} too"), (2, "Alpha, beta gamma!"), (3, "alpha x beta gamma"), (4, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("block", [m.BLOCK_ENTRIES, 10])
def test_each_row_is_judged_by_its_own_text(spark, docs, block):
    items = spark.createDataFrame([(5, ITEM), (6, " ".join(f"other{i}" for i in range(9)))], "item_id long, text string")
    left = {tuple(r) for r in m.without_items(docs, items, block=block).collect()}
    assert left == {(1, CLEAN[0]), (None, CLEAN[1]), (2, "Alpha, beta gamma!"), (3, "alpha x beta gamma"), (4, None)}


def test_items_without_an_id_and_short_items(spark, docs):
    items = spark.createDataFrame([(None, ITEM), (7, "beta gamma"), (8, "alpha beta"), (9, None), (10, " ,")], "item_id long, text string")
    left = {tuple(r) for r in m.without_items(docs, items).collect()}
    assert left == {(1, CLEAN[0]), (None, CLEAN[1]), (4, None)}
    got = {tuple(r)[:4] for r in m.contained_items(docs, items).collect()}
    assert got == {(2, 7, 1, 1), (2, 8, 1, 1), (3, 7, 1, 1)}
