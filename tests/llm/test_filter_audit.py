from itertools import permutations
from math import factorial

import duckdb

from ledgerlens.llm import filter_audit
from ledgerlens.llm.queries import QUERIES, SQL

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def by_sql(docs, labels):
    con = duckdb.connect()
    con.register("documents", docs)
    con.register("labels", labels)
    return {tuple(r) for r in con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({SQL['op11_filter_audit']})").fetchall()}


def arrow(df):
    return df.select("doc_id", "text", "lang").toArrow() if "text" in df.columns else df.toArrow()


def test_ranks_are_lexicographic():
    orders = list(permutations(range(5)))
    assert [filter_audit.lehmer_rank(p, 5) for p in orders] == list(range(120))
    assert filter_audit.lehmer_rank((3, 1), 5) == orders.index((3, 1, 0, 2, 4))


def test_intervals_hold_every_order_once():
    orders = list(permutations(range(5)))
    found = {}
    for mask, step, a, b in filter_audit.removal_intervals():
        for rank in range(a, b):
            assert (mask, rank) not in found
            found[mask, rank] = step
    want = {(m, r): next(k for k, f in enumerate(o, 1) if m >> f & 1) for m in range(1, 32) for r, o in enumerate(orders)}
    assert found == want and all(b <= factorial(5) for *_, b in filter_audit.removal_intervals())


def test_own_failures_at_their_borders():
    fail = lambda s: "".join(f for k, f in enumerate("ABCD") if filter_audit.own_failures(s.encode()) >> k & 1)
    words = [f"w{i}" for i in range(100)]
    assert fail("") == "A" and fail(" \n") == "A"
    assert fail(" ".join(words)) == "" and fail(" ".join(words[:99])) == "A"
    assert fail(" ".join(words[:80] + words[:20])) == "" and fail(" ".join(words[:79] + words[:21])) == "B"
    assert fail("A" + "b" * 9) == "A" and fail("AA" + "b" * 17) == "AC" and fail("Aééééééééé") == "A"  # code points, not bytes
    assert fail("a|") == "AD" and fail("É" * 9) == "A"
    assert fail(" ".join(words)) == "A"  # no ASCII white space: one word


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(0, 1, 0), (0, None, 1), (1, 0, None), (None, 1, 1), (103, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    out = filter_audit.interaction_audit(odd_docs, labels)
    assert out.columns == COLUMNS
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) == 600 * (1 + odd_docs.select("lang").distinct().count() - 1)
    assert set(got) == by_sql(arrow(odd_docs), arrow(labels))
    assert filter_audit.interaction_audit(no_docs, labels).count() == 0


def test_copies_count_once_and_ids_decide(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(7, long, "en"), (3, long, "en"), (3, long, "de"), (3, long, "en"), (5, long, None), (None, long, "en"), (9, "x", "en"), (2, None, "de"), (4, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {tuple(r) for r in filter_audit.interaction_audit(docs, labels).collect()}
    assert got == by_sql(arrow(docs), arrow(labels))
    first_e = {(part, removed) for part, order, step, _, removed, *_ in got if order == "EABCD" and step == 1}
    assert first_e == {("en", 1), ("de", 1), ("", 1)}


def test_query_equals_its_sql(spark, sf, documents, labels):
    got = {tuple(r) for r in QUERIES["op11_filter_audit"](spark, sf).collect()}
    assert got == by_sql(arrow(documents), arrow(labels)) and len(got) % 600 == 0
