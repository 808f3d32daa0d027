import random

import pytest
import pandas as pd
from pyspark.sql import functions as F

from ledgerlens.operators import dictionaries, extract, risks
from ledgerlens.sources import derive

TEXTS = "id long, body string"
TERMS = "alias string, place int"


def word(ch):
    return ch.isalnum() or ch == "_"


def by_hand(body, alias):
    """Every whole-word place of an alias, overlapping ones included."""
    low, alias = (body or "").lower(), alias.lower()
    return [i for i in range(len(low)) if low.startswith(alias, i) and not word(low[i - 1:i] or " ") and not word(low[i + len(alias):i + len(alias) + 1] or " ")]


def claims_by_hand(body, aliases):
    spots = sorted(((-len(a), p, s) for p, a in enumerate(aliases) for s in by_hand(body, a)))
    taken, kept = set(), []
    for size, place, start in spots:
        span = set(range(start, start - size))
        if not span & taken:
            taken |= span
            kept.append((start, aliases[place]))
    return sorted(kept)


ALIASES = ["net sales", "Sales", "net", "total net sales", "(loss)", "p/e", "r&d cost", "_x", "é", "a a", "%", "", "cost of sales"]


@pytest.fixture(scope="module")
def bodies():
    rng = random.Random(3)
    parts = ["net", "sales", "total", "(loss)", "p/e", "r&d", "cost", "of", "a", "É", "_x", "x_", " ", "  ", "\n", ", ", "(", ")", "%", "-"]
    made = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    return [*made, None, "", "net", "(loss)", "a a a", "total net sales", "net  sales", "word " * 20_000 + "p/e"]


def test_word_matches_equal_a_search_by_hand(spark, bodies):
    texts = spark.createDataFrame(list(enumerate(bodies)), TEXTS)
    terms = spark.createDataFrame([(a, i) for i, a in enumerate(ALIASES)] + [(None, 99)], TERMS)
    got = sorted(tuple(r) for r in dictionaries.word_matches(texts, "id", "body", terms).select("id", "alias", "start", "end").collect())
    searched = [a for a in ALIASES if any(word(ch) for ch in a)]
    assert got == sorted((i, a, s, s + len(a)) for i, b in enumerate(bodies) for a in searched for s in by_hand(b, a))


def test_claims_prefer_the_longest_then_place_then_left(spark, bodies):
    texts = spark.createDataFrame(list(enumerate(bodies)), TEXTS)
    aliases = [a for a in ALIASES if any(word(ch) for ch in a)]
    terms = spark.createDataFrame([(a, i) for i, a in enumerate(aliases)], TERMS)
    got = {r["id"]: [(s["start"], s["alias"]) for s in r["spans"]] for r in dictionaries.word_claims(texts, "id", "body", terms).collect()}
    assert got == {i: c for i, b in enumerate(bodies) if (c := claims_by_hand(b, aliases))}


def test_substrings_equal_a_search_by_hand(spark):
    rng = random.Random(5)
    bodies = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", "a"]
    words = sorted({"".join(rng.choice("abcé ") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    texts = spark.createDataFrame(list(enumerate(bodies)), TEXTS)
    terms = spark.createDataFrame([(w,) for w in words] + [("",), (None,)], "w string")
    got = sorted(tuple(r) for r in dictionaries.substring_matches(texts, "id", "body", terms, "w").select("id", "w").collect())
    assert got == sorted((i, w) for i, b in enumerate(bodies) if b for w in words if w in b)


def test_empty_tables(spark):
    texts, terms = spark.createDataFrame([(1, "net sales")], TEXTS), spark.createDataFrame([("net", 0)], TERMS)
    for t, d in ((texts, terms.limit(0)), (texts.limit(0), terms)):
        assert dictionaries.word_claims(t, "id", "body", d).collect() == []
        assert dictionaries.substring_matches(t, "id", "body", d, "alias").collect() == []


def test_the_built_in_taxonomies_as_tables_give_the_same_rows(spark, sf):
    chunks = derive.document_chunks(spark, sf)
    for plain, tabled in (
        (extract.metric_candidates(chunks), extract.metric_candidates(chunks, taxonomy=dictionaries.metric_terms(spark))),
        (risks.extract_risks(chunks), risks.extract_risks(chunks, dictionaries.risk_terms(spark))),
    ):
        columns = sorted(plain.columns)
        want, got = (sorted(map(tuple, df.select(*columns).collect()), key=repr) for df in (plain, tabled))
        assert want and got == want


def test_another_taxonomy_changes_rows(spark):
    chunks = spark.createDataFrame(
        [("c", "r", "k", 0, "MD&A", "Churn rate was 4.5% and revenue was $10 million. A drought may harm us.", 2024, None)],
        "company_id string, report_id string, chunk_id string, chunk_index int, section string, chunk_text string, fiscal_year int, fiscal_quarter int")
    terms = spark.createDataFrame([("Churn Rate", "CHURN", "OPERATIONS", True, ["MD&A"], 0)],
                                  "alias string, metric string, category string, percent boolean, sections array<string>, place int")
    m = extract.extract_metrics(chunks, taxonomy=terms).collect()
    assert [(r["normalized_metric_name"], float(r["value"]), r["unit"]) for r in m] == [("CHURN", 4.5, "PERCENT")]
    keywords = spark.createDataFrame([("drought", "CLIMATE", 0)], "keyword string, category string, defined int")
    assert [(r["risk_name"], r["category"]) for r in risks.extract_risks(chunks, keywords).collect()] == [("Drought Risk", "CLIMATE")]


def test_large_dictionaries_are_joined_not_written_into_the_plan(spark, bodies):
    texts = spark.createDataFrame(list(enumerate(bodies)), TEXTS)
    terms = spark.range(20_000).select(F.concat(F.lit("term "), "id").alias("alias"), F.col("id").cast("int").alias("place"))
    found = dictionaries.word_matches(texts, "id", "body", terms)
    assert "term 19999" not in found._jdf.queryExecution().toString()
    assert found.count() == 0


def test_only_runs_that_may_be_in_the_dictionary_leave_a_task(spark):
    rng = random.Random(8)
    body = " ".join(f"w{rng.randrange(5000)}" for _ in range(20_000))
    frame = pd.DataFrame({"_key": [1], "_body": [body], "_shape": [{"sizes": [1, 2], "edge": 0, "longest": 30}], "_sizes": [[2, 4]]})
    words = dictionaries._bitmap(spark.createDataFrame([(w,) for w in ("w17", "w18 w19", "\x01w17", "\x01w18")], "w string").select(F.crc32("w").alias("hash")))
    rows = pd.concat(dictionaries._word_grams(words)(iter([frame])))
    assert body.split().count("w17") == (rows["gram"] == "w17").sum() and len(rows) < 60
    hashes = dictionaries._anchor_hash(pd.Series(["w177"]))
    anchors = dictionaries._bitmap(spark.createDataFrame([(int(h),) for h in hashes], "hash long"))
    rows = pd.concat(dictionaries._character_grams(anchors)(iter([frame])))
    assert "w177" in set(rows["gram"]) and len(rows) < 60


def test_runs_across_slices_are_found(spark, monkeypatch):
    monkeypatch.setattr(dictionaries, "SLICE", 7)
    test_substrings_equal_a_search_by_hand(spark)
