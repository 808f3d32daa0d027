import random

from ledgerlens.llm import benchmark_decontamination as m


def plain(text):
    return [w for w in (x.strip(m.STRIPPED) for x in (text or "").lower().split()) if w]


def grams(text):
    w = plain(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    found = {}
    for d, t in docs:
        own = grams(t)
        for i, q in items:
            g = grams(q)
            if g and len(g & own) >= 0.8 * len(g):
                found[d, i] = len(g & own)
    return found


def test_equals_brute_force_on_the_tables(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r["shared_shingles"] for r in m.contained_items(documents, items).collect()}
    want = brute([tuple(r) for r in documents.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert got == want and got


def test_edited_items_in_long_documents(spark):
    rng = random.Random(2)
    items, docs = [], []
    for i in range(60):
        w = [f"q{rng.randrange(9000)}" for _ in range(rng.randrange(20, 120))]
        items.append((i, " ".join(w)))
        if i % 3:
            w[len(w) // 2] = "edited"
        fill = [f"q{rng.randrange(9000)}" for _ in range(rng.randrange(50, 3000))]
        at = rng.randrange(len(fill))
        docs.append((i, " ".join(fill[:at]) + "\n" + " ".join(w).upper() + ". " + " ".join(fill[at:])))
    got = {(r["doc_id"], r["item_id"]) for r in m.contained_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=2500).collect()}
    want = set(brute(docs, items))
    assert len(want) >= 40 and len(want & got) >= 0.98 * len(want) and got <= want


def test_odd_rows(spark, odd_docs, no_docs):
    text = odd_docs.filter("doc_id = 3").first()["text"]
    items = spark.createDataFrame([(1, text), (2, None), (3, "too short"), (None, text), (4, "")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in m.contained_items(odd_docs, items).collect()] == [(3, 1)]
    assert m.contained_items(no_docs, items).count() == 0
    assert m.contained_items(odd_docs, items.limit(0)).count() == 0
    clean = m.without_items(odd_docs, items)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count() - 1
    nameless = odd_docs.filter("doc_id is null and text is not null").first()["text"]
    hit = spark.createDataFrame([(7, nameless)], "item_id long, text string")
    left = m.without_items(odd_docs, hit).collect()
    assert len(left) == odd_docs.count() - 1 and sum(r["doc_id"] is None for r in left) == 1
