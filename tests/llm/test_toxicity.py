import random

from ledgerlens.llm import toxicity_grammar as m


def count(grammar, text):
    import numpy as np

    words = text.lower().split()
    return dict(zip(m.EVENTS, grammar.events(np.array([grammar.kind(w) for w in words], np.int8)).tolist(), strict=True))


def test_clauses_are_scored_in_context():
    g = m.Grammar([])
    assert count(g, "You are an idiot.")["targeted insult"] == 1
    assert count(g, "What an idiot.")["insult"] == 1
    assert count(g, "You are not an idiot.")["negated"] == 1
    assert count(g, "The paper said that idiot left.")["reported"] == 1
    assert count(g, "I will kill you. They said hello. We kill time.") ["threat"] == 2
    assert count(g, "you, we kill")["targeted threat"] == 1
    two = count(g, "Not an idiot! An idiot!")
    assert two["negated"] == 1 and two["insult"] == 1
    assert sum(count(g, "A calm sentence, said nobody.").values()) == 0


def test_composed_automaton_equals_a_direct_reading():
    rng = random.Random(9)
    step, emit = m.compose()
    for _ in range(500):
        kinds = [rng.randrange(6) for _ in range(rng.randrange(1, 14))]
        state, got = 0, []
        for k in kinds:
            got.append(emit[state][k])
            state = step[state][k]
        for at, k in enumerate(kinds):
            want = -1
            if k in (m.INSULT, m.THREAT):
                negated = m.NEGATION in kinds[max(0, at - m.NEGATION_REACH):at]
                near = m.TARGET in kinds[max(0, at - m.TARGET_REACH):at]
                want = 5 if negated else 4 if m.REPORT in kinds[:at] else (0 if near else 3) if k == m.THREAT else (1 if near else 2)
            assert got[at] == want


def made(spark, n=1200, seed=1):
    """Texts of invented words; toxic ones hold a word with a stem that only labels tell."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [f"wo{rng.randrange(3000)}" for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            w[rng.randrange(40)] = f"zork{rng.choice('abcdefgh')}{rng.choice('klmn')}"
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    # a thousand copies of one toxic text must not make its other words suspicious
    copy = " ".join(f"innocent{k}" for k in range(30)) + " zorkak"
    docs += [(10_000 + i, copy) for i in range(300)]
    labels += [(10_000 + i, 1, 1) for i in range(300)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_stems_and_holds_out(spark):
    docs, labels = made(spark)
    out = m.toxicity_scores(docs, labels).join(labels, "doc_id").filter("doc_id < 10000 and held_out").collect()
    assert len(out) > 300
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 0.98 * len(out)
    clean = spark.createDataFrame([(1, " ".join(f"innocent{k}" for k in range(20)))], "doc_id long, text string")
    model = m.fit(docs, labels)
    assert not any(t.startswith("innoc") for t in model.grammar.stems)
    assert m.clause_events(clean, model.grammar).select(model.score(m.F.col("_events"))).first()[0] < 0.5


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = made(spark)
    other = labels.withColumn("toxic", m.F.when(~m.in_training(m.F.col("doc_id")), 1 - m.F.col("toxic")).otherwise(m.F.col("toxic")))
    assert sorted(m.toxicity_scores(docs, labels).collect()) == sorted(m.toxicity_scores(docs, other).collect())


def test_held_out_accuracy_on_the_tables(spark, sf):
    big = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = m.toxicity_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r for r in rows if r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.75 * len(toxic)
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.01 * len(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (None, 1, 1), (2, None, None), (1, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = m.toxicity_scores(odd_docs, labels).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert not any(r["predicted"] for r in out)
    kept = m.without_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert m.toxicity_scores(no_docs, labels).count() == 0
    assert m.toxicity_scores(odd_docs, labels.limit(0)).count() == odd_docs.count()
