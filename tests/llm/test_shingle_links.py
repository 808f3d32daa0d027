import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import shingle_links as m


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)}


def kept_by_brute_force(rows):
    """Ids of the smallest of each class over all pairs of Jaccard 0.8 or more."""
    sets = {i: shingle_set(t) for i, t in rows}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if j >= i:
                break
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def test_exactly_the_pairs_at_four_fifths(spark, sf):
    """Pairs just above 0.8 are joined and pairs just below are not, for short and long texts."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        n = rng.choice([12, 60, 300])
        w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        rows.append((2 * i, " ".join(w)))
        # k changed words at one end change about k shingles of n - 4: Jaccard (n-4-k) / (n-4+k)
        k = round((n - 4) / 9) + rng.choice([-1, 0, 1])
        rows.append((2 * i + 1, " ".join(w[:n - k] + [f"x{rng.randrange(10**6)}" for _ in range(k)])))
    want = kept_by_brute_force(rows)
    assert 450 < len(want) < 750
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_large_mixed_bucket(spark):
    """Hundreds of texts at about 0.75 to each other, and copies among them, in the same buckets."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(200)]
    rows = []
    for i in range(150):
        own = [f"o{rng.randrange(10**6)}" for _ in range(30)]
        rows.append((i, " ".join(common + own)))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join(common + own[:-2] + ["other", "end"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in m.keep_least(docs).collect()} == kept_by_brute_force(rows)


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_blocks_alone_find_all_links(spark, monkeypatch, rounds):
    monkeypatch.setitem(m.near_roots.__kwdefaults__, "rounds", rounds)
    for name, value in (("BLOCK_ROWS", 20), ("COLUMNS", 64), ("STAR", 7), ("WORTH", 1)):
        monkeypatch.setattr(m, name, value)
    test_large_mixed_bucket(spark)


def test_common_counts_are_exact():
    rng = np.random.default_rng(3)
    left, right = ([np.unique(rng.integers(0, 9_000, n).astype(np.uint64)) for n in rng.integers(1, 5_000, 12)] for _ in range(2))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert m.common_counts(left, right).tolist() == want
    assert [[m._shared(a, b) for b in right] for a in left] == want


def test_ids_decide_on_no_other_text(spark):
    texts = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[0]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (None, texts[1])]
    left = [tuple(r) for r in m.keep_least(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(left, key=str) == sorted([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3])], key=str)


def test_fingerprints_find_without_bands(spark):
    """Near copies are found by their SimHash alone, by no band key; texts further apart than 0.8 are not joined."""
    rng = random.Random(9)
    rows, want = [], set()
    for i in range(60):
        w = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows.append((2 * i, " ".join(w)))
        far = i % 3 == 0
        rows.append((2 * i + 1, " ".join([f"y{rng.randrange(10**6)}" for _ in w] if far else [*w, "end"])))
        want |= set() if far else {2 * i, 2 * i + 1}
    texts = m.with_row_key(spark.createDataFrame(rows, "doc_id long, text string"), ["h1", "h2"])
    sketch = m.sketches(texts, 5).withColumn("node", F.col("doc_id")).withColumn("first", F.struct("h1", "h2"))
    nodes = sketch.withColumn("bands", F.array().cast("array<long>"))
    roots = {r["node"]: r["root"] for r in m.near_roots(nodes, texts, 5, 0.8).collect()}
    assert all(root == node - node % 2 for node, root in roots.items())
    assert set(roots) <= want and len(roots) >= 0.9 * len(want)
