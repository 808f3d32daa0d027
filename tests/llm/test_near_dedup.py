import random

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import simhash_near_dedup as m


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(prints, radius):
    """Smallest position reachable over all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_classes_equal_brute_force(documents):
    got = {r["doc_id"]: r for r in m.duplicate_classes(documents).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    prints = [brute_print(t) for _, t in rows]
    classes = brute_classes(prints, 4)
    assert len(got) == len(rows)
    for (i, _), p, c in zip(rows, prints, classes, strict=True):
        assert got[i]["fingerprint"] & (2**64 - 1) == p
        assert got[i]["component_id"] == rows[c][0]


@pytest.mark.parametrize("bucket", [8192, 40])
def test_links_connect_all_within_the_radius(spark, bucket):
    rng = random.Random(1)
    centre = [rng.getrandbits(64) for _ in range(30)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centre for _ in range(8)}
    prints |= {centre[0] ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(a)}  # one large group of near copies
    prints = sorted(prints)
    nodes = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "f0 long")
    links = m.fingerprint_links(nodes, bucket=bucket).collect()
    assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 4 for r in links)
    parts = {r["node"]: r["root"] for r in m.connected_components(m.fingerprint_links(nodes, bucket=bucket)).collect()}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    want = brute_classes(prints, 4)
    same = {}
    for s, c in zip(signed, want, strict=True):
        assert same.setdefault(c, parts.get(s, s)) == parts.get(s, s)
    assert len(set(same.values())) == len(same)


def test_thresholds_meet_the_generalised_pigeonhole():
    rng = np.random.default_rng(3)
    for n in (100, 100_000, 10**9):
        bits = rng.integers(0, 2, (2000, 64))
        bits[:, 40:44] = bits[:, :1]  # correlated bits
        plan = m.plan_partitions(n, bits.T.astype(float) @ bits * (n / 2000))
        assert sorted(b for g, _ in plan for b in g) == list(range(64))
        assert sum(t for _, t in plan) == m.RADIUS - len(plan) + 1
        if len(plan) < 5:
            assert any({0, 40, 41, 42, 43} & set(g) == {0, 40, 41, 42, 43} for g, _ in plan)


def test_large_bucket_gives_a_spanning_set():
    prints = np.array([1 << b for b in range(60)] + [0], np.uint64)
    a, _ = m.bucket_links([prints], np.zeros(61, np.int64), 0, 4, None)
    assert len(a) == 60


def test_odd_rows(odd_docs, no_docs):
    out = m.duplicate_classes(odd_docs).collect()
    assert len(out) == odd_docs.count()
    empty = {r["component_id"] for r in out if r["fingerprint"] == 0}
    assert empty == {100}  # NULL, empty and blank texts are one class
    assert {r["component_id"] for r in out if r["doc_id"] in (103, 104)} == {103}
    assert m.duplicate_classes(no_docs).count() == 0
    kept = m.keep_one(odd_docs, words=5, similarity=0.8)
    assert kept.columns == odd_docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids.count(0) == 1 and ids.count(None) == 2 and 101 not in ids and 100 in ids and 104 not in ids and 107 not in ids
    assert m.keep_one(no_docs, words=5, similarity=0.8).count() == 0


def test_wide_fingerprints_catch_edited_copies(spark):
    rng = random.Random(5)
    rows, n = [], 60
    for i in range(n):
        w = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((2 * i, " ".join(w)))
        w[rng.randrange(300)] = "changed"
        w[rng.randrange(300)] = "words"
        rows.append((2 * i + 1, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in m.duplicate_classes(docs, words=5, tables=4, similarity=0.8).collect()}
    assert sum(out[2 * i + 1] == 2 * i for i in range(n)) >= 0.9 * n
    assert all(out[2 * i] == 2 * i for i in range(n))
