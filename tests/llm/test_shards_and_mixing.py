import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import hash_tree_sharding as shards
from ledgerlens.llm import source_mixing as mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- sharding ---------------------------------------------------------------------------

def test_shards_slots_and_checksums(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    out = shards.sharded(documents).collect()
    assert len(out) == len(texts)
    slots = defaultdict(list)
    for r in out:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key"
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(out) == sorted(shards.sharded(documents.repartition(7)).collect())


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 39, 64, 100])
def test_a_new_shard_only_takes(spark, n):
    ids = spark.range(4000)
    rows = ids.select(shards.shard_of(F.col("id"), n).alias("a"), shards.shard_of(F.col("id"), n + 1).alias("b")).collect()
    assert all(r["b"] in (r["a"], n) for r in rows)
    moved = sum(r["b"] == n for r in rows)
    assert abs(moved - 4000 / (n + 1)) < 6 * (4000 / (n + 1)) ** 0.5 + 1


def test_shares_follow_weights(spark):
    heavy = shards.Tree(2, 2, weights=((5, 3.0),))
    counts = Counter(r["s"] for r in spark.range(20_000).select(shards.shard_of(F.col("id"), 8, heavy).alias("s")).collect())
    assert abs(counts[5] - 6000) < 400 and all(abs(counts[s] - 2000) < 300 for s in range(8) if s != 5)


@pytest.mark.parametrize("weight", [0.2, 3.0])
def test_a_weight_moves_rows_of_its_own_shard_only(spark, weight):
    """With 40 shards on a grid of 16 racks, no row moves between two shards whose weights stay."""
    changed = shards.Tree(weights=((5, weight),))
    rows = spark.range(40_000).select(
        shards.shard_of(F.col("id"), 40).alias("a"), shards.shard_of(F.col("id"), 40, changed).alias("b")).filter("a <> b").collect()
    assert len(rows) > 400 and {r["b"] if weight > 1 else r["a"] for r in rows} == {5}


def descent(key, n, regions, racks, weights):
    """Region, rack and shard one after the other, from the same hashes, in plain Python."""
    def chain(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed)
        return seed

    def draw(s):
        u = ((chain(*([] if key is None else [struct.pack("<q", key)]), struct.pack("<i", s)) >> 11) + 0.5) * 2.0**-53
        return -math.log(u) / weights.get(s, 1.0)

    left = list(range(n))
    for part in (lambda s: s % regions, lambda s: s // regions % racks, lambda s: s):
        nodes = defaultdict(list)
        for s in left:
            nodes[part(s)].append(s)
        left = min(nodes.values(), key=lambda below: min((draw(s), s) for s in below))
    return left[0]


@pytest.mark.parametrize("n,tree", [(40, shards.Tree()), (1, shards.Tree()), (100, shards.Tree(3, 5, ((7, 4.0), (98, 0.5)))), (7, shards.Tree(8, 2))])
def test_descent_by_hand(spark, n, tree):
    keys = [None, 0, -1, 5, 2**62, *range(1000, 1300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = [(r["k"], r["s"]) for r in df.select("k", shards.shard_of(F.col("k"), n, tree).alias("s")).collect()]
    assert got == [(k, descent(k, n, tree.regions, tree.racks, dict(tree.weights))) for k in keys]


def test_odd_rows_of_shards(odd_docs, no_docs, tmp_path):
    out = shards.sharded(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert {r["size"] for r in out if r["doc_id"] == 100} == {16} and {r["text_crc32"] for r in out if r["doc_id"] == 100} == {0}
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1
    assert len({(r["shard"], r["slot"]) for r in out}) == len(out)
    assert shards.sharded(no_docs).count() == 0
    with pytest.raises(ValueError):
        shards.sharded(no_docs, shards=0)
    shards.write_shards(odd_docs, f"{tmp_path}/out")  # has a column named shard, which stays
    back = odd_docs.sparkSession.read.parquet(f"{tmp_path}/out")
    assert back.count() == odd_docs.count() and {r["shard"] for r in back.collect()} == {"x"} and "shard_" in back.columns


# ---- mixing -----------------------------------------------------------------------------

def brute_targets(sizes, cap=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    rest, open_, got = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if rest * weight[s] / total > cap * sizes[s]}
        if not above:
            got |= {s: rest * weight[s] / total for s in open_}
            break
        got |= {s: float(cap * sizes[s]) for s in above}
        rest -= sum(cap * sizes[s] for s in above)
        open_ -= above
    return got


def check_mix(rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = brute_targets(dict(sizes))
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    return sizes, taken, want


def test_targets_and_epochs(documents):
    rows = mixing.mixture(documents).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert all(r["size"] == len(WORD.findall(texts[r["doc_id"]])) for r in rows)
    sizes, taken, want = check_mix(rows)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    for s in sizes:  # complete epochs first: all but one document are taken e or e + 1 times
        times = [r["taken"] / r["size"] for r in rows if r["source"] == s and r["size"]]
        e = int(want[s] // sizes[s])
        assert sum(t not in (e, e + 1) for t in times) <= 1
    assert sorted(rows) == sorted(mixing.mixture(documents.repartition(5)).collect())


def test_prefix_in_key_order(spark):
    rows = [(i, "w " * (1 + i % 7), "b" if i % 2 else "a") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = {r["doc_id"]: r["k"] for r in docs.select("doc_id", mixing.sampling_key(F.col("doc_id"), F.lit(1.0)).alias("k")).collect()}
    out = [r for r in mixing.mixture(docs, quality=F.lit(1.0)).collect() if r["source"] == "b"]
    rest = round(out[0]["target"]) % out[0]["source_size"]
    base = round(out[0]["target"]) // out[0]["source_size"]
    for r in sorted(out, key=lambda r: keys[r["doc_id"]]):
        extra = min(max(rest, 0), r["size"])
        assert r["taken"] == base * r["size"] + extra
        rest -= r["size"]


def test_small_sources_stop_at_their_cap(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a"] * 3 + ["b"] * 200 + ["c"] * 2 + [None] * 40 + ["\U0001F642"] * 5 + ["é"] * 5)]
    out = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes, taken, want = check_mix(out)
    assert taken["a"] == 3 * sizes["a"] and all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_odd_rows_of_the_mix(odd_docs, no_docs):
    rows = mixing.mixture(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    check_mix(rows)
    assert mixing.mixture(no_docs).count() == 0
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    words = sum(len(WORD.findall(r["text"])) for r in mixed.collect())
    assert abs(words - sum(r["taken"] for r in rows)) == 0
    assert all(r["n_chars"] == len(r["text"]) for r in mixed.collect())
    assert mixing.mixed_documents(no_docs).count() == 0


def test_first_words_keep_the_text_between(spark):
    df = spark.createDataFrame([(" a\n b  c d",)], "t string")
    assert df.select(mixing.first_words(F.col("t"), F.lit(2))).first()[0] == " a\n b  "
