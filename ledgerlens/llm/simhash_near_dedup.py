"""SimHash near-duplicate search by the generalised pigeonhole principle.

A text's fingerprint has one bit per hash bit: set where more than half of its word
shingles have it set.  Texts are linked when their fingerprints differ in at most
``radius`` bits.  The search

1. counts how often each pair of bits is set together, over all fingerprints;
2. groups correlated bits into partitions, so that redundancy ends up inside one of them;
3. gives each partition its own threshold.  If the thresholds of ``m`` partitions sum to
   ``radius - m + 1`` and two fingerprints are further apart than the threshold in every
   partition, they differ in more than ``radius`` bits; so probing each partition within
   its threshold finds every link.  A dynamic programme picks the thresholds (-1 skips a
   partition) and the number of partitions with the lowest estimated cost;
4. probes: a fingerprint is filed under its partition with every choice of ``threshold``
   bits blanked, so two that differ there in no more bits meet in some bucket;
5. verifies by the exact distance inside a bucket.

A bucket keeps a link for every pair of its first few members, and a spanning set of
links where it is large, so near copies by the thousand cost no square of links.
Buckets above ``BUCKET`` rows are cut into blocks, each pair of blocks a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, comb, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import text_slices
from ledgerlens.session import cut_lineage

RADIUS = 4
BUCKET = 8192
ALL_PAIRS = 48
# Relative costs the planner weighs: one bucket row shuffled and sorted, one distance computed.
ROW_COST, PAIR_COST = 1000.0, 4.0
LARGEST_THRESHOLD = 3


# ---- fingerprints -------------------------------------------------------------------

def shingle_hashes(text: bytes, words: int, seed: int) -> list[int]:
    """XXH64 of each run of ``words`` words, joined by spaces; A-Z count as a-z."""
    import xxhash

    parts = text.lower().split()
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), seed)] if parts else []
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[words - 1:]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint per document from the hashes of all documents, laid end to end."""
    out = np.zeros(len(counts), np.uint64)
    some = counts > 0
    if not some.any():
        return out
    n = counts[some]
    first = np.cumsum(n) - n
    # runs of at most 255 hashes add up in single bytes, eight lanes at a time
    runs = -(-n // 255)
    run_at = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    lanes = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).view(np.uint64)
    sums = np.add.reduceat(lanes, run_at, axis=0).view(np.uint8).reshape(-1, 64)
    ones = np.add.reduceat(sums, np.cumsum(runs) - runs, axis=0, dtype=np.int64)
    bits = (2 * ones > n[:, None]).astype(np.uint8)
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """Further independent hashes of the same shingles; table 0 is the hash itself."""
    if table == 0:
        return hashes
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * table & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, *, words: int = 4, seed: int = 42, tables: int = 1) -> DataFrame:
    """``doc_id`` and the fingerprints ``f0`` .. ``f{tables-1}`` of every whole text.

    A NULL or wordless text has fingerprint zero.  A text of fewer words than a shingle
    is one shingle.  Repeated rows stay; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            each = [shingle_hashes(t, words, seed) for t in texts]
            counts = np.fromiter(map(len, each), np.int64, len(each))
            flat = np.fromiter((h for hs in each for h in hs), np.uint64, int(counts.sum()))
            made = [majority_bits(_mixed(flat, t), counts).view(np.int64) for t in range(tables)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(m) for m in made]],
                names=["doc_id", *[f"f{t}" for t in range(tables)]])

    schema = "doc_id long, " + ", ".join(f"f{t} long" for t in range(tables))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


# ---- partitions and thresholds --------------------------------------------------------

def bit_counts(nodes: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each pair of their 64 bits is set together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((64, 64))
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(f), 1 << 16):
                bits = np.unpackbits(f[at:at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.float32)
                both += bits.T @ bits
            total += len(f)
        cells = np.append(both.ravel(), total).round().astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(cells)], names=["cell", "n"])

    rows = nodes.select(column).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(4097)
    for r in rows:  # 4,097 rows whatever the input
        cells[r["cell"]] = r["n"]
    return int(cells[4096]), cells[:4096].reshape(64, 64)


def agreement(n: int, both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chance that two random fingerprints agree in a bit, in a pair of bits; the bits' correlation."""
    n = max(n, 1)
    one = np.diag(both) / n
    p11 = both / n
    p10, p01 = one[:, None] - p11, one[None, :] - p11
    p00 = np.clip(1 - p11 - p10 - p01, 0, 1)
    spread = np.sqrt(np.outer(one * (1 - one), one * (1 - one)))
    with np.errstate(divide="ignore", invalid="ignore"):
        related = np.where(spread > 0, np.abs(p11 - np.outer(one, one)) / spread, 0)
    return one**2 + (1 - one) ** 2, p11**2 + p10**2 + p01**2 + p00**2, related


def group_bits(related: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near-equal width; each grows by the bit most correlated with it."""
    left, groups = set(range(64)), []
    for p in range(parts):
        width = 64 // parts + (p < 64 % parts)
        rest = sorted(left)
        seed = max(rest, key=lambda b: (related[b, rest].sum(), -b))
        group = [seed]
        left.discard(seed)
        while len(group) < width:
            best = max(sorted(left), key=lambda b: (related[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(group)
    return groups


def _cost(group: list[int], threshold: int, n: int, single: np.ndarray, pair: np.ndarray, related: np.ndarray) -> float:
    """Bucket rows and distances that a partition costs; its bits are chained by their strongest tie."""
    if threshold < 0:
        return 0.0
    logs = [log(max(single[group[0]], 1e-12))]
    for k, b in enumerate(group[1:], 1):
        tie = max(group[:k], key=lambda x: related[b, x])
        logs.append(log(max(pair[b, tie], 1e-12) / max(single[tie], 1e-12)))
    ways, width = comb(len(group), threshold), len(group)
    meets = 0.5 * n * n * np.exp(sum(logs) * (width - threshold) / width)
    return ways * (n * ROW_COST + meets * PAIR_COST)


def plan_partitions(n: int, both: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Bit groups with their thresholds: the cheapest allocation over 2 .. radius + 1 partitions."""
    single, pair, related = agreement(n, both)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(2, radius + 2):
        groups = group_bits(related, parts)
        # every threshold is held one higher, so that they sum to radius + 1 and none is negative
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            reached: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in state.items():
                for up in range(min(LARGEST_THRESHOLD + 1, radius + 1 - used) + 1):
                    total = cost + _cost(g, up - 1, n, single, pair, related)
                    if used + up not in reached or total < reached[used + up][0]:
                        reached[used + up] = (total, [*chosen, up - 1])
            state = reached
        if radius + 1 in state and (best is None or state[radius + 1][0] < best[0]):
            cost, chosen = state[radius + 1]
            best = (cost, list(zip(groups, chosen, strict=True)))
    if best is None:
        raise ValueError(f"radius {radius} cannot be allocated with thresholds up to {LARGEST_THRESHOLD}")
    return best[1]


def key_masks(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """The bit masks to file under: each used partition with every choice of blanked bits."""
    masks = [sum(1 << b for b in group if b not in blank)
             for group, threshold in plan if threshold >= 0 for blank in combinations(group, threshold)]
    return np.array(masks, np.uint64)


# ---- probing and verifying ------------------------------------------------------------

def _file_rows(nodes: DataFrame, table: int, tables: int, masks: np.ndarray) -> DataFrame:
    names = [f"f{t}" for t in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, 400_000 // len(masks))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                cols = [batch.column(t).to_numpy(zero_copy_only=False).astype(np.int64) for t in range(tables)]
                held = cols[table].view(np.uint64)[:, None] & masks[None, :]
                key = _mixed((held + np.arange(len(masks), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).ravel(), table + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), *[pa.array(np.repeat(c, len(masks))) for c in cols]], names=["key", *names])

    return nodes.select(*names).mapInArrow(run, "key long, " + ", ".join(f"{n} long" for n in names))


def _split_hot(rows: DataFrame, bucket: int) -> DataFrame:
    """Adds the block pair a row works in: (0, 0), or every pair its block of a hot bucket is part of."""
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bucket).select(
        "key", F.ceil(F.col("_n") / bucket).cast("int").alias("_blocks"))
    marked = rows.join(hot, "key", "left").withColumn("_mine", F.pmod(F.xxhash64("f0"), F.coalesce("_blocks", F.lit(1))).cast("int"))
    spread = marked.withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)))
    return spread.withColumn("_a", F.least("_mine", "_other")).withColumn("_b", F.greatest("_mine", "_other")).drop(
        "_blocks", "_mine", "_other")


def _within(x: list[np.ndarray], y: list[np.ndarray], table: int, radius: int, total: int | None) -> np.ndarray:
    ok = np.bitwise_count(x[table] ^ y[table]) <= radius
    if total is not None and ok.any():
        at = np.flatnonzero(ok)
        far = sum(np.bitwise_count(np.broadcast_to(a, ok.shape)[at] ^ np.broadcast_to(b, ok.shape)[at]).astype(np.int64)
                  for a, b in zip(x, y, strict=True)) > total
        ok[at[far]] = False
    return ok


def bucket_links(cols: list[np.ndarray], group: np.ndarray, table: int, radius: int, total: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links inside buckets.  ``group`` is ascending.  Buckets up to ALL_PAIRS give every link, larger a spanning set."""
    edge = np.flatnonzero(np.diff(group)) + 1
    starts = np.concatenate(([0], edge))
    sizes = np.diff(np.concatenate((starts, [len(group)])))
    left, right = [], []
    keep = np.repeat((sizes > 1) & (sizes <= ALL_PAIRS), sizes)
    small, g = [c[keep] for c in cols], group[keep]
    for shift in range(1, ALL_PAIRS):
        if len(g) <= shift:
            break
        same = np.flatnonzero(g[shift:] == g[:-shift])
        if not len(same):
            break
        a, b = [c[same] for c in small], [c[same + shift] for c in small]
        ok = _within(a, b, table, radius, total)
        left.append(a[0][ok])
        right.append(b[0][ok])
    for s, n in zip(starts[sizes > ALL_PAIRS].tolist(), sizes[sizes > ALL_PAIRS].tolist(), strict=True):
        member = [c[s:s + n] for c in cols]
        waiting = np.arange(n)
        while len(waiting):
            todo, waiting = [waiting[0]], waiting[1:]
            while todo and len(waiting):
                at = todo.pop()
                ok = _within([c[waiting] for c in member], [c[at] for c in member], table, radius, total)
                met = waiting[ok]
                if len(met):
                    left.append(np.full(len(met), member[0][at]))
                    right.append(member[0][met])
                    todo.extend(met.tolist())
                    waiting = waiting[~ok]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def fingerprint_links(
    nodes: DataFrame, *, radius: int = RADIUS, tables: int = 1, total_radius: int | None = None, bucket: int = BUCKET
) -> DataFrame:
    """Links ``a`` < ``b`` between distinct fingerprints, enough to connect all that lie within ``radius``.

    ``nodes`` has one row per distinct ``f0``.  With several tables a pair may meet in any
    of them, and must differ in at most ``total_radius`` bits over all of them together.
    """
    names = [f"f{t}" for t in range(tables)]
    found: DataFrame | None = None
    for t in range(tables):
        n, both = bit_counts(nodes, names[t])
        if n == 0:
            break
        rows = _file_rows(nodes, t, tables, key_masks(plan_partitions(n, both, radius)))

        def run(batches: Iterator[pa.RecordBatch], t: int = t) -> Iterator[pa.RecordBatch]:
            def links(cols: list[np.ndarray], g: np.ndarray) -> pa.RecordBatch:
                a, b = bucket_links([c.view(np.uint64) for c in cols], g, t, radius, total_radius)
                a, b = a.view(np.int64), b.view(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

            held: list[np.ndarray] | None = None
            for batch in batches:
                cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if held is not None:
                    cols = [np.concatenate((h, c)) for h, c in zip(held, cols, strict=True)]
                key, a, b = cols[:3]
                change = np.flatnonzero((key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
                group = np.zeros(len(key), np.int64)
                group[change] = 1
                cut = int(change[-1]) if len(change) else 0
                if cut:
                    yield links([c[:cut] for c in cols[3:]], np.cumsum(group)[:cut])
                held = [c[cut:] for c in cols]
            if held is not None and len(held[0]):
                yield links(held[3:], np.zeros(len(held[0]), np.int64))

        dealt = _split_hot(rows, bucket).select("key", "_a", "_b", *names).repartition("key", "_a", "_b").sortWithinPartitions("key", "_a", "_b")
        part = dealt.mapInArrow(run, "a long, b long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return nodes.select(F.col("f0").alias("a"), F.col("f0").alias("b")).limit(0)
    return found.distinct()


# ---- components -----------------------------------------------------------------------

def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node that has a link; root is the smallest node of its component.

    Alternates the two star operations, which only ever replace links by links to smaller
    nodes, until nothing changes; every round is checkpointed, so lost executors cost one round.
    """
    edges = cut_lineage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above a node move to its smallest neighbour
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).unionAll(
            low.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = cut_lineage(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def duplicate_classes(
    docs: DataFrame, *, words: int = 4, seed: int = 42, radius: int = RADIUS, tables: int = 1,
    similarity: float | None = None,
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (long) and ``component_id``.

    ``component_id`` is the smallest ``doc_id`` reachable over links, the document's own
    included.  ``tables`` > 1 computes that many independent fingerprints; two texts then
    link when any table has them within ``radius`` bits and, over all tables, their angle
    is that of two equally long shingle sets with Jaccard ``similarity`` or more.

    NULL and wordless texts share fingerprint zero and so one class.  NULL ids never are
    the smallest unless a class has nothing else.  Repeated rows stay.  An empty table
    gives an empty result.
    """
    total = None
    if similarity is not None:
        total = round(64 * tables * acos(2 * similarity / (1 + similarity)) / pi)
    marked = cut_lineage(fingerprints(docs, words=words, seed=seed, tables=tables))
    others = [f"f{t}" for t in range(1, tables)]
    nodes = marked.groupBy("f0").agg(
        F.min("doc_id").alias("first_id"), *([F.min(F.struct(*others)).alias("_rest")] if others else []))
    nodes = cut_lineage(nodes.select("f0", "first_id", *[F.col("_rest")[c].alias(c) for c in others]))
    links = fingerprint_links(nodes, radius=radius, tables=tables, total_radius=total)
    reached = connected_components(links)
    rooted = nodes.select("f0", "first_id").join(reached.withColumnRenamed("node", "f0"), "f0")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = rooted.join(least, "root").select("f0", "component_id")
    classes = nodes.join(linked.withColumnRenamed("component_id", "_linked"), "f0", "left").select(
        "f0", F.coalesce("_linked", "first_id").alias("component_id"))
    return marked.select("doc_id", "f0").join(classes, "f0").select("doc_id", F.col("f0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each class of texts with Jaccard ``similarity``, see ``shingle_links.keep_least``.

    Fingerprints within the radius find near copies, and the texts decide.  At 0.8 the distance of
    two fingerprints spreads evenly around any limit put there, and a radius that finds nearly
    all pairs cannot be probed by pigeonhole, so MinHash bands find those further apart.
    """
    from ledgerlens.llm.shingle_links import keep_least

    return keep_least(docs, words=words, similarity=similarity)
