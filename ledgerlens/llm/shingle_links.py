"""Near copies by the exact Jaccard similarity of word shingles: SimHash and MinHash bands find, the texts decide.

1. Rows with the same set of shingles are one node (128 bits of hash of the sorted set).
2. A node has the SimHash of its set.  ``simhash_near_dedup`` finds the classes of all
   fingerprints within its radius, by the planned pigeonhole; each member of a class is
   compared with the class's first node, and what has the similarity is one component.
3. At 0.8 fingerprints lie further apart than that radius more often than not.  So a node is
   also filed under ``BANDS`` keys, each made of ``BAND_ROWS`` minima.  Two sets of
   Jaccard J share a key with chance 1 - (1 - J^BAND_ROWS)^BANDS: 0.99993 at 0.8, for sets
   of any size, and more above.  This is the only place where a pair can be missed, but for
   the one bit kept of each minimum: pairs that differ in more than ``FAR_BITS`` of 120 are
   passed over, which at 0.8 happens to fewer than one in a million.
4. In rounds, every bucket whose members are not yet one component names a lead and all
   members of other components are compared with it.  The lead then needs no more
   comparison there.  This costs one row per member, and near copies by the thousand are one
   component after a round or two.  There are rounds while step 5 would send more than
   ``WORTH`` rows a member, ``ROUNDS`` at most.
5. In buckets that still hold several components, members outside the largest are dealt in
   blocks against blocks of all members.  A task counts shared shingles of two blocks
   exactly, by a matrix product, and lets go only links that join components.

So no pairs are written but those of a member and a lead, and links.  A comparison takes
the whole texts and their exact shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import text_slices, unused
from ledgerlens.llm.simhash_near_dedup import _mixed, connected_components, fingerprint_links, majority_bits, shingle_hashes
from ledgerlens.session import cut_lineage

BANDS, BAND_ROWS = 24, 5
FAR_BITS = 30
SEED = 42
ROUNDS, WORTH = 6, 3
# Members that are compared with a lead in one task.
STAR = 1_000
# A block of members of one bucket: rows, and shingles of all their texts.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 400_000
# Shingles that are columns of one matrix product.
COLUMNS = 4_096
_CONSTANTS = np.random.default_rng(SEED).integers(0, 2**64, (BANDS * BAND_ROWS, 2), np.uint64)


def with_row_key(docs: DataFrame, names: list[str]) -> DataFrame:
    """Adds two hashes of the whole row, NULLs and their places included; the same on every run."""
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")]
    parts = [p for c in plain for p in (c.isNull(), c)]
    return docs.withColumns({names[0]: F.xxhash64(*parts), names[1]: F.xxhash64(F.lit("second"), *parts)})


def _shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words, SEED), np.uint64))


def sketches(keyed: DataFrame, words: int) -> DataFrame:
    """``h1``, ``h2``, ``doc_id``, and of the text: two hashes of its set, number of shingles, SimHash, bits of the minima, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch, texts in text_slices(batches):
            sets = [_shingle_set(t, words) for t in texts]
            counts = np.fromiter(map(len, sets), np.int64, len(sets))
            some = np.flatnonzero(counts)
            flat, first = np.concatenate([np.zeros(0, np.uint64), *sets]), (np.cumsum(counts) - counts)[some]
            bits, bands = np.zeros((2, len(sets)), np.uint64), np.zeros((len(sets), BANDS), np.uint64)
            for k, (mask, factor) in enumerate(_CONSTANTS if len(some) else []):
                low = np.minimum.reduceat((flat ^ mask) * (factor | np.uint64(1)), first)
                bits[k // 64, some] |= (low >> np.uint64(20) & np.uint64(1)) << np.uint64(k % 64)
                band = k // BAND_ROWS
                bands[some, band] = _mixed(bands[some, band] ^ low, band + 1)
            node = [np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets), np.uint64, len(sets)) for seed in (SEED, SEED + 1)]
            at = np.arange(0, bands.size + 1, BANDS, dtype=np.int32)
            made = [*[pa.array(h.view(np.int64)) for h in node], pa.array(counts), pa.array(majority_bits(flat, counts).view(np.int64)), *[pa.array(b.view(np.int64)) for b in bits],
                    pa.ListArray.from_arrays(pa.array(at), pa.array(bands.view(np.int64).ravel()))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *made], names=["h1", "h2", "doc_id", "set1", "set2", "n", "f0", "s0", "s1", "bands"])

    return keyed.select("h1", "h2", "doc_id", "text").mapInArrow(
        run, "h1 long, h2 long, doc_id long, set1 long, set2 long, n long, f0 long, s0 long, s1 long, bands array<long>")


def _may_be_near(x: str, y: str, similarity: float) -> Column:
    """Sizes and bits allow the similarity."""
    far = F.bit_count(F.col(f"{x}s0").bitwiseXOR(F.col(f"{y}s0"))) + F.bit_count(F.col(f"{x}s1").bitwiseXOR(F.col(f"{y}s1")))
    sizes = F.col(f"{x}n"), F.col(f"{y}n")
    return (F.least(*sizes) >= similarity * F.greatest(*sizes) - 1e-9) & (far <= FAR_BITS)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Number of common values of two sorted arrays without repeats."""
    if len(y) < len(x):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def fingerprint_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """``lead`` and ``node`` of each node whose SimHash links, over any number of others, to that of an earlier node.

    One pair a node: the lead is the first node of the whole class.
    """
    some = nodes.filter("n > 0").select("node", "n", "f0", "s0", "s1")
    me = F.struct("node", "n", "s0", "s1")
    prints = cut_lineage(some.groupBy("f0").agg(F.min(me).alias("lead")))
    reached = connected_components(fingerprint_links(prints.select("f0"))).select(F.col("node").alias("f0"), "root")
    classes = prints.join(reached, "f0", "left").select("f0", "lead", F.coalesce("root", "f0").alias("root"))
    leads = classes.select("f0", "root").join(classes.groupBy("root").agg(F.min("lead").alias("lead")), "root").select("f0", "lead")
    return some.join(leads, "f0").filter((F.col("node") != F.col("lead.node")) & _may_be_near("", "lead.", similarity)).select(
        F.col("lead.node").alias("lead"), "node")


def _star_links(pairs: DataFrame, own: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (``lead``, ``node``) whose shingle sets have the similarity.

    A lead's text goes once to each ``STAR`` of its members, every member's once.
    """
    met = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("_parts"))
    members = pairs.join(met, "lead").select("lead", F.pmod(F.xxhash64("node"), "_parts").cast("int").alias("part"), "node").join(own, "node")
    leads = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).join(own.withColumnRenamed("node", "lead"), "lead")
    columns = ["lead", "part", "node", "text"]
    both = members.select(*columns).unionByName(leads.withColumn("node", F.lit(None).cast("long")).select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, mine = None, np.zeros(0, np.uint64)
        for batch, texts in text_slices(batches):
            lead, part, node = (batch.column(k).to_pylist() for k in range(3))
            near = []
            for i, text in enumerate(texts):
                own_set = _shingle_set(text, words)
                if node[i] is None:
                    of, mine = (lead[i], part[i]), own_set
                    continue
                if of != (lead[i], part[i]):
                    raise RuntimeError("a member came before its lead")
                shared = _shared(mine, own_set)
                if shared >= similarity * (len(mine) + len(own_set) - shared) - 1e-9:
                    near.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(near, pa.int64())) for k in (0, 2)], names=["a", "b"])

    dealt = both.repartition("lead", "part").sortWithinPartitions("lead", "part", F.asc_nulls_first("node"))
    return dealt.mapInArrow(run, "a long, b long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shared values of every left with every right set."""
    values = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2^24 are exact
    places = []
    for sets in (left, right):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(values, flat)
        held = at < len(values)
        held[held] = values[at[held]] == flat[held]
        order = np.argsort(at[held], kind="stable")
        places.append((row[held][order], at[held][order]))
    for start in range(0, len(values), COLUMNS):
        width = min(COLUMNS, len(values) - start)
        some = []
        for sets, (row, at) in zip((left, right), places, strict=True):
            a, b = np.searchsorted(at, [start, start + width])
            some.append(np.zeros((len(sets), width), np.float32))
            some[-1][row[a:b], at[a:b] - start] = 1
        out += some[0] @ some[1].T
    return out


def _joining(near: np.ndarray, nodes: tuple[np.ndarray, np.ndarray], roots: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """Of the near pairs (row, column), enough to join all components they touch."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in np.argwhere(near).tolist():
        a, b = top(int(roots[0][i])), top(int(roots[1][j]))
        if a != b:
            parent[a] = b
            out.append((int(nodes[0][i]), int(nodes[1][j])))
    return out


def _block_plan(open_rows: DataFrame) -> DataFrame:
    """``key``, its largest component, how many blocks its other members and all members are, and the rows that sends."""
    of_root = open_rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_s"))
    most = F.max(F.struct("_c", "root", "_s"))
    plan = of_root.groupBy("key").agg(most.alias("_top"), F.sum("_c").alias("_n"), F.sum("_s").alias("_all"))
    size = lambda count, shingles: F.ceil(F.greatest(count / BLOCK_ROWS, shingles / BLOCK_SHINGLES)).cast("int")
    few = F.col("_n") - F.col("_top._c")
    plan = plan.withColumns({"_right": size(F.col("_n"), F.col("_all")), "_left": size(few, F.col("_all") - F.col("_top._s"))})
    return plan.select("key", F.col("_top.root").alias("_most"), "_left", "_right", "_n", (few * F.col("_right") + F.col("_n") * F.col("_left")).alias("_sent"))


def _block_links(open_rows: DataFrame, plan: DataFrame, own: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links that join the components within each bucket; ``open_rows``: key, node, root, n."""
    rows = open_rows.join(plan.select("key", "_most", "_left", "_right"), "key")
    some = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    few = rows.filter(F.col("root") != F.col("_most")).select("key", place("_left", 1).alias("i"), F.explode(some("_right")).alias("j"), F.lit(0).alias("side"), "node", "root")
    all_ = rows.select("key", F.explode(some("_left")).alias("i"), place("_right", 2).alias("j"), F.lit(1).alias("side"), "node", "root")

    def links(held: list[list[tuple[int, int, np.ndarray]]]) -> list[tuple[int, int]]:
        if not (held[0] and held[1]):
            return []
        sets = [[s for *_, s in side] for side in held]
        nodes, roots = (tuple(np.array([x[k] for x in side]) for side in held) for k in (0, 1))
        shared = common_counts(*sets)
        sizes = [np.array([len(s) for s in side], np.float64) for side in sets]
        near = shared >= similarity * (sizes[0][:, None] + sizes[1][None, :] - shared) - 1e-9
        return _joining(near & (roots[0][:, None] != roots[1][None, :]), nodes, roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, [[], []]
        for batch, texts in text_slices(batches):
            key, i, j, side, node, root = (batch.column(k).to_pylist() for k in range(6))
            found = []
            for k, text in enumerate(texts):
                if now != (key[k], i[k], j[k]):
                    found += links(held)
                    now, held = (key[k], i[k], j[k]), [[], []]
                held[side[k]].append((node[k], root[k], _shingle_set(text, words)))
            yield _links_batch(found)
        yield _links_batch(links(held))

    dealt = few.unionByName(all_).join(own, "node").select("key", "i", "j", "side", "node", "root", "text")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def _links_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def near_roots(nodes: DataFrame, texts: DataFrame, words: int, similarity: float, *, rounds: int = ROUNDS) -> DataFrame:
    """``node`` and ``root`` of every node that has a link: components of all pairs found of Jaccard ``similarity`` or more."""
    keys = nodes.filter("n > 0").select(F.explode("bands").alias("key"), "node")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key")
    met = cut_lineage(keys.join(shared, "key").select("node").distinct())
    alike = cut_lineage(fingerprint_pairs(nodes, similarity))
    wanted = met.unionByName(alike.select("node")).unionByName(alike.select(F.col("lead").alias("node"))).distinct().join(
        nodes.select("node", "first.h1", "first.h2"), "node")
    own = cut_lineage(texts.join(wanted, ["h1", "h2"]).select("node", "text").dropDuplicates(["node"]))
    # each node has one lead here, and no lead has another
    stars = cut_lineage(_star_links(alike, own, words, similarity))
    roots = stars.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(stars.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    # of the bands only buckets that the fingerprints left in several components
    filed = nodes.join(met, "node", "left_semi").join(roots, "node", "left").select(
        F.explode("bands").alias("key"), "node", "n", "s0", "s1", F.coalesce("root", "node").alias("root"))
    still = filed.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high").select("key")
    labelled = cut_lineage(filed.join(still, "key"))
    for k in range(rounds + 1):
        plan = cut_lineage(_block_plan(labelled).filter("_sent > 0"))
        size = plan.agg(F.sum("_n"), F.sum("_sent")).first()
        if not size[0]:
            break
        last = k == rounds or size[1] <= WORTH * size[0]
        labelled = labelled.join(plan.select("key"), "key", "left_semi")
        if last:
            more = _block_links(labelled, plan, own, words, similarity)
        else:
            leads = labelled.join(plan.select("key", "_most"), "key").filter(F.col("root") != F.col("_most")).groupBy("key").agg(
                F.min(F.struct("node", "n", "s0", "s1", "root")).alias("lead"))
            rows = cut_lineage(labelled.join(leads, "key").filter(F.col("node") != F.col("lead.node")))
            pairs = rows.filter((F.col("root") != F.col("lead.root")) & _may_be_near("", "lead.", similarity)).select(F.col("lead.node").alias("lead"), "node").distinct()
            more = _star_links(cut_lineage(pairs), own, words, similarity)
        before = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = connected_components(cut_lineage(more).unionByName(before))
        if last:
            break
        labelled = rows.select("key", "node", "n", "s0", "s1").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return roots


def keep_least(docs: DataFrame, *, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each class of near copies, all its columns: that of the least (``doc_id``, row hash), NULL ids last.

    Rows are linked when the sets of their runs of ``words`` words have Jaccard
    ``similarity`` or more (a text of fewer words is one run); a class is what links
    connect.  Ids decide on no other row's text: rows that repeat an id, or have none, are
    searched like all others.  Of rows alike in all columns one stays.  NULL and wordless
    texts are one class, but a row that has neither an id nor a word stays.
    """
    h1, h2, drop, repeated = unused(docs, "_h1", "_h2", "_drop", "_repeated")
    keyed = with_row_key(docs, [h1, h2])
    texts = keyed.select(F.col(h1).alias("h1"), F.col(h2).alias("h2"), F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    marked = cut_lineage(sketches(texts, words).filter("n > 0 OR doc_id IS NOT NULL"))
    rows = marked.groupBy("h1", "h2", "doc_id", "set1", "set2").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    # numbered once both hashes have told the sets apart; the frozen copy keeps the numbers
    nodes = cut_lineage(marked.groupBy("set1", "set2").agg(F.min(me).alias("first"), F.first(F.struct("n", "f0", "s0", "s1", "bands")).alias("_s")).select(
        F.monotonically_increasing_id().alias("node"), "set1", "set2", "first", "_s.*"))
    roots = near_roots(nodes, texts.drop("doc_id"), words, similarity)
    linked = nodes.select("node", "first").join(roots, "node")
    least = linked.groupBy("root").agg(F.min("first").alias("stays"))
    stays = nodes.select("node", "set1", "set2", "first").join(linked.join(least, "root").select("node", "stays"), "node", "left").select(
        "set1", "set2", F.coalesce("stays", "first").alias("stays"))
    acts = cut_lineage(rows.join(stays, ["set1", "set2"]).select(
        F.col("h1").alias(h1), F.col("h2").alias(h2), ((F.col("stays.h1") != F.col("h1")) | (F.col("stays.h2") != F.col("h2"))).alias(drop),
        F.col("repeated").alias(repeated)).filter(F.col(drop) | F.col(repeated)))
    left = keyed.join(acts, [h1, h2], "left").filter(~F.coalesce(F.col(drop), F.lit(False)))
    again = F.coalesce(F.col(repeated), F.lit(False))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plain = left.filter(~again).select(*columns)
    if acts.filter(F.col(repeated) & ~F.col(drop)).isEmpty():
        return plain
    return plain.unionByName(left.filter(again).dropDuplicates([h1, h2]).select(*columns))
