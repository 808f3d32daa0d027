"""Benchmark decontamination: MinHash containment search, partitioned by size, verified exactly.

A benchmark item of a few dozen words inside a document of thousands has a tiny Jaccard
similarity with it, so plain MinHash would need hopelessly many hashes.  Here items are
partitioned by their number of shingles, [2^k, 2^(k+1)).  For every class a document is
seen as windows of up to 2^(k+2) shingles, each overlapping the next by half, so that any
passage the length of an item lies whole within one window and its similarity with that
window is bounded from below: at containment 0.8 it is at least 0.19, and 32 single-row
bands miss it with a chance of 0.81^32 = 0.001.

A window whose minimum agrees with an item's in any band is a candidate.  A candidate pair
of document and item is verified by the exact share of the item's distinct shingles found
anywhere in the document.

An item of fewer words than a shingle is its whole word sequence, looked up among the
document's runs of as many words.

The items are the stated query set: they go to every task in blocks of at most
``BLOCK_ENTRIES`` shingles and minima, one pass over the documents per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_rows, per_worker, text_name, text_slices
from ledgerlens.session import cut_lineage

WORDS = 5
CONTAINMENT = 0.8
BANDS = 32
# At most about 20 MB of item shingles and sketches in a task.
BLOCK_ENTRIES = 1_000_000
CACHED_WORDS = 200_000
STRIPPED = ".,;:!?\"'()[]{}<>#*$%&|«»“”„‘’…–—-_/\\=+~`^@"
ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hash of a word without the punctuation around it; 0 for punctuation alone."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        bare = word.strip(STRIPPED)
        self[word] = h = (xxhash.xxh64_intdigest(bare) | 1) if bare else 0
        return h


def shingles(texts: list[str], cache: dict, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``words`` words of all texts end to end, and how many each text has."""
    each = [t.lower().split() for t in texts]
    flat = np.fromiter(map(cache.__getitem__, chain.from_iterable(each)), np.uint64, sum(map(len, each)))
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, each), np.int64, len(each)))
    real = flat != 0
    flat, owner = flat[real], owner[real]
    n = len(flat) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(words):
        h = (h ^ flat[k:k + n]) * ODD
        h ^= h >> np.uint64(29)
    whole = owner[:n] == owner[words - 1:]
    return h[whole], np.bincount(owner[:n][whole], minlength=len(texts))


def band_hash(h: np.ndarray, band: int) -> np.ndarray:
    """One of a family of 32-bit hashes of the shingles; a chance agreement only costs a check."""
    mixed = (band + 1) * 0xD1B54A32D192ED03 & (2**64 - 1)
    return ((h >> np.uint64(32)).astype(np.uint32) ^ np.uint32(mixed >> 32)) * np.uint32(mixed & 0xFFFFFFFF | 1)


class ItemBlock:
    """Sketches and shingles of one block of items, as sent to the tasks; ``runs`` has the words of an item's shingles."""

    def __init__(self, ids: list[int], parts: list[np.ndarray], runs: list[int], words: int, bands: int) -> None:
        self.ids, self.parts, self.words, self.bands = np.array(ids, np.int64), parts, words, bands
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, run in enumerate(runs):
            if run < words:
                self.short.setdefault(run, {}).setdefault(int(parts[i][0]), []).append(i)
        level = np.array([len(p).bit_length() - 1 if run == words else -1 for p, run in zip(parts, runs, strict=True)])
        for k in np.unique(level[level >= 0]).tolist():
            member = np.flatnonzero(level == k)
            made = []
            for band in range(bands):
                least = np.array([band_hash(parts[i], band).min() for i in member], np.uint32)
                order = np.argsort(least, kind="stable")
                made.append((least[order], member[order]))
            self.classes[k] = made

    def candidates(self, h: np.ndarray, counts: np.ndarray, bands: int) -> set[tuple[int, int]]:
        """(document, item) positions that share a minimum in some window and band."""
        found: set[tuple[int, int]] = set()
        if not len(h) or not self.classes:
            return found
        lowest = min(self.classes)
        base = 1 << (lowest + 1)  # windows are two steps of 2^(k+1)
        docs = np.flatnonzero(counts)
        n = counts[docs]
        blocks = -(-n // base)
        first = np.cumsum(n) - n
        at = np.repeat(first, blocks) + base * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        for band in range(bands):
            low, held, owner = np.minimum.reduceat(band_hash(h, band), at), blocks, np.repeat(docs, blocks)
            for k in range(lowest, max(self.classes) + 1):
                if k > lowest:  # merge steps in twos
                    start = np.cumsum(held) - held
                    held = -(-held // 2)
                    pair = np.repeat(start, held) + 2 * (np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held))
                    low, owner = np.minimum.reduceat(low, pair), np.repeat(docs, held)
                if k in self.classes:
                    minima, member = self.classes[k][band]
                    window = low.copy()  # a step with the one after it in the same document
                    joined = owner[1:] == owner[:-1]
                    window[:-1][joined] = np.minimum(low[:-1], low[1:])[joined]
                    spot = np.searchsorted(minima, window)
                    spot[spot == len(minima)] = 0
                    for w in np.flatnonzero(minima[spot] == window).tolist():
                        s = int(spot[w])
                        while s < len(minima) and minima[s] == window[w]:
                            found.add((int(owner[w]), int(member[s])))
                            s += 1
        return found


    def hits(self, texts: list[bytes], cache: dict, containment: float) -> Iterator[tuple[int, int, int, int]]:
        """(document, item) positions, the item's shingles and how many of them the document has."""
        plain = [t.decode("utf-8", "replace") for t in texts]
        if self.classes:
            h, counts = shingles(plain, cache, self.words)
            ends = np.cumsum(counts)
            for d, i in sorted(self.candidates(h, counts, self.bands)):
                own, item = h[ends[d] - counts[d]:ends[d]], self.parts[i]
                shared = int(np.isin(item, own).sum())
                if shared >= containment * len(item) - 1e-9:
                    yield d, i, len(item), shared
        for run, wanted in self.short.items():
            h, counts = shingles(plain, cache, run)
            at = np.flatnonzero(np.isin(h, np.fromiter(wanted, np.uint64, len(wanted))))
            owner = np.repeat(np.arange(len(texts)), counts)[at]
            for d, found in sorted(set(zip(owner.tolist(), h[at].tolist(), strict=True))):
                for i in wanted[found]:
                    yield d, i, 1, 1


def _blocks(items: DataFrame, words: int, bands: int, limit: int) -> Iterator[ItemBlock]:
    """Items in id order, cut into blocks; only one block is held at a time."""
    cache, ids, parts, runs, held = _Words(), [], [], [], 0
    ordered = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter(
        "item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text")
    for row in ordered.toLocalIterator():
        run = min(words, len(shingles([row[1]], cache, 1)[0]))
        if not run:
            continue
        h = np.unique(shingles([row[1]], cache, run)[0])
        size = len(h) + bands
        if held and held + size > limit:
            yield ItemBlock(ids, parts, runs, words, bands)
            ids, parts, runs, held = [], [], [], 0
        ids.append(row[0])
        parts.append(h)
        runs.append(run)
        held += size
    if ids:
        yield ItemBlock(ids, parts, runs, words, bands)


def contained_items(
    docs: DataFrame, items: DataFrame, *, containment: float = CONTAINMENT, words: int = WORDS,
    bands: int = BANDS, block: int = BLOCK_ENTRIES,
) -> DataFrame:
    """Pairs (``doc_id``, ``item_id``, ``item_shingles``, ``shared_shingles``, ``containment``).

    Words are lower-cased and freed of the punctuation around them; punctuation alone is no
    word.  An item of fewer than ``words`` words counts as one shingle, its whole word
    sequence.  A NULL or wordless item is found nowhere, and one without an id is not
    reported, for the pair would have no name (``without_items`` finds it all the same).
    Documents with a NULL id are searched and reported with it.  Repeated rows give one pair; an item id
    that repeats with other text is reported with its best match.
    """
    out: DataFrame | None = None
    schema = "doc_id long, item_id long, item_shingles int, shared_shingles int"
    for made in _blocks(items, words, bands, block):
        sent = docs.sparkSession.sparkContext.broadcast(made)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            part, cache = sent.value, per_worker("bare words", _Words)
            for batch, texts in text_slices(batches):
                rows = [(d, int(part.ids[i]), size, shared) for d, i, size, shared in part.hits(texts, cache, containment)]
                if rows:
                    at, ids, sizes, shared = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()),
                         pa.array(shared, pa.int32())], names=["doc_id", "item_id", "item_shingles", "shared_shingles"])

        hits = cut_lineage(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema + ", containment double")
    share = F.col("shared_shingles") / F.col("item_shingles")
    return out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("item_shingles", "shared_shingles"), F.struct(share, "item_shingles")).alias("_m")).select(
        "doc_id", "item_id", "_m.*").withColumn("containment", share)


def without_items(
    docs: DataFrame, items: DataFrame, *, containment: float = CONTAINMENT, words: int = WORDS,
    bands: int = BANDS, block: int = BLOCK_ENTRIES,
) -> DataFrame:
    """The rows of ``docs`` that contain no item; all their columns.

    Each row is judged by its own text, whatever its id, and each item by its text, with
    or without an id.  The blocks of items follow one another in one pass; nothing is shuffled.
    """
    texts = items.select(F.lit(0).cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    column, left = text_name(docs), docs
    for made in _blocks(texts, words, bands, block):
        sent = docs.sparkSession.sparkContext.broadcast(made)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            part, cache = sent.value, per_worker("bare words", _Words)
            for batch, slice_ in text_slices(batches, column):
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, *_ in part.hits(slice_, cache, containment)]] = False
                yield batch.filter(pa.array(clean))

        left = map_rows(left, run, [])
    return left
