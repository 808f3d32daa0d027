"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Every shard in use races for every key with the draw -ln(u) / weight, u being a hash of the
key and the shard.  The draw of a rack is the smallest of its shards', that of a region the
smallest of its racks'; a row descends into the region, then the rack, then the shard of
the smallest draw.  The smallest of exponential draws is itself one whose rate is the sum of
theirs, so every node is chosen in proportion to the weight below it.

All draws but those of a changed shard stay as they are.  So a shard that is added or gains
weight only takes rows, one that loses weight or goes only gives rows away, and no row moves
between two shards that are not changed: movement is confined to the changed subtrees, however
many of the tree's places are in use.  There is no upper number of shards.

Only the key and the tree decide; no row needs another, and only DataFrame functions run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import grouped
from ledgerlens.llm.common import unused

SHARDS = 40


@dataclass(frozen=True)
class Tree:
    """Shard s stands in region s % regions and there in rack s // regions % racks.

    ``weights`` gives shards a weight other than 1; a rack weighs the sum of its shards, a
    region that of its racks.
    """

    regions: int = 4
    racks: int = 4
    weights: tuple[tuple[int, float], ...] = ()

    def __post_init__(self) -> None:
        if self.regions < 1 or self.racks < 1 or any(not w > 0 for _, w in self.weights):
            raise ValueError("a tree has regions, racks and positive weights")


def _draw(key: Column, shard: Column, tree: Tree) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    weight = F.lit(1.0)
    if tree.weights:
        given = F.create_map(*[F.lit(x) for s, w in tree.weights for x in (int(s), float(w))])
        weight = F.coalesce(F.try_element_at(given, shard), weight)
    return F.struct((-F.log(u) / weight).alias("draw"), shard.alias("shard"))


def _descent(key: Column, shards: int, tree: Tree) -> Column:
    """Smallest draw of the tree and its shard: of racks first, then of regions, then of all."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    step = tree.regions * tree.racks

    def smallest(nodes: list[Column]) -> Column:
        return F.array_min(F.array(*nodes)) if len(nodes) > 1 else nodes[0]

    def rack(region: int, number: int) -> Column | None:
        first = number * tree.regions + region
        if first >= shards:
            return None
        own = F.sequence(F.lit(first), F.lit(shards - 1), F.lit(step))
        return F.array_min(F.transform(own, lambda s: _draw(key, s, tree)))

    regions = []
    for g in range(tree.regions):
        racks = [r for r in (rack(g, k) for k in range(tree.racks)) if r is not None]
        if racks:
            regions.append(smallest(racks))
    return smallest(regions)


def shard_of(key: Column, shards: int, tree: Tree = Tree()) -> Column:
    """The shard of a key, 0 to ``shards`` - 1; a NULL key has a shard like any other."""
    return _descent(key, shards, tree)["shard"]


def sharded(docs: DataFrame, *, shards: int = SHARDS, tree: Tree = Tree()) -> DataFrame:
    """Every document's shard and its place in it.

    Columns: ``doc_id``, ``size`` (UTF-8 bytes of the text plus 16), ``text_crc32``, ``law``
    (``key``: the id and the shard count decide), ``shard``, ``slot`` (gapless from 0 in its
    shard, in order of a hash) and ``grown_shard`` (with one shard more).  A NULL text counts as empty.  Rows with the same id share a shard, NULL ids
    too; equal rows have slots of their own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.col("doc_id")
    slim = docs.select(
        key.cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law")).withColumn("_best", _descent(key, shards, tree))
    # with one shard more only that one's draw is new
    grown = F.least(F.col("_best"), _draw(key, F.lit(shards), tree))["shard"]
    slim = slim.select("doc_id", "size", "text_crc32", "law", F.col("_best.shard").alias("shard"), grown.alias("grown_shard"))
    order = [F.xxhash64("doc_id", "text_crc32", "size"), F.asc_nulls_first("doc_id"), F.col("text_crc32"), F.col("size")]
    placed = grouped.number_rows(slim, ["shard"], order, "slot")
    return placed.withColumn("slot", F.col("slot").cast("long") - 1)


def write_shards(docs: DataFrame, folder: str, *, shards: int = SHARDS, tree: Tree = Tree(), files: int = 8) -> None:
    """Write whole rows below ``folder``, a subfolder ``shard=N`` per shard of about ``files`` files each.

    Where ``docs`` has a column named ``shard``, it stays and the folders are named ``shard_=N``.
    """
    (name,) = unused(docs, "shard")
    placed = docs.withColumn(name, shard_of(F.col("doc_id").cast("long"), shards, tree))
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files))
    placed.repartition(shards * files, name, salt).write.partitionBy(name).parquet(folder)
