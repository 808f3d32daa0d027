"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement.

Every document draws an exponential key, -ln(u) / w, where u is a hash of its id and w a
quality weight of its text: the smaller the key, the earlier it is sampled.  A source whose
target is e times its size plus a rest takes e complete epochs, then documents in key order
until their prefix sum reaches the rest.  The last one is cut to the words that still fit.

Prefix sums need no group in one task: the rows are range-sorted by source and key and each
partition adds the totals before it (``functions.grouped.running_total``).  They only serve
to find each source's cut, after which a document's share follows from its own key and its
source's row; texts are not shuffled unless the sources are too many to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import grouped
from ledgerlens.llm.common import sent_if_small, unused
from ledgerlens.session import cut_lineage

SHARES = (5, 2, 1)
CAP = 3
SEED = 20_011
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, words: Column) -> Column:
    """1 for plain text, down to 0.1 as runs of symbols come up to every word and more."""
    noise = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]+|!!+")), F.lit(0))
    return F.greatest(F.lit(0.1), 1 / (1 + 8 * noise / F.greatest(words, F.lit(1))))


def sampling_key(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(u) / weight


def targets(sizes: DataFrame, *, shares: tuple[int, ...] = SHARES, cap: int = CAP) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from one row per source.

    Sources are numbered by code point, NULL last, and weigh ``shares`` in turn.  They share
    the sum of all sizes by weight; one that would get more than ``cap`` times its size gets
    that, and the excess goes to the others by weight, until none is above.  With a level l,
    a source's target is min(l * weight, cap * size); each round raises l over the sources
    still below their caps.  The rounds aggregate the source table; nothing is collected.
    """
    numbered = grouped.number_rows(sizes, [], [F.asc_nulls_last("source")], "place")
    weight = F.element_at(F.array(*[F.lit(s) for s in shares]), F.pmod(F.col("place") - 1, F.lit(len(shares))) + 1)
    weighed = cut_lineage(numbered.select("source", "source_size", weight.alias("_weight")))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level > before:
        before = level
        full = F.col("_weight") * F.lit(level) > F.col("source_size") * cap
        held, rest = weighed.agg(
            F.sum(F.when(full, F.col("source_size") * cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("_weight")))).first()
        if not rest:
            break
        level = max(level, (total - held) / rest)
    return weighed.select("source", "source_size", F.least(F.col("_weight") * F.lit(level), F.col("source_size") * F.lit(float(cap))).alias("target"))


def source_cuts(units: DataFrame, *, shares: tuple[int, ...] = SHARES, cap: int = CAP) -> DataFrame:
    """One row per source: its sizes and target, its complete epochs, and where the fractional selection ends.

    ``units`` has ``source``, ``key``, ``doc_id`` and ``size``; rows that agree in all four
    are sampled together and share what is left for them.
    """
    tied = units.filter("size > 0").groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, shares=shares, cap=cap)
    words = F.least(F.round("target").cast("long"), F.col("source_size") * cap)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long"))
    goal = cut_lineage(goal.withColumn("rest", words - F.col("epochs") * F.col("source_size")))
    summed = grouped.running_total(
        tied.withColumn("all", F.col("n") * F.col("size")), ["source"], [F.col("key"), F.asc_nulls_first("doc_id"), F.col("size")], "all", "upto")
    rests = goal.select(F.col("source").alias("_s"), "rest")
    last = summed.join(rests, F.col("source").eqNullSafe(F.col("_s"))).filter(
        (F.col("upto") - F.col("all") < F.col("rest")) & (F.col("rest") <= F.col("upto"))).select(
        "_s", F.struct("key", "doc_id", "size").alias("last"), F.floor((F.col("rest") - F.col("upto") + F.col("all")) / F.col("n")).cast("long").alias("part"))
    return cut_lineage(goal.drop("rest").join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))


def _units(docs: DataFrame, quality: Column | None, seed: int, names: list[str]) -> DataFrame:
    size, key = names
    sized = docs.withColumn(size, word_count(F.col("text")))
    return sized.withColumn(key, sampling_key(F.col("doc_id"), quality if quality is not None else quality_weight(F.col("text"), F.col(size)), seed))


def _taken(size: Column, key: Column, doc_id: Column, cut: str) -> Column:
    own = F.struct(key.alias("key"), doc_id.alias("doc_id"), size.alias("size"))
    last = F.col(f"{cut}.last")
    extra = F.when(last.isNull(), 0).when(own < last, size).when(own == last, F.col(f"{cut}.part")).otherwise(0)
    return (F.col(f"{cut}.epochs") * size + F.when(size > 0, extra).otherwise(0)).cast("long")


def mixture(
    docs: DataFrame, *, quality: Column | None = None, shares: tuple[int, ...] = SHARES, cap: int = CAP, seed: int = SEED
) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted) per document.

    Sizes count words.  NULL and wordless texts have size 0 and are never taken; a NULL
    source is a source, the last.  NULL ids share one draw and are told apart by size.
    Equal rows share what their place in the order gets.  ``quality`` is a positive Column
    over the columns of ``docs``.
    """
    slim = cut_lineage(_units(docs, quality, seed, ["_size", "_key"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("_size").alias("size"), F.col("_key").alias("key")))
    cuts = source_cuts(slim, shares=shares, cap=cap).select(F.col("source").alias("_s"), F.struct("epochs", "last", "part").alias("cut"), "source_size", "target")
    return slim.join(sent_if_small(cuts), F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "size", "source_size", "target", _taken(F.col("size"), F.col("key"), F.col("doc_id"), "cut").alias("taken"))


def first_words(text: Column, words: Column) -> Column:
    """The beginning of ``text`` up to its ``words``-th word and the white space after it."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.array_join(F.slice(pieces, F.lit(1), (words + lead).cast("int")), "")


def mixed_documents(
    docs: DataFrame, *, quality: Column | None = None, shares: tuple[int, ...] = SHARES, cap: int = CAP, seed: int = SEED
) -> DataFrame:
    """The mix itself: a row of ``docs`` for every time it is taken, the last of a source cut to fit; all columns.

    ``n_chars``, if there, is set to the length of a text that was cut.
    """
    size, key, cut, taken, copy, source = unused(docs, "_size", "_key", "_cut", "_taken", "_copy", "_s")
    units = _units(docs, quality, seed, [size, key])
    slim = cut_lineage(units.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col(size).alias("size"), F.col(key).alias("key")))
    cuts = source_cuts(slim, shares=shares, cap=cap).select(F.col("source").alias(source), F.struct("epochs", "last", "part").alias(cut))
    drawn = units.join(sent_if_small(cuts), F.col("source").eqNullSafe(F.col(source))).withColumn(
        taken, _taken(F.col(size), F.col(key), F.col("doc_id").cast("long"), cut)).filter(F.col(taken) > 0)
    rows = drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
    part = F.col(taken) - (F.col(copy) - 1) * F.col(size)
    short = part < F.col(size)
    text = F.when(short, first_words(F.col("text"), part)).otherwise(F.col("text"))
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(short, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in docs.columns])
