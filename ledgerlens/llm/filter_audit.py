"""What each of five filters removes, under all 120 orders of them, from difference arrays over permutation ranks.

1. Every document becomes the mask of the filters it fails; the table becomes counts per
   (part, mask), at most 32 a part.
2. The permutations are numbered by their Lehmer code, which is their lexicographic rank.  A
   document is removed at step k of exactly those orders that begin with k - 1 filters it
   passes and one it fails, and orders with a common beginning are one interval of ranks.
   ``removal_intervals`` lists them for all masks; they depend on nothing but the filters.
3. A count is added where an interval begins and taken off where it ends; the running sum
   over the ranks then is what every order removes at that step.

Whether a text repeats that of a smaller id is decided on its SHA-256, for the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import text_slices
from ledgerlens.session import cut_lineage

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
UPPER = bytes(range(ord("A"), ord("Z") + 1))
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#$%&*|"
COUNTS = ("n", "good", "toxic")


def own_failures(text: bytes) -> int:
    """Mask of the filters A to D that a UTF-8 text fails by itself."""
    words = text.split()  # at the six ASCII white space characters
    upper = len(text) - len(text.translate(None, UPPER))
    failed = (
        len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * len(text.translate(None, CONTINUATION)),
        len(text.translate(None, SYMBOLS)) < len(text))
    return sum(f << k for k, f in enumerate(failed))


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part`` (lang), ``mask`` of A to D and ``digest`` of the text, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(map(own_failures, texts), pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts])],
                names=["doc_id", "part", "mask", "digest"])

    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def _is_one(name: str) -> Column:
    return F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask`` of all five filters, and the numbers of documents: all, good and toxic ones."""
    # rows alike in all that counts become one before anything is joined
    rows = failures(docs).groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    flags = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        _is_one("quality").alias("good"), _is_one("toxic").alias("toxic"))
    # rows without an id have no label; a hash in its place keeps them from meeting in one task
    found = (F.col("none") == F.lit(False)) & (F.col("key") == F.col("label_id"))
    keyed = rows.withColumns({"none": F.col("doc_id").isNull(), "key": F.coalesce("doc_id", F.xxhash64("digest", "part"))})
    flagged = keyed.join(flags.withColumn("never", F.lit(False)), found & (F.col("none") == F.col("never")), "left")
    texts = flagged.groupBy("digest", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("of_least"))
    # a text has at most one row here per part and kind of label
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    again = F.col("rows") - F.col("no_id") - F.when(first, F.col("of_least")).otherwise(0)
    split = texts.withColumn("again", again).select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", (F.col("rows") - F.col("again")).alias("n")),
        F.struct((F.col("mask") + REPEATED).alias("mask"), F.col("again").alias("n")))).alias("x")).filter("x.n > 0")
    return split.groupBy("part", "x.mask").agg(F.sum("x.n").alias("n"), F.sum(F.expr("x.n * good")).alias("good"), F.sum(F.expr("x.n * toxic")).alias("toxic"))


def lehmer_rank(prefix: tuple[int, ...], n: int) -> int:
    """Lexicographic rank of the first permutation of 0..n-1 with this beginning."""
    rank = 0
    for k, x in enumerate(prefix):
        rank += (x - sum(y < x for y in prefix[:k])) * factorial(n - 1 - k)
    return rank


def removal_intervals(n: int = len(FILTERS)) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last): the orders that remove the mask at that step; neighbours joined."""
    out = []
    for mask in range(1, 1 << n):
        fails = [k for k in range(n) if mask >> k & 1]
        passes = [k for k in range(n) if not mask >> k & 1]
        for step in range(1, len(passes) + 2):
            width, merged = factorial(n - step), []
            for start in sorted(lehmer_rank((*before, last), n) for before in permutations(passes, step - 1) for last in fails):
                if merged and merged[-1][1] == start:
                    merged[-1][1] = start + width
                else:
                    merged.append([start, start + width])
            out += [(mask, step, a, b) for a, b in merged]
    return out


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per ``part``, ``filter_order`` and ``step``; the counts are of documents of the part.

    ``kept`` are left after the step, ``removed`` fall to it, ``redundant`` fail its filter but
    fell earlier, ``unique_fails`` fail its filter only; ``good_lost`` and ``toxic_lost`` are
    removed ones whose label says so (a label row of several that does is enough);
    ``shapley`` sums ``removed`` of the filter over all orders.

    A NULL text is empty, a NULL lang the part ''.  Repeated rows count each; rows that share
    the least id of a text all pass E, and a row without an id does, and has no label.
    Documents without rows give no rows; other columns are not looked at.
    """
    spark, n = docs.sparkSession, len(FILTERS)
    counts = cut_lineage(mask_counts(docs, labels))
    intervals = spark.createDataFrame(removal_intervals(n), "mask int, step int, first int, last int")
    ends = counts.join(F.broadcast(intervals), "mask").select("part", "step", F.explode(F.array(*[
        F.struct(F.col(at).alias("rank"), *[(sign * F.col(c)).alias(c) for c in COUNTS]) for at, sign in (("first", 1), ("last", -1))])).alias("x"))
    parts = counts.groupBy("part").agg(
        F.sum("n").alias("documents"),
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.col("n")).otherwise(0)) for k in range(n)]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)) for k in range(n)]).alias("alone"))
    nothing = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    steps = ends.select("part", "step", "x.*").unionByName(nothing).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in COUNTS])
    # at most 121 ranks a part and step
    so_far = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = steps.select("part", "step", "rank", *[F.sum(c).over(so_far).alias(c) for c in COUNTS]).filter(F.col("rank") < factorial(n))
    orders = spark.createDataFrame(
        [(rank, "".join(FILTERS[k] for k in order), step + 1, order[step]) for rank, order in enumerate(permutations(range(n))) for step in range(n)],
        "rank int, filter_order string, step int, filter int")
    before = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    named = removed.join(F.broadcast(orders), ["rank", "step"]).join(parts, "part")
    return named.select(
        "part", "filter_order", "step", (F.col("documents") - F.sum("n").over(before)).alias("kept"), F.col("n").alias("removed"),
        (F.col("fails")[F.col("filter")] - F.col("n")).alias("redundant"), F.col("alone")[F.col("filter")].alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"))
