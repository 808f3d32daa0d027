"""Order-dependent operators over groups of any size.

A window over a group puts the whole group into one task.  Wherever a group's size
is not bounded by the data model, the helpers here are used instead:

* first row, top k per group -> ``row_number() <= k``, which Spark limits on the map
  side (``WindowGroupLimit``) before the shuffle; columns nobody reads stay out of it;
* positions, ranks and running totals -> one range sort of the whole table (a hot
  group spreads over as many partitions as its size asks for), then a prefix sum
  over the per-partition totals of each group, which are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage


def _cols(df: DataFrame, cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the smallest under ``order``, NULLs first.  Limited before the shuffle.

    Each order column must sort ascending; negate a numeric column to sort it down.
    """
    return top_per(df, keys, order, 1, "_first").drop("_first")


def top_per(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank_col: str = "rank"
) -> DataFrame:
    """At most ``k`` rows per key with their 1-based position."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def _spread(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Sort the table by (keys, order) across all partitions and freeze the result.

    ``_part`` is the range partition and ``_at`` the row's place in it.  The frozen
    copy guarantees that the two readers below see the same partition borders even
    if an executor is lost in between.
    """
    ordered = df.orderBy(*keys, *order).withColumn("_gid", F.monotonically_increasing_id())
    return cut_lineage(
        ordered.withColumn("_part", F.shiftright("_gid", 33)).withColumn(
            "_at", F.expr("_gid & 8589934591L")
        )
    ).drop("_gid")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys of which NULL equals NULL; the keys are those of ``left``."""
    marked = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                          *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = one if cond is None else cond & one
    return left.join(marked, cond, how).drop(*[f"_r_{k}" for k in keys])


def number_rows(
    df: DataFrame, keys: list[str], order: list[Column], name: str, *, bounded: bool = False
) -> DataFrame:
    """Add the 1-based position of each row in its group.

    ``bounded`` states that the data model limits a group to what one task can sort
    (for example the periods of one company); a plain window is cheapest then.
    """
    if bounded:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    frozen = _spread(df, keys, order)
    parts = frozen.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")
    )
    # a group has at most one row per range partition here
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = null_safe_join(frozen, offsets, [*keys, "_part"], "inner")
    position = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return joined.withColumn(name, position.cast("int")).drop("_part", "_at", "_first", "_before")


def running_total(
    df: DataFrame, keys: list[str], order: list[Column], value: str, name: str,
    *, bounded: bool = False,
) -> DataFrame:
    """Inclusive running sum of ``value`` within each group; ``order`` must be total."""
    if bounded:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(w))
    frozen = _spread(df, keys, order)
    parts = frozen.groupBy(*keys, "_part").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = null_safe_join(frozen, offsets, [*keys, "_part"], "inner")
    local = (
        Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    )
    return joined.withColumn(name, F.col("_before") + F.sum(value).over(local)).drop(
        "_part", "_at", "_before"
    )
