"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source.

Counts of a text are turned into a vector of five statistics.  For every group (language
and source; a group of fewer than ``SMALL`` documents joins its language's rest, and that
the rest of all) location and scatter are estimated from the tightest share ``CORE`` of its
documents: two deterministic starts, from quantiles and from squashed scores, are improved
by concentration steps (keep the documents nearest under the current estimate, estimate
again), and the one with the smaller determinant wins.  A document whose squared Mahalanobis
distance exceeds ``LIMIT`` is rejected.

Everything is DataFrame functions.  Quantiles come from counts of values rounded to a
bin, pre-aggregated before the shuffle, so no group is gathered and reruns agree.  ``FLOOR``
is the least standard deviation of a statistic: most clean texts have no symbols at all,
and without it their scatter would be singular and any symbol infinitely far away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
STATS = ["s_words", "s_length", "s_symbols", "s_lines", "s_repeats"]
FLOOR = [0.5, 0.12, 0.1, 0.12, 0.1]
DIMS = len(STATS)
SMALL = 50
CORE = 0.75
STEPS = 3
# Median of the chi-squared distribution with five degrees of freedom, and the rejection
# distance: its 0.9999 quantile times 1.4, since the statistics have longer tails than the normal.
MEDIAN, LIMIT = 4.3515, 1.4 * 25.745
GRAIN = 1024


# ---- statistics of a text ---------------------------------------------------------------

def text_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = F.size("_words")
    split = docs.select(*keep, text.alias("_text")).select(
        *keep,
        F.array_remove(F.split("_text", SPACE + "+"), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        (F.length("_text") - F.regexp_count("_text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    triples = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<long>"))
    hashed = split.select(
        *keep, "word_chars", "n_symbols", n.cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), triples.alias("_triples"))
    some = F.size(F.array_distinct("_triples")) < F.size("_triples")
    # (hash, place) in order: a window found again stands next to its equal
    placed = hashed.withColumn("_sorted", F.when(some, F.array_sort(F.transform("_triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter("_sorted", lambda x, k: F.coalesce(x["h"] == F.get("_sorted", k - 1)["h"], F.lit(False)) | F.coalesce(
        x["h"] == F.get("_sorted", k + 1)["h"], F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return placed.withColumn("n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("long")).withColumn(
        "n_repeat_words", F.greatest("n_repeat_words", F.lit(0))).drop("_triples", "_sorted")


def _statistics() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    raw = [F.log1p("n_words"), F.log1p(F.col("word_chars") / words), F.sqrt(F.col("n_symbols") / words),
           F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), F.sqrt(F.col("n_repeat_words") / words)]
    # multiples of 1/1024: sums of products stay exact, whatever the order they are added in
    return [(F.round(x * GRAIN) / GRAIN).alias(s) for x, s in zip(raw, STATS, strict=True)]


# ---- minimum covariance determinant ----------------------------------------------------

PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _estimate(rows: DataFrame, values: list[Column], keys: list[str]) -> DataFrame:
    """Mean ``m_i`` and covariance ``c_i_j`` (with the floor) of ``values`` per key."""
    named = rows.select(*keys, *[v.alias(f"v{i}") for i, v in enumerate(values)])
    n = F.count(F.lit(1))
    sums = named.groupBy(*keys).agg(
        n.alias("n"), *[F.sum(f"v{i}").alias(f"t{i}") for i in range(DIMS)],
        *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"q_{i}_{j}") for i, j in PAIRS])
    return sums.select(*keys, "n", *[(F.col(f"t{i}") / F.col("n")).alias(f"m_{i}") for i in range(DIMS)], *[
        (F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"t{i}") * F.col(f"t{j}") / (F.col("n") * F.col("n")) + (F.lit(FLOOR[i] ** 2) if i == j else 0)
         ).alias(f"c_{i}_{j}") for i, j in PAIRS])


def _factor(estimate: DataFrame) -> DataFrame:
    """Adds the Cholesky factor ``l_i_j`` of the covariance and ``logdet``."""
    out = estimate
    for i in range(DIMS):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    logdet = F.lit(0.0)
    for i in range(DIMS):
        logdet = logdet + F.log(f"l_{i}_{i}")
    return out.withColumn("logdet", logdet)


def _distance(rows: DataFrame, name: str = "d2") -> DataFrame:
    """Adds the squared Mahalanobis distance by forward substitution with the factor's columns."""
    total = F.lit(0.0)
    for i, s in enumerate(STATS):
        rest = F.col(s) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        rows = rows.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
        total = total + F.col(f"y_{i}") * F.col(f"y_{i}")
    return rows.withColumn(name, total).drop(*[f"y_{i}" for i in range(DIMS)])


def _quantile(rows: DataFrame, keys: list[str], bin_col: Column, share: float, name: str) -> DataFrame:
    """Smallest bin at which the share of a key's rows is reached; works on counts of bins only."""
    counted = rows.select(*keys, bin_col.cast("long").alias("_bin")).groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    # a key has at most some thousand bins
    upto = F.sum("_n").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    reached = counted.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(w)).filter(F.col("_upto") >= F.ceil(F.col("_all") * share))
    return reached.groupBy(*keys).agg(F.min("_bin").alias(name))


def _bin(d2: str = "d2") -> Column:
    """Distances in steps of about 1.6 per cent."""
    return F.floor(F.log1p(d2) * 64)


GROUP = ["g_lang", "g_source", "g_level"]


def _grouped(counts: DataFrame) -> DataFrame:
    """Adds the effective group; the table of languages and sources is joined by its own size."""
    sizes = counts.filter("NOT base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_big", F.col("_n") >= SMALL)
    rest = sizes.filter("NOT _big").groupBy("lang").agg((F.sum("_n") >= SMALL).alias("_lang_big"))
    plan = sizes.join(rest.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left").select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"),
        F.when(F.col("_big"), 2).when(F.col("_lang_big"), 1).otherwise(0).alias("g_level"))
    joined = counts.join(plan, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    level = F.coalesce("g_level", F.lit(0))
    # NULL and empty names are told apart by the mark in front
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return joined.withColumn("g_level", level).withColumn("g_lang", F.when(level >= 1, mark(F.col("lang"))).otherwise("")).withColumn(
        "g_source", F.when(level >= 2, mark(F.col("source"))).otherwise("")).drop("_lang", "_source")


def fit(rows: DataFrame) -> DataFrame:
    """Location, Cholesky factor and ``scale`` per effective group of ``rows`` (GROUP and STATS)."""
    tall = rows.select(*GROUP, F.posexplode(F.array(*STATS)).alias("dim", "value"))
    spots = None
    for share, name in ((0.25, "low"), (0.5, "mid"), (0.75, "high")):
        q = _quantile(tall, [*GROUP, "dim"], F.floor(F.col("value") * GRAIN / 8), share, name)
        spots = q if spots is None else spots.join(q, [*GROUP, "dim"])
    step = 8 / GRAIN
    by_dim = spots.select(*GROUP, "dim", (F.col("mid") * step).alias("mid"), ((F.col("high") - F.col("low")) * step / 1.349).alias("wide"))
    wide = cut_lineage(by_dim.groupBy(*GROUP).agg(*[F.max(F.when(F.col("dim") == i, F.col(c))).alias(f"{c}_{i}") for i in range(DIMS) for c in ("mid", "wide")]))
    scale = [F.greatest(F.col(f"wide_{i}"), F.lit(FLOOR[i])) for i in range(DIMS)]
    quartiles = wide.select(*GROUP, F.lit(0).alias("start"), F.lit(0).cast("long").alias("n"), *[F.col(f"mid_{i}").alias(f"m_{i}") for i in range(DIMS)], *[
        (scale[i] * scale[i] if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in PAIRS])
    squashed = _estimate(rows.join(wide, GROUP), [
        F.round(F.tanh((F.col(s) - F.col(f"mid_{i}")) / scale[i]) * GRAIN) / GRAIN for i, s in enumerate(STATS)], GROUP).join(wide, GROUP).select(
        *GROUP, F.lit(1).alias("start"), "n", *[(F.col(f"mid_{i}") + F.col(f"m_{i}") * scale[i]).alias(f"m_{i}") for i in range(DIMS)], *[
            (F.col(f"c_{i}_{j}") * scale[i] * scale[j] + (F.lit(FLOOR[i] ** 2) if i == j else 0)).alias(f"c_{i}_{j}") for i, j in PAIRS])
    current = cut_lineage(_factor(quartiles.unionByName(squashed)))
    keys = [*GROUP, "start"]
    twice = rows.select(*GROUP, *STATS).withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(STEPS):
        far = _distance(twice.join(current.drop("n", "logdet"), keys))
        near = _quantile(far, keys, _bin(), CORE, "_most")
        kept = far.join(near, keys).filter(_bin() <= F.col("_most"))
        current = cut_lineage(_factor(_estimate(kept, [F.col(s) for s in STATS], keys)))
    best = cut_lineage(current.groupBy(*GROUP).agg(F.min_by(F.struct(*[c for c in current.columns if c not in keys]), F.struct("logdet", "start")).alias("_b")).select(*GROUP, "_b.*"))
    far = _distance(rows.select(*GROUP, *STATS).join(best.drop("n", "logdet"), GROUP))
    middle = _quantile(far, GROUP, _bin(), 0.5, "_middle")
    # the core alone understates the scatter: scale so that the median distance is what a normal sample has
    return best.join(middle, GROUP).withColumn("scale", F.greatest(F.lit(1.0), F.expm1((F.col("_middle") + 0.5) / 64) / MEDIAN)).drop("_middle", "n", "logdet")


def quality_verdicts(docs: DataFrame, *, limit: float = LIMIT) -> DataFrame:
    """Per document: the counts, ``base_failed``, ``distance`` (NULL if that) and ``kept``.

    Estimates use documents that do not fail the base rules; those fail without a distance.
    A NULL or empty text has no words and fails.  NULL languages and sources are groups of
    their own.  Repeated rows count each; NULL ids are kept.
    """
    counts = text_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")), ["doc_id", "lang", "source"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    slim = cut_lineage(counts.withColumn("base_failed", failed).select("*", *_statistics()))
    rows = cut_lineage(_grouped(slim))
    model = cut_lineage(fit(rows.filter("NOT base_failed")))
    far = _distance(rows.join(model, GROUP, "left"), "_d2")
    distance = F.when(~F.col("base_failed"), F.col("_d2") / F.col("scale"))
    return far.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"),
        F.coalesce(~F.col("base_failed") & (distance <= limit), F.lit(False)).alias("kept"))
