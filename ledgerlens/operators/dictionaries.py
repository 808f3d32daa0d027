"""Dictionaries of any size as tables: whole-word aliases and substring keywords in texts.

A dictionary is a DataFrame, so another taxonomy changes rows, not the plan.  Texts give
keys of the sizes that occur in the dictionary (word n-grams, or the first 1, 2, 4, 8 ...
characters of a keyword), an equi-join with the dictionary finds the candidates, and an
exact test follows.  Keys that cannot be in the dictionary are dropped where they are made,
by a bitmap of its hashes (``SLOTS`` bits at most, so it lets more pass the larger the
dictionary is, and drops nothing that is in it).  A small dictionary is broadcast by Spark's
own size statistics, a large one is shuffled with the keys; whole texts never travel.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions.grouped import number_rows

_WORD = re.compile(r"\w+")
FLUSH = 50_000  # rows of keys a task holds before it hands them on
SLOTS = 1 << 24  # bits of a dictionary's bitmap: 2 MB
KNOWN = 200_000  # words a task remembers
SLICE = 1 << 20  # characters of a text that are hashed at a time
_BITMAP = 32_768  # bits of one of Spark's bitmaps
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Which slots (``hash`` modulo the length, a power of two) the hashes of a dictionary take, as bytes of eight."""
    count = hashes.count()
    slots = min(SLOTS, max(1 << 20, 1 << (64 * count).bit_length()))
    at = F.pmod("hash", F.lit(slots)) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(at).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(slots // 8, np.uint8)
    for r in rows.collect():  # at most SLOTS bits whatever the dictionary
        out[(r["n"] - 1) * _BITMAP // 8:r["n"] * _BITMAP // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def metric_terms(spark: SparkSession) -> DataFrame:
    """The built-in metric aliases: alias, metric, category, percent, sections, place."""
    rows = [(alias, name, category, kind == "percent", list(sections))
            for name, (category, kind, aliases, sections) in vocab.METRICS.items() for alias in aliases]
    return spark.createDataFrame(
        [(*r, i) for i, r in enumerate(rows)],
        "alias string, metric string, category string, percent boolean, sections array<string>, place int")


def risk_terms(spark: SparkSession) -> DataFrame:
    """The built-in risk keywords: keyword, category, defined (the order they are listed in)."""
    rows = [(word, category) for category, words in vocab.RISK_KEYWORDS.items() for word in words]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "keyword string, category string, defined int")


def _emit(key: list, **columns: list) -> pd.DataFrame:
    # plain objects: pandas may back strings by several Arrow pieces, which Spark does not take
    return pd.DataFrame({"_key": key, **columns}, dtype=object)


# --- whole words ---------------------------------------------------------------------------
def _core(alias: pd.Series) -> pd.Series:
    """Where an alias's first word begins, where its last one ends, the number of its words, where the first one ends."""
    spans = [[m.span() for m in _WORD.finditer(a or "")] for a in alias]
    return pd.Series([[s[0][0], s[-1][1], len(s), s[0][1]] if s else [0, 0, 0, 0] for s in spans])


_FIRST = "\x01"  # stands before the first word of an alias, so that it is another hash than that of an alias


def _word_grams(bitmap: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Every run of as many words as some alias has that may be an alias, with the gaps that border on it."""
    held, last = bitmap.tobytes(), 8 * len(bitmap) - 1

    def may_be(words: str) -> bool:
        slot = zlib.crc32(words.encode()) & last
        return held[slot >> 3] >> (slot & 7) & 1 == 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, gram, before, after = [], [], [], [], []
        begins: dict[str, bool] = {}
        for frame in frames:
            for k, body, shape in zip(frame["_key"], frame["_body"], frame["_shape"]):
                if body is None or shape is None or shape["sizes"] is None:
                    continue
                low, edge, longest = body.lower(), shape["edge"] + 1, shape["longest"]
                spans = [m.span() for m in _WORD.finditer(low)]
                for i, (s, first_end) in enumerate(spans):
                    word = low[s:first_end]
                    known = begins.get(word)
                    if known is None:
                        if len(begins) >= KNOWN:
                            begins.clear()
                        known = begins[word] = may_be(_FIRST + word)
                    for n in shape["sizes"] if known else ():
                        if i + n > len(spans):
                            continue
                        e = spans[i + n - 1][1]
                        if e - s > longest or not may_be(low[s:e]):
                            continue
                        left, right = spans[i - 1][1] if i else -1, spans[i + n][0] if i + n < len(spans) else len(low) + 1
                        key.append(k), start.append(s), gram.append(low[s:e])
                        # a text's ends count as a gap of one more character
                        before.append((" " if left < 0 else "")[:edge] + low[max(left, 0, s - edge):s])
                        after.append(low[e:min(right, e + edge)] + (" " if right > len(low) else ""))
                        if len(key) >= FLUSH:
                            yield _emit(key, start=start, gram=gram, before=before, after=after)
                            key, start, gram, before, after = [], [], [], [], []
        yield _emit(key, start=start, gram=gram, before=before, after=after)

    return run


def word_matches(texts: DataFrame, key: str, body: str, terms: DataFrame) -> DataFrame:
    """Every place where an alias stands as whole words: key, start, end and the columns of ``terms``.

    Case does not count; characters between the words of an alias must be its own; an alias
    may begin or end with other characters than those of words.  ``start`` and ``end`` are
    places in the lower-cased text.  NULL and empty texts, and aliases without a word, give
    no rows; an alias listed twice gives a row for each entry.
    """
    low, at = F.lower("alias"), lambda i: F.col("_c")[i]
    known = terms.withColumn("_c", F.pandas_udf(_core, "array<int>")(low)).filter(at(2) > 0).select(
        *terms.columns, F.substring(low, at(0) + 1, at(1) - at(0)).alias("_core"), F.substring(low, F.lit(1), at(0)).alias("_lead"),
        F.substring(low, at(1) + 1, F.length(low)).alias("_tail"), at(2).alias("_words"),
        F.concat(F.lit(_FIRST), F.substring(low, at(0) + 1, at(3) - at(0))).alias("_first"))
    shape = known.agg(F.struct(
        F.array_sort(F.collect_set("_words")).alias("sizes"), F.max(F.length("_core")).alias("longest"),
        F.coalesce(F.max(F.greatest(F.length("_lead"), F.length("_tail"))), F.lit(0)).alias("edge")).alias("_shape"))
    type_ = dict(texts.dtypes)[key]
    bitmap = _bitmap(known.select(F.explode(F.array(F.crc32("_core"), F.crc32("_first"))).alias("hash")))
    grams = texts.select(F.col(key).alias("_key"), F.col(body).alias("_body"), shape.scalar().alias("_shape")).mapInPandas(
        _word_grams(bitmap), f"_key {type_}, start int, gram string, before string, after string")
    lead, tail = F.length("_lead"), F.length("_tail")
    fits = (F.endswith("before", "_lead") & F.startswith("after", "_tail")
            & ((lead == 0) | (F.length("before") > lead)) & ((tail == 0) | (F.length("after") > tail)))
    return grams.join(known, F.col("gram") == F.col("_core")).filter(fits).select(
        F.col("_key").alias(key), (F.col("start") - lead).alias("start"),
        (F.col("start") + F.length("gram") + tail).alias("end"), *terms.columns)


def _claim(spans: pd.Series) -> pd.Series:
    """Positions of the spans that stay: a span is dropped if an earlier one covers a part of it."""
    out = []
    for row in spans:
        taken, kept = bytearray(max((s["end"] for s in row), default=0)), []
        for i, s in enumerate(row):
            if not any(taken[s["start"]:s["end"]]):
                taken[s["start"]:s["end"]] = b"\x01" * (s["end"] - s["start"])
                kept.append(i)
        out.append(kept)
    return pd.Series(out)


def word_claims(texts: DataFrame, key: str, body: str, terms: DataFrame) -> DataFrame:
    """One row per text with a match: key and ``spans``, which do not overlap, by start.

    The longest alias claims its characters first, then the first in ``place`` order, then
    the leftmost.  ``spans`` are structs of start, end and the columns of ``terms``.
    """
    found = word_matches(texts, key, body, terms)
    entry = F.struct((F.col("start") - F.col("end")).alias("_size"), "place", "start", "end",
                     *[c for c in terms.columns if c != "place"])
    ranked = found.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    claim = F.pandas_udf(_claim, "array<int>")
    kept = F.transform(claim(F.transform("_all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))),
                       lambda i: F.get("_all", i))
    return ranked.select(key, F.array_sort(F.transform(kept, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), *[s[c].alias(c) for c in terms.columns]))).alias("spans"))


# --- substrings ----------------------------------------------------------------------------
def _size_class(word: Column) -> Column:
    """The largest power of two that a keyword's length reaches: the characters it is found by."""
    return F.pow(F.lit(2), F.floor(F.log2(F.length(word)))).cast("int")


def _run_hashes(body: str, sizes: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each size, a power of two, the hashes of the runs of characters that begin at each place."""
    h = (np.frombuffer(body.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)) * _FACTOR
    size, factor = 1, np.array([_FACTOR])
    while len(h) and size <= max(sizes):
        if size in sizes:
            x = (h ^ (h >> np.uint64(32))) * _FACTOR
            yield size, x >> np.uint64(32)
        h = h[:-size] * factor + h[size:]
        size, factor = 2 * size, factor * factor + np.uint64(2)


def _anchor_hash(anchor: pd.Series) -> pd.Series:
    return pd.Series([int(next(_run_hashes(a, {len(a)}))[1][0]) for a in anchor], dtype="int64")


def _character_grams(bitmap: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The different runs of characters of each size that may begin a keyword, once per text, and what may follow in it."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.unpackbits(bitmap, bitorder="little").view(bool)
        key, gram, rests = [], [], []
        for frame in frames:
            for k, body, sizes in zip(frame["_key"], frame["_body"], frame["_sizes"]):
                if body is None or sizes is None or not len(sizes):
                    continue
                found: dict[str, set[str]] = {}
                wanted = {int(n) for n in sizes}
                for at in range(0, len(body), SLICE):
                    for n, hashes in _run_hashes(body[at:at + SLICE + max(wanted) - 1], wanted):
                        for i in (np.flatnonzero(held[hashes[:SLICE] & np.uint64(len(held) - 1)]) + at).tolist():
                            found.setdefault(body[i:i + n], set()).add(body[i:i + 2 * n - 1])
                for g, r in found.items():
                    key.append(k), gram.append(g), rests.append(sorted(r))
                    if len(key) >= FLUSH:
                        yield _emit(key, gram=gram, rests=rests)
                        key, gram, rests = [], [], []
        yield _emit(key, gram=gram, rests=rests)

    return run


def substring_matches(texts: DataFrame, key: str, body: str, terms: DataFrame, word: str) -> DataFrame:
    """(key and the columns of ``terms``) for every keyword that a text holds anywhere, case as it is.

    NULL texts and NULL or empty keywords give no rows.
    """
    known = terms.filter(F.length(word) > 0).withColumn("_anchor", F.substring(F.col(word), F.lit(1), _size_class(F.col(word))))
    sizes = known.agg(F.collect_set(F.length("_anchor")).alias("_sizes"))
    type_ = dict(texts.dtypes)[key]
    bitmap = _bitmap(known.select(F.pandas_udf(_anchor_hash, "long")("_anchor").alias("hash")))
    grams = texts.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(body).alias("_body"), sizes.scalar().alias("_sizes")).mapInPandas(
        _character_grams(bitmap), f"_key {type_}, gram string, rests array<string>")
    # a keyword is shorter than twice its anchor, so the rest holds it whole
    held = F.exists("rests", lambda r: F.startswith(r, F.col(word)))
    return grams.join(known, F.col("gram") == F.col("_anchor")).filter(held).select(F.col("_key").alias(key), *terms.columns)


def keyword_categories(texts: DataFrame, key: str, body: str, terms: DataFrame) -> DataFrame:
    """Per text and category with a keyword in it: place, category, keyword.

    ``keyword`` is the category's first in ``defined`` order; ``place`` the rank of its
    longest among all keywords (longest first, then ``defined``).  ``body`` is lower-cased.
    """
    lowered = terms.withColumn("_low", F.lower("keyword"))
    ranked = number_rows(lowered, [], [-F.length("_low"), F.col("defined")], "place").withColumn("place", F.col("place") - 1)
    return substring_matches(texts, key, body, ranked, "_low").groupBy(key, "category").agg(
        F.min("place").alias("place"), F.min_by("keyword", "defined").alias("keyword"))
