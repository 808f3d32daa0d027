"""Text expressions.  All of them are Columns, so they stay inside code generation.

Regular expressions are written for ``java.util.regex`` with explicit Unicode
classes: whitespace, word characters and boundaries mean the same for accented text
as for ASCII.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, however often ``body`` refers to it."""
    return F.transform(F.array(value), body)[0]


# The characters of WS one by one, for trimming without a regular expression.
WS_CHARS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(
    chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space at both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    """Collapse white space runs to one blank and trim."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def non_blank(c: Column) -> Column:
    """NULL for NULL, empty and white-space-only text; otherwise the stripped text."""
    s = strip(c)
    return F.when(F.length(s) > 0, s)


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def token_count(c: Column, mode: str = "heuristic") -> Column:
    """Tokens in a text: ``heuristic`` = words and single marks, ``char`` = length / 4, at least 1."""
    if mode == "char":
        quarter = F.bround(F.length(c) / F.lit(4.0)).cast("int")
        return F.when(F.length(c) > 0, F.greatest(F.lit(1), quarter)).otherwise(0)
    if mode == "heuristic":
        return F.coalesce(F.regexp_count(c, F.lit(TOKEN)), F.lit(0))
    raise ValueError(f"unknown token counter {mode!r}")


def _split_sentences(c: Column, blanks_only: bool) -> Column:
    # the look-ahead lets most positions fail on one character test
    gap = "(?= )(?<=[.!?]) +" if blanks_only else f"(?={WS})(?<=[.!?]){WS}+"
    return F.split(c, gap)


def sentences(c: Column, *, blanks_only: bool = False) -> Column:
    """Split after ``. ! ?`` and white space (or blanks only); empty pieces are dropped."""
    return F.filter(F.transform(_split_sentences(c, blanks_only), strip), lambda s: F.length(s) > 0)


def sentence_count(c: Column) -> Column:
    return F.size(F.filter(_split_sentences(c, False), lambda s: F.octet_length(strip(s)) > 0))


def occurrences(lowered: Column, phrase: str) -> Column:
    """Non-overlapping raw substring hits of one phrase in already lower-cased text.

    Most texts lack most phrases, and ``contains`` is the cheapest way to learn that; the
    difference of byte lengths, which need no scan, counts the rest.
    """
    shrunk = F.octet_length(F.replace(lowered, F.lit(phrase), F.lit("")))
    hits = ((F.octet_length(lowered) - shrunk) / F.lit(len(phrase.encode()))).cast("int")
    return F.when(lowered.contains(phrase), hits).otherwise(F.lit(0))


def phrase_total(lowered: Column, phrases: list[str]) -> Column:
    """Sum of :func:`occurrences` over a fixed phrase list."""
    total = occurrences(lowered, phrases[0])
    for phrase in phrases[1:]:
        total = total + occurrences(lowered, phrase)
    return total


def contains_any(lowered: Column, words: list[str]) -> Column:
    """Whether a text holds any of the words as a substring.

    Words that contain another word of the list add nothing and are left out.
    """
    minimal = [w for w in words if not any(o != w and o in w for o in words)]

    def test(low: Column) -> Column:
        out = low.contains(minimal[0])
        for w in minimal[1:]:
            out = out | low.contains(w)
        return out

    return let(lowered, test)


def literal_alternation(words: list[str]) -> str:
    """One alternation that matches any of the given literal strings."""
    return "|".join(re.escape(w) for w in words)


def matches_any(c: Column, patterns: list[str]) -> Column:
    """Case-insensitive, Unicode-aware search for any of several patterns in one pass.

    A word boundary that all of them begin with is looked for once at each place.
    """
    plain = [re.sub(r"\([^()]*\)", "", p) for p in patterns]
    if all(p.startswith(r"\b") and "|" not in p for p in plain):
        return c.rlike("(?iu)(?U)" + r"\b(?:" + "|".join(f"(?:{p[2:]})" for p in patterns) + ")")
    return c.rlike("(?iu)(?U)" + "|".join(f"(?:{p})" for p in patterns))


def word_set(c: Column) -> Column:
    """Distinct lower-cased white-space separated words."""
    return F.array_distinct(
        F.filter(F.split(F.lower(c), f"{WS}+"), lambda w: F.length(w) > 0)
    )


def name_tokens(c: Column, stop_words: list[str]) -> Column:
    """Distinct lower-cased word tokens of a name without its stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(f"({WORD}+)"), F.lit(1))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in stop_words]))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets held as arrays of distinct items; 0 when either is empty."""
    def ratio(s: Column) -> Column:
        shared = F.size(F.array_intersect(s["a"], s["b"]))
        return F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), F.lit(0.0)).otherwise(
            shared / (F.size(s["a"]) + F.size(s["b"]) - shared))

    return let(F.struct(a.alias("a"), b.alias("b")), ratio)


def title_words(c: Column) -> Column:
    """``SUPPLY_CHAIN`` → ``Supply Chain``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def dictionary(rows: list[tuple], fields: str) -> Column:
    """A fixed vocabulary as an array of structs, e.g. ``fields="word string, place int"``.

    Written as one JSON literal, which the optimizer folds into a single constant, instead
    of hundreds of literal expressions in every plan.
    """
    names = [f.split()[0] for f in fields.split(",")]
    body = json.dumps({"v": [dict(zip(names, row)) for row in rows]})
    inner = ",".join(":".join(f.split()) for f in fields.split(","))
    return F.from_json(F.lit(body), f"v array<struct<{inner}>>")["v"]
