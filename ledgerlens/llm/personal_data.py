"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and
cues of identifiers.  Each kind has a deterministic local parser that expands an anchor to
its boundaries and validates what it has found (parts of an address, Luhn, digits of a
number, the IBAN remainder).  Parsers of one kind go left to right and never overlap, and
look no further than the span they build, so the cost is the pass plus the spans.

Base kinds are ``email``, ``ip``, ``card`` and ``phone``; the parsers give exactly the
leftmost non-overlapping matches of their patterns that pass the checks.  Further kinds:
``url`` (a scheme or www.), ``secret`` (the value after a cue such as token or password),
``key_id`` (cloud access key ids), ``iban`` and ``ssn`` (after their cues).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_rows, per_worker, text_name, text_slices

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "url", "secret", "key_id", "iban", "ssn"]

# ---- fixed values: character sets and patterns of the local parsers ----
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
DIGITS = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"(?:https?://|ftp://|www\.)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?", re.I)
SECRET = re.compile(r"[\"']?[\x20]*[:=][\x20]*[\"']?([A-Za-z0-9_./+-]{8,})")
KEY_ID = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])")
IBAN = re.compile(r"[\x20:#]*([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30})")
SSN = re.compile(r"[\x20:#]*([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
CUES = {
    "email": ["@"], "phone": ["+"], "number": list("0123456789"), "url": ["http://", "https://", "ftp://", "www."],
    "secret": ["token", "password", "passwd", "secret", "api_key", "apikey"], "key_id": ["akia", "asia"], "iban": ["iban"], "ssn": ["ssn"],
}
# -------------------------------------------------------------------------


def automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for kind, cues in CUES.items():
        for cue in cues:
            made.add_word(cue, (kind, len(cue)))
    made.make_automaton()
    return made


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _remainder(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def find_spans(text: str, anchors) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start and then kind."""
    low = text.lower()
    if len(low) != len(text):  # some letters lower-case to two; only A-Z matter to the cues
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    found: list[tuple[int, int, str]] = []
    done = dict.fromkeys([*KINDS, "run"], 0)  # where each kind's last match ended
    for last, (cue, size) in anchors.iter(low):
        at, after = last - size + 1, last + 1
        if cue == "number":
            if at >= done["run"]:
                run = DIGITS.match(text, at)
                if run:
                    done["run"] = run.end()
                    digits = re.sub(r"[\x20-]", "", run.group())
                    if 12 <= len(digits) <= 19 and _luhn(digits):
                        found.append((at, run.end(), "card"))
                else:
                    done["run"] = after
            if at >= done["ip"] and not (at > done["ip"] and "0" <= text[at - 1] <= "9"):
                m = ADDRESS.match(text, at)
                if m:
                    done["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                        found.append((at, m.end(), "ip"))
        elif cue == "email":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, after) if start < at else None
            if m:
                done["email"] = m.end()
                found.append((start, m.end(), "email"))
        elif cue == "phone":
            m = PHONE.match(text, at) if at >= done["phone"] else None
            if m:
                done["phone"] = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    found.append((at, m.end(), "phone"))
        elif at >= done[cue]:
            if cue == "url":
                m = URL.match(text, at)
                span = (at, at + len(m.group().rstrip(".,;:!?)"))) if m else None
            elif cue == "key_id":
                m = KEY_ID.match(text, at) if at == 0 or not text[at - 1].isalnum() else None
                span = m.span() if m else None
            else:
                m = {"secret": SECRET, "iban": IBAN, "ssn": SSN}[cue].match(text, after)
                span = m.span(1) if m else None
                if m and cue == "iban" and _remainder(m.group(1).replace(" ", "")) != 1:
                    span = None
            if span:
                done[cue] = span[1]
                found.append((*span, cue))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def spans_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans and all ``spans`` of every whole text.

    A NULL or empty text has none.  Repeated rows are searched each; NULL ids are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            anchors = per_worker("anchors", automaton)
            counts, digests, spans = [], [], []
            for raw in texts:
                all_found = find_spans(raw.decode("utf-8", "replace"), anchors)
                base = [s for s in all_found if s[2] in BASE]
                counts.append([sum(s[2] == k for s in base) for k in BASE])
                digests.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                spans.append(spans_text(all_found))
            columns = np.array(counts, np.int64).reshape(-1, len(BASE))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(np.ascontiguousarray(columns[:, k])) for k in range(len(BASE))], pa.array(digests), pa.array(spans)],
                names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by the kind in angle brackets; NULL stays NULL."""
    column, at = text_name(docs), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, column):
            anchors = per_worker("anchors", automaton)
            out = []
            for raw, there in zip(texts, batch.column(at).is_valid().to_pylist(), strict=True):
                text, parts, end = raw.decode("utf-8", "replace"), [], 0
                for a, b, kind in find_spans(text, anchors):
                    if a >= end:
                        parts += [text[end:a], f"<{kind}>"]
                    end = max(end, b)
                out.append("".join([*parts, text[end:]]) if there else None)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_rows(docs, run, [])
