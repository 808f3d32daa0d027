"""Ids of whole texts by a byte-level BPE file, put together from parts met before.

A text is cut before every space that follows a character other than white space: the
byte-level pattern has no pre-token that crosses such a place, so the ids of the parts, one
after the other, are those of the text.  Arrow cuts and numbers the parts of many texts at
once and puts their ids together, so Python handles each distinct part once.  A part not
seen lately is cut into pre-tokens, and a pre-token not seen lately is encoded by the
subclass, which is the only place where ids are made.

When a file is loaded, its own pre-tokenizer is asked for the class of every character
below U+0250.  Parts of such characters are cut by the pattern over those classes; parts
with any other character, or with one whose class is not clear, by the library's
pre-tokenizer.

Both caches have two generations: what is used moves to the young one, and when that is
full it becomes the old one.  So words in use stay, and memory has a bound.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PARTS, WORDS = 200_000, 250_000
LONG = 64
MARKS = ".,;:!?*#$%&|"
PLAIN = 0x250
# Fixed pattern of byte-level BPE files: contractions, letters, numbers, other marks, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[{L}]+| ?[{N}]+| ?[{M}]+|[{S}]+(?![{L}{N}{M}])|[{S}]+"


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Bytes with a visible Latin-1 character stand for themselves; the others take the
    characters from U+0100 on, in order.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 0
    for b in range(256):
        out.append(chr(b if b in visible else 0x100 + more))
        more += b not in visible
    return out


class CachedWords:
    """Ids of texts as bytes, two or four a token; ``fresh`` gives those of distinct pre-tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = {t["content"]: t["id"] for t in self.spec.get("added_tokens") or []}
        self._demand()
        size = max([*self.spec["model"]["vocab"].values(), *self.added.values()]) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.pattern, self.odd = self._pattern()
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.parts: dict[str, bytes | None] = {}
        self.words: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes | None] = {}
        self.old_words: dict[str, bytes] = {}

    def _demand(self) -> None:
        """The file is one this way of cutting is right for."""
        model, cut = self.spec["model"], self.spec.get("pre_tokenizer") or {}
        fits = (
            model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not self.spec.get("normalizer")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and cut.get("type") == "ByteLevel"
            and cut.get("use_regex") and not cut.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in self.spec.get("added_tokens") or []))
        if not fits:
            raise ValueError("needs a byte-level BPE file without normalizer, prefix space or stripping added tokens")

    def _library_cut(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _pattern(self) -> tuple[re.Pattern, re.Pattern]:
        """The pattern over the classes that the file's own pre-tokenizer gives to characters, and one that finds all others."""
        classes: dict[str, list[str]] = {"L": [], "N": [], "M": [], "S": []}
        for char in map(chr, range(PLAIN)):
            found = [k for k, like in (("L", "a"), ("N", "1"), ("M", "!"), ("S", "\t")) if len(self._library_cut(like + char)) == 1]
            if len(found) == 1:
                classes[found[0]].append(re.escape(char))
        if not {re.escape(c) for c in MARKS} <= {*classes["M"]}:
            raise ValueError("punctuation is cut otherwise than expected")
        sets = {k: "".join(v) for k, v in classes.items()}
        return re.compile(PATTERN.format(**sets)), re.compile(f"[^{''.join(sets.values())}]")

    def fresh(self, words: list[str]) -> list[bytes]:
        raise NotImplementedError

    def pre_tokens(self, text: str) -> list[str]:
        """Of a text without added tokens."""
        return self._library_cut(text) if self.odd.search(text) else self.pattern.findall(text)

    def _whole(self, text: str) -> list[str | int]:
        """Pre-tokens of any text, added tokens as ids between them."""
        out: list[str | int] = []
        start = 0
        for m in self.special.finditer(text) if self.special else ():
            out += self.pre_tokens(text[start:m.start()])
            out.append(self.added[m[0]])
            start = m.end()
        return out + self.pre_tokens(text[start:])

    def _learn(self, *lists: Iterable[list[str | int] | None]) -> None:
        """Afterwards ``self.words`` holds all pre-tokens of the lists."""
        known, old, missing = self.words, self.old_words, []
        need: set[str | int] = set()
        for some in lists:
            need.update(*filter(None, some))
        for w in need:
            if w not in known and w.__class__ is str:
                if w in old:
                    known[w] = old[w]
                else:
                    missing.append(w)
        known.update(zip(missing, self.fresh(missing), strict=True))
        self.long += [w for w in missing if len(w) > LONG]

    def _ids(self, words: list[str | int]) -> bytes:
        known = self.words
        try:
            return known[words[0]] if len(words) == 1 else b"".join(map(known.__getitem__, words))
        except KeyError:  # an added token stands among them
            pass
        return b"".join([known[w] if w.__class__ is str else np.array([w], self.kind).tobytes() for w in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if not texts:
            return []
        if len(self.parts) > PARTS:
            self.old_parts, self.parts = self.parts, {}
        if len(self.words) > WORDS:
            self.old_words, self.words = self.words, {}
        self.long: list[str] = []
        # Arrow cuts and numbers the parts; only one of a kind becomes a Python string
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        starts = cut.offsets.to_numpy()
        parts = cut.flatten()
        heads = parts.take(pa.array(starts[:-1])).to_numpy(zero_copy_only=False).tolist()
        place = np.ones(len(parts), bool)
        place[starts[:-1]] = False
        numbered = parts.filter(pa.array(place)).dictionary_encode()
        del cut, parts
        order = np.empty(len(place), np.int32)
        order[place] = numbered.indices.to_numpy()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        del numbered
        known, old = self.parts, self.old_parts
        new: list[str] = []
        for p in distinct:
            if p not in known:
                if p in old:
                    known[p] = old[p]
                else:
                    new.append(p)
        # a part stands for itself with a space before it: most are a word and the marks after it
        plain: dict[str, str] = {}
        # None where the next space is no place to cut
        cut_new: dict[str, list[str | int] | None] = {}
        for p in new:
            word = p.rstrip(MARKS)
            if word.isalpha() and (p.isascii() or not self.odd.search(p)):
                plain[p] = " " + word
            else:
                cut_new[p] = self._whole(" " + p) if p and not p[-1].isspace() else None
        alone = np.diff(starts) == 1
        heads_cut = [self._whole(h) if h and (one or not h[-1].isspace()) else None if h else [] for h, one in zip(heads, alone.tolist(), strict=True)]
        self._learn([[*plain.values()], [*{p[len(w) - 1:] for p, w in plain.items() if len(w) <= len(p)}]], cut_new.values(), heads_cut)
        words = self.words
        for p, w in plain.items():
            known[p] = words[w] if len(w) > len(p) else words[w] + words[p[len(w) - 1:]]
        known.update((p, None if ws is None else self._ids(ws)) for p, ws in cut_new.items())
        made = pa.array([*map(known.__getitem__, distinct), *[None if ws is None else self._ids(ws) for ws in heads_cut]], pa.large_binary())
        order[starts[:-1]] = np.arange(len(distinct), len(made))
        # a None: the text is cut into pre-tokens as a whole
        slow = np.flatnonzero(np.logical_or.reduceat(made.is_null().to_numpy(zero_copy_only=False)[order], starts[:-1])).tolist()
        joined = made.take(pa.array(order))
        _, bounds, ids = joined.buffers()
        ends = np.frombuffer(bounds, np.int64, len(joined) + 1)[starts].tolist()
        ids = memoryview(ids or b"")
        out = [bytes(ids[a:b]) for a, b in pairwise(ends)]
        slow_cut = [self._whole(texts[i]) for i in slow]
        self._learn(slow_cut)
        for i, ws in zip(slow, slow_cut, strict=True):
            out[i] = self._ids(ws)
        for p in [p for p in new if len(p) > LONG]:
            del known[p]
        for w in self.long:
            self.words.pop(w, None)
        return out
