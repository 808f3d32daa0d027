"""Byte-pair encoding by a priority queue of merges over a linked list of symbols, and decoding.

A pre-token starts as its bytes, each a symbol of a doubly linked list.  Every pair of
neighbours that the merge table knows is put into a queue under (rank, place).  The least
entry is taken; it is stale, and skipped, when its left symbol is gone or that symbol and
its neighbour are no longer the pair of this rank.  Else the two become one symbol and the
two new pairs beside it are queued.  A pre-token of n bytes takes O(n log n).

Decoding puts the vocabulary's strings of the ids together, turns their characters back into
bytes and reads these as UTF-8, with the replacement character where they are none.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise
from sys import byteorder

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.cached_words import CachedWords, byte_characters
from ledgerlens.llm.common import Vocabulary, local_path, per_worker, text_slices


# Text bytes that are cut into words at once: more repeat, so fewer are looked up.
SLICE = 6 << 20


class PairQueue:
    """Merges of one vocabulary: ``vocab`` gives each symbol's id, ``merges`` the pairs in order of rank."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.of_byte = [vocab[c] for c in byte_characters()]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for a, b in merges:
            self.rank.setdefault(vocab[a] << 32 | vocab[b], len(self.merged))
            self.merged.append(vocab[a + b])

    def ids(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        symbols = [self.of_byte[b] for b in word]
        n, rank, merged = len(symbols), self.rank.get, self.merged
        width = n.bit_length()
        place = (1 << width) - 1
        queue = [r << width | i for i, (a, b) in enumerate(pairwise(symbols)) if (r := rank(a << 32 | b)) is not None]
        if not queue:
            return symbols
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i = entry & place
            j, left = after[i], symbols[i]
            if left < 0 or j >= n or rank(left << 32 | symbols[j]) != entry >> width:
                continue
            symbols[i] = left = merged[entry >> width]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(left << 32 | symbols[k])) is not None:
                    heappush(queue, r << width | i)
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] << 32 | left)) is not None:
                heappush(queue, r << width | h)
        return [s for s in symbols if s >= 0]


class Codec(CachedWords):
    """Encodes whole texts as the ``tokenizers`` library does with the same file, and decodes ids."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        model = self.spec["model"]
        self.pairs = PairQueue(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        byte = {ord(c): b for b, c in enumerate(byte_characters())}
        named = {i: s for s, i in model["vocab"].items()}
        top = max([*named, *self.added.values()]) + 1
        self.bytes_of = [bytes(byte[ord(c)] for c in named[i]) if i in named else b"" for i in range(top)]
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.decimal = [str(i).encode() for i in range(top)]

    def fresh(self, words: list[str]) -> list[bytes]:
        ids, code = self.pairs.ids, "H" if self.kind.itemsize == 2 else "I"
        made = [array(code, ids(w.encode())) for w in words]
        if byteorder == "big":
            for a in made:
                a.byteswap()
        return [a.tobytes() for a in made]

    def decode(self, ids: list[int]) -> bytes:
        """The text of the ids as UTF-8."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        return raw


def encoded(docs: DataFrame, tokenizer: Vocabulary) -> DataFrame:
    """``doc_id``, ``ids`` (ints, in order) and ``decoded`` (their text) of every row of ``docs``.

    A NULL or empty text has no ids and an empty decoded text.  Repeated rows and ids stay;
    other columns are not looked at.  An empty table gives an empty result.
    """
    return _mapped(docs, tokenizer, "ids array<int>, decoded string", lambda codec, ids: (ids, codec.decode(ids).decode()))


def digests(docs: DataFrame, tokenizer: Vocabulary) -> DataFrame:
    """``doc_id``, ``n_tokens``, and SHA-256 of the comma-joined decimal ids and of the decoded text, as ``encoded`` has them."""

    def made(codec: Codec, ids: list[int]) -> tuple:
        return (len(ids), hashlib.sha256(b",".join(map(codec.decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())

    return _mapped(docs, tokenizer, "n_tokens long, ids_sha256 string, decoded_sha256 string", made)


def _mapped(docs: DataFrame, tokenizer: Vocabulary, fields: str, made) -> DataFrame:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    columns = [f.split(" ") for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, size=SLICE):
            path = local_path(tokenizer)
            codec = per_worker(f"codec {path}", lambda: Codec(path))
            rows = []
            for raw in codec.encode([t.decode("utf-8", "replace") for t in texts]):
                rows.append(made(codec, np.frombuffer(raw, codec.kind).tolist()))
            arrays = [pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *[name for name, _ in columns]])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, f"doc_id long, {fields}")
