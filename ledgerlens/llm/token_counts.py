"""Token counts by the whole-token shortcut, for SentencePiece models of the BPE kind.

Two facts are proved offline, from the model alone:

* no piece has the space mark after another character, so no merge crosses from a word into
  the space before the next, and the count of a text is the sum over its segments cut there;
* which pieces, put in as text, come back as one token: a segment equal to one counts 1.

All other segments are merged by the library, each distinct one once per cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Vocabulary, local_path, per_worker, text_slices

MARK = "▁"
LIMIT = 4096
CACHED_SEGMENTS = 400_000
CACHED_LENGTH = 64


class Counter:
    """Counts tokens of whole texts; built once per task from the model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece runs over a space; texts cannot be cut at spaces")
        self.whole = self._whole(pieces)
        self.cache: dict[str, int] = dict(self.whole)

    def _whole(self, pieces: list[str]) -> dict[str, int]:
        """Segments (the leading space mark left off) that are one token, found by encoding each candidate."""
        words = [p[1:].replace(MARK, " ") for p in pieces if p.startswith(MARK) and len(p) > 1]
        found = {w: 1 for w, ids in zip(words, self.model.encode(words, num_threads=1), strict=True) if len(ids) == 1}
        # a lone space mark cannot be put in by itself: the difference it makes after a letter
        found[""] = len(self.model.encode("a ")) - len(self.model.encode("a"))
        return found

    def count(self, texts: list[str]) -> list[int]:
        cut = [segments(t) for t in texts]
        need = {s for own in cut for s in own}
        if len(self.cache) > CACHED_SEGMENTS:
            self.cache = dict(self.whole)
        missing = [s for s in need if s not in self.cache]
        self.cache.update(zip(missing, map(len, self.model.encode(missing, num_threads=1)), strict=True))
        counts = [sum(map(self.cache.__getitem__, own)) for own in cut]
        for s in missing:
            if len(s) > CACHED_LENGTH:
                del self.cache[s]
        return counts


def segments(text: str) -> list[str]:
    """Cut at every space that follows a character other than a space or its mark; the space is left off."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " ":
        return text.split(" ")
    out, start = [], 0
    at = text.find(" ")
    while at >= 0:
        if at > 0 and text[at - 1] not in (" ", MARK):
            out.append(text[start:at])
            start = at + 1
        at = text.find(" ", at + 1)
    out.append(text[start:])
    return out


def token_counts(docs: DataFrame, model: Vocabulary, *, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every whole text.

    A NULL text counts as empty: no bytes, no tokens.  Repeated rows are counted each, and
    NULL ids kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch, texts in text_slices(batches):
            path = local_path(model)
            counter = counter or per_worker(f"counter {path}", lambda: Counter(path))
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            counts = np.array(counter.count([t.decode("utf-8", "replace") for t in texts]), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(counts), pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
