"""Token ids in flat binary files: one run of unsigned integers per part, with 64-bit document offsets.

A run is three files: ``.ids`` (little-endian unsigned 16- or 32-bit ids, documents one
after the other), ``.offsets`` (signed 64-bit, one more than there are documents) and
``.docs`` (signed 64-bit document ids; a NULL id is stored as -2^63).  The manifest, one row
per run, names the files and gives each run's base: the tokens and documents before it,
prefix sums over the runs in order of document id; a task begins a new one every 256 MB.
A reader maps the files into memory, or reads them by ranges where the store has none to map.

Parts are written by whichever attempt of a task succeeds.  Every attempt has its own file
names and reports them with its counts, so what a lost executor left behind is never read.

Texts are encoded through a cache of words (``cached_words``, which states where a text may be
cut); a word not seen lately is encoded by the library.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from sys import byteorder

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.cached_words import CachedWords, byte_characters
from ledgerlens.llm.common import Vocabulary, local_path, per_worker, text_slices

END_ID = 0
NO_ID = -(1 << 63)
# Text bytes that are cut into words at once: more repeat, so fewer are looked up.
SLICE = 6 << 20
# Bytes of ids after which a task begins a new file.
FILE_BYTES = 256 << 20
# Documents whose offsets a reader takes up at once.
READ_DOCUMENTS = 10_000


class LibraryWords(CachedWords):
    """Words go to the library's model one by one, as the characters that stand for their bytes."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.model = self.tokenizer.model
        # all 256, for translate() is slow with characters that it finds no entry for
        self.characters = str.maketrans(dict(enumerate(byte_characters())))

    def _mapped(self, word: str) -> str:
        """Its bytes' characters: of the printable ASCII ones, only the space has another."""
        if word.isascii() and word.isprintable():
            return word.replace(" ", self.characters[0x20])
        return word.encode().decode("latin-1").translate(self.characters)

    def fresh(self, words: list[str]) -> list[bytes]:
        tokens, mapped, code = self.model.tokenize, self._mapped, "H" if self.kind.itemsize == 2 else "I"
        made = [array(code, [t.id for t in tokens(mapped(w))]) for w in words]
        if byteorder == "big":
            for a in made:
                a.byteswap()
        return [a.tobytes() for a in made]


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: Vocabulary, *, end_id: int = END_ID, parts: int | None = None, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write ``docs`` in ascending ``doc_id`` order below ``folder`` (a URI); returns the manifest.

    NULL ids come first.  Rows that share an id are ordered by a hash of their text.  A NULL
    text is empty; every document ends with ``end_id``.  The manifest also lies in the
    folder, as Parquet; an empty table writes an empty one.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    # the tie is part of the range, so that one id with a large share of the rows still spreads
    ordered = keyed.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
    schema = "part int, file int, name string, width int, documents long, tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        out, done = None, []
        for batch, texts in text_slices(batches, size=SLICE):
            path = local_path(tokenizer)
            encoder = per_worker(f"encoder {path}", lambda: LibraryWords(path))
            if out is None:
                out = _Run(folder, f"{name}-{len(done):04d}", encoder.kind, end_id)
            out.add(batch.column(0), encoder.encode([t.decode("utf-8", "replace") for t in texts]))
            if out.bytes >= file_bytes:
                done.append(out.close())
                out = None
        if out is not None:
            done.append(out.close())
        if done:
            names, widths, documents, tokens = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(done), pa.int32()), pa.array(range(len(done)), pa.int32()), pa.array(names), pa.array(widths, pa.int32()),
                 pa.array(documents, pa.int64()), pa.array(tokens, pa.int64())], names=["part", "file", "name", "width", "documents", "tokens"])

    written = ordered.mapInArrow(run, schema).collect()  # a row per file
    rows, first_doc, first_token = [], 0, 0
    for r in sorted(written, key=lambda r: (r["part"], r["file"])):
        rows.append((*r, first_doc, first_token))
        first_doc, first_token = first_doc + r["documents"], first_token + r["tokens"]
    manifest = spark.createDataFrame(rows, schema + ", first_document long, first_token long").coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest.parquet")
    return spark.read.parquet(f"{folder}/manifest.parquet")


class _Run:
    """One run of documents on its way into its three files."""

    def __init__(self, folder: str, name: str, kind: np.dtype, end_id: int) -> None:
        self.store, self.root = _files(folder)
        self.store.create_dir(self.root, recursive=True)
        self.name, self.kind, self.end = name, kind, np.array([end_id], kind).tobytes()
        self.ids = self.store.open_output_stream(f"{self.root}/{name}.ids")
        self.offsets, self.docs, self.bytes = [np.zeros(1, np.int64)], [], 0

    def add(self, doc_ids: pa.Array, made: list[bytes]) -> None:
        sizes = np.fromiter(map(len, made), np.int64, len(made)) + len(self.end)
        self.ids.write(self.end.join([*made, b""]))
        ends = self.bytes + np.cumsum(sizes)
        self.offsets.append(ends // self.kind.itemsize)
        self.bytes = int(ends[-1])
        self.docs.append(doc_ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8"))

    def close(self) -> tuple[str, int, int, int]:
        """Name, width, documents and tokens."""
        self.ids.close()
        for kind, arrays in (("offsets", self.offsets), ("docs", self.docs)):
            with self.store.open_output_stream(f"{self.root}/{self.name}.{kind}") as f:
                f.write(np.concatenate(arrays).astype("<i8").tobytes())
        return self.name, self.kind.itemsize, sum(map(len, self.docs)), self.bytes // self.kind.itemsize


class _Mapped:
    """A file as an array: mapped where the store is local, else read by ranges."""

    def __init__(self, store, path: str, kind: str) -> None:
        from pyarrow import fs

        self.kind, self.file = np.dtype(kind), None
        if isinstance(store, fs.LocalFileSystem):
            self.array = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        else:
            self.file = store.open_input_file(path)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.file is None:
            return self.array[part]
        width = self.kind.itemsize
        return np.frombuffer(self.file.read_at((part.stop - part.start) * width, part.start * width), self.kind)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the files.

    ``start`` counts the ids of all documents before; the checksum is that of the ids as
    little-endian unsigned 32-bit integers, the end id included.
    """
    manifest = spark.read.parquet(f"{folder}/manifest.parquet")
    parts = max(1, manifest.count())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _files(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids = _Mapped(store, f"{root}/{row['name']}.ids", f"<u{row['width']}")
                offsets = _Mapped(store, f"{root}/{row['name']}.offsets", "<i8")
                docs = _Mapped(store, f"{root}/{row['name']}.docs", "<i8")
                for at in range(0, row["documents"], READ_DOCUMENTS):
                    own = docs[at:min(at + READ_DOCUMENTS, row["documents"])]
                    bound = offsets[at:at + len(own) + 1].tolist()
                    sums = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(bound, bound[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64(), mask=np.asarray(own) == NO_ID), pa.array(np.array(bound[:-1]) + row["first_token"]),
                         pa.array(np.diff(bound)), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("name", "width", "documents", "first_token").repartition(parts).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
