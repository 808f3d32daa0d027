"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import shared_folder

# Text bytes that a Python task takes up at once; a longer text is taken alone.
SLICE_BYTES = 2 << 20


# A tokenizer file: its path, or what gives the path on the machine that asks.
Vocabulary = str | Callable[[], str]


def local_path(vocabulary: Vocabulary) -> str:
    return vocabulary() if callable(vocabulary) else vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut so that the texts of one slice have about ``size`` bytes; NULL becomes empty."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        texts = batch.column(at).cast(pa.binary())
        start, held = 0, 0
        for row, n in enumerate(_lengths(texts)):
            held += n
            if held >= size or row == batch.num_rows - 1:
                part = texts.slice(start, row + 1 - start)
                yield batch.slice(start, row + 1 - start), [t or b"" for t in part.to_pylist()]
                start, held = row + 1, 0


def _lengths(texts: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def row_hash(df: DataFrame) -> Column:
    """Hash of the whole row: spreads rows whatever key they share, the same on every run."""
    plain = [c for c, kind in df.dtypes if not kind.startswith("map")]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``, as a URI every executor can use."""
    import uuid

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has such a column already (upper and lower case alike)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


# Rows of ids or sources, some dozen bytes each, that every task may hold.
BROADCAST_ROWS = 200_000


def sent_if_small(side: DataFrame) -> DataFrame:
    """``side``, broadcast if it has at most ``BROADCAST_ROWS`` rows; counted, for a checkpoint has no size to plan by."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def map_rows(df: DataFrame, run, fields: list) -> DataFrame:
    """``mapInArrow`` over all columns of ``df``, whatever their names; ``run`` sees them as c0, c1, ...

    ``fields`` are added after them.  The text column's name inside is ``text_name(df)``.
    """
    from pyspark.sql import types as T

    names = [f"c{i}" for i in range(len(df.columns))]
    plain = [T.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields, strict=True)]
    return df.toDF(*names).mapInArrow(run, T.StructType([*plain, *fields])).toDF(*df.columns, *[f.name for f in fields])


def text_name(df: DataFrame) -> str:
    return f"c{df.columns.index('text')}"


def per_worker(key: str, make):
    """``make()``, once per Python worker: a cache of words outlives a task, for workers run many.

    A worker holds one at a time; that of another operator is let go.
    """
    import sys
    from types import SimpleNamespace

    held = sys.modules.setdefault("_training_data_worker", SimpleNamespace(made={})).made
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]
