"""Session settings and what every job shares: lineage cuts and the folder they go to."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Spark's own setting: a query built while it is on gives its shuffle files back when it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the jobs assume.  Sizing (executors, shuffle partitions) stays with the caller."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder (``spark.checkpoint.dir``).

    The folder comes from the session.  Only where neither the session nor the
    context names one (unit tests, local runs) is a scratch folder chosen.  Once written, the
    checkpoint is all that later steps read, so the shuffle files behind it are given back at
    once; otherwise they lie there until the driver's garbage collector comes by.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    with shuffles_given_back(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


@contextmanager
def shuffles_given_back(spark: SparkSession) -> Iterator[None]:
    """Queries built within leave no shuffle files; the session's setting is put back afterwards."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a scratch folder only where nothing is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    return folder
