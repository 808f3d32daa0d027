"""Structured Streaming variants of the ingest paths and the event counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens import schemas
from ledgerlens.functions.grouped import first_per, null_safe_join
from ledgerlens.operators import risks, tone
from ledgerlens.operators.chunks import content_hash


def read_stream(spark: SparkSession, path: str, schema: str, *, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as they land, with a declared schema."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def page_chunks(pages: DataFrame) -> DataFrame:
    """Each page as one chunk in the shape the risk and tone jobs read."""
    return pages.select(
        "report_id", F.lit(None).cast("string").alias("company_id"),
        F.concat_ws("|", "report_id", "page_number").alias("chunk_id"),
        F.col("page_number").alias("chunk_index"), F.lit(None).cast("string").alias("section"),
        F.col("page_text").alias("chunk_text"))


def write_batch(path: str, rows: DataFrame, keys: DataFrame, batch_id: int, key: list[str]) -> None:
    """Idempotent batch sink: the rows of a batch and the keys it replaces, side by side.

    A batch that runs again overwrites its own folder.  Nothing older is rewritten, so the
    cost of a batch is the size of the batch; a key that now has no rows is still replaced.
    """
    rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
    keys.select(*key).distinct().write.mode("overwrite").parquet(f"{path}/keys/batch={batch_id}")


def read_latest(spark: SparkSession, path: str, key: list[str] | None = None) -> DataFrame:
    """Rows of the newest batch of each key (a page of a report).  The choice is an aggregate over keys only."""
    return _latest(spark, path, key or PAGE).drop("batch")


def _latest(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    rows, keys = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/keys").select(*key, "batch")
    folds = _versions(spark, f"{path}/folded")
    if folds:  # batches up to the fold are not read
        folded = spark.read.parquet(f"{path}/folded/version={folds[-1]}")
        rows = rows.filter(F.col("batch") > folds[-1]).unionByName(folded)
        keys = keys.filter(F.col("batch") > folds[-1]).unionByName(folded.select(*key, "batch"))
    newest = keys.groupBy(*key).agg(F.max("batch").alias("batch"))
    return null_safe_join(rows, newest, [*key, "batch"], "left_semi")


def fold_batches(spark: SparkSession, path: str, key: list[str] | None = None) -> int:
    """Writes what holds after the newest batch, so that readers skip all earlier ones; gives that batch.

    Readers use the newest finished fold.  Folders of earlier batches may then be deleted.
    """
    newest = spark.read.parquet(f"{path}/keys").agg(F.max("batch")).first()[0]
    _latest(spark, path, key or PAGE).write.mode("overwrite").parquet(f"{path}/folded/version={newest}")
    return newest


def read_merged(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The newest row of each key of an update stream; NULL is a key like any other."""
    rows = spark.read.parquet(f"{path}/rows")
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*key, "_row.*")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished version folders of a result that is written whole each time."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    done = [n for n in names if n.startswith("version=") and fs.exists(
        jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version."""
    return spark.read.parquet(f"{path}/version={_versions(spark, path)[-1]}")


def stream_pages(pages: DataFrame, tone_path: str, risk_path: str, checkpoint: str, report_risk_path: str | None = None) -> StreamingQuery:
    """Pages as they land become tone and risk rows, replaced page by page.

    A report whose pages come in several batches keeps the rows of them all.  The sinks
    read the batch, which is persisted for that long.

    ``report_risk_path`` takes one row per risk of a report, the best of all its pages so
    far (``report_risks``).  Only reports with a page in the batch are worked out again;
    a risk that no page names any more goes, and a better or earlier page takes over.  In
    whatever batches the pages come, the table is that of one batch.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            chunks = page_chunks(batch)
            # a page is a report of one page to the extraction, which keeps one risk per name and report
            paged = chunks.withColumn("report_id", F.col("chunk_id"))
            keys = batch.select("report_id", "page_number", F.concat_ws("|", "report_id", "page_number").alias("source_chunk_id")).distinct()
            for path, made in ((tone_path, tone.score_tone(chunks)), (risk_path, risks.extract_risks(paged))):
                found = made.drop("report_id").join(keys, "source_chunk_id")
                write_batch(path, found, keys, batch_id, PAGE)
            if report_risk_path:
                touched = batch.select("report_id").distinct()
                held = null_safe_join(read_latest(batch.sparkSession, risk_path), touched, ["report_id"], "left_semi")
                write_batch(report_risk_path, report_risks(held), touched, batch_id, ["report_id"])
        finally:
            batch.unpersist()

    return pages.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def report_risks(page_risks: DataFrame) -> DataFrame:
    """The best of the risks that pages of a report name alike: highest confidence, then first page."""
    best = first_per(
        page_risks, ["report_id", "normalized_risk_name"],
        [-F.col("confidence_score"), F.col("page_number"), F.col("source_chunk_id")])
    return best.withColumn("risk_id", F.concat_ws("|", "report_id", "normalized_risk_name"))


def stream_dedupe(chunks: DataFrame, ts: str = "ts", *, horizon: str = "1 day") -> DataFrame:
    """First chunk of each (report, text hash) within the watermark horizon."""
    return chunks.withColumn("content_hash", content_hash(F.col("chunk_text"))).withWatermark(
        ts, horizon).dropDuplicatesWithinWatermark(["report_id", "content_hash"])


def stream_rate(events: DataFrame, user: str = "user_id", ts: str = "ts", *, window: str = "60 seconds",
                slide: str = "10 seconds", late: str = "5 minutes", limit: int = 10) -> DataFrame:
    """Events per user in sliding windows, and whether a window exceeds the limit."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window, slide), user).agg(
        F.count(F.lit(1)).alias("n")).select(
            F.col("window.start").alias("window_start"), user, "n", (F.col("n") > limit).alias("limited"))


def stream_counts(events: DataFrame, kind: str = "event_type", ts: str = "ts", *, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per kind in tumbling windows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), kind).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), kind, "n")


def stream_slices(events: DataFrame, user: str = "user_id", ts: str = "ts", *, slide: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """Events per user and slice of ``slide``: slice_start (seconds) and n, to be run with mode "update".

    What sliding windows are put together from (``sliding_counts``): one state entry per
    user and slice, where windows would hold each event width/slide times.  Counts are
    combined before the shuffle, so a user with a third of all events is no long task.
    Rows later than ``late`` are dropped, and so is the state of slices that old.
    """
    return events.withWatermark(ts, late).groupBy(F.window(ts, slide), user).agg(F.count(F.lit(1)).alias("n")).select(
        F.unix_seconds("window.start").alias("slice_start"), user, "n")


def sliding_counts(slices: DataFrame, user: str = "user_id", *, window: int = 60, slide: int = 10, limit: int = 10) -> DataFrame:
    """Slices of ``slide`` seconds as windows of ``window`` seconds (a multiple): window_start, n, limited."""
    if window % slide:
        raise ValueError(f"a window of {window} s has no whole number of slices of {slide} s")
    starts = F.sequence(F.col("slice_start") - (window - slide), F.col("slice_start"), F.lit(slide).cast("bigint"))
    return slices.select(F.explode(starts).alias("window_start"), user, "n").groupBy("window_start", user).agg(
        F.sum("n").alias("n")).withColumn("limited", F.col("n") > limit)


def run_to_table(df: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Process everything available and stop; the result lands in Parquet.

    Append results are written as they come, and update results per batch: the rows that
    changed, so a batch costs what it changes (``read_merged``).  Complete results are
    written whole per version.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").option("path", path).start()
    folder = "rows/batch" if mode == "update" else "version"
    return writer.foreachBatch(
        lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/{folder}={n}")).start()


# what a batch of pages replaces: the page, named by its chunk
PAGE = ["report_id", "source_chunk_id"]
PAGES_SCHEMA = schemas.TABLES["pages"]
