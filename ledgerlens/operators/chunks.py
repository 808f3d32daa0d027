"""Chunking sections, chunk quality and chunk statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions import money, text
from ledgerlens.functions.chunking import Cutter, cut

_PIECES = "array<struct<chunk_text:string,token_count:int>>"


def _cut_sections(body: pa.Array, target: pa.Array, limit: pa.Array, overlap: pa.Array, table: pa.Array) -> pa.Array:
    cutter, sizes, pieces = Cutter(), [], []  # of one batch
    for b, g, m, o, s in zip(*(c.to_pylist() for c in (body, target, limit, overlap, table)), strict=True):
        made = cutter.cut(b, g, m, o, vocab.TABLE_SEPARATORS if s else vocab.PROSE_SEPARATORS)
        sizes.append(len(made))
        pieces += made
    texts, tokens = pa.array([t for t, _ in pieces], pa.string()), pa.array([n for _, n in pieces], pa.int32())
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([texts, tokens], names=["chunk_text", "token_count"]))


def cut_sections(body, target, limit, overlap, table) -> Column:
    """Pieces of each section; the fold over one section is sequential, sections are parallel."""
    return F.arrow_udf(_cut_sections, _PIECES)(body, target, limit, overlap, table)


def strategy(section: Column) -> Column:
    """Chunking settings of a section: struct(target, limit, min, overlap, is_table)."""
    def pick(key: str, default: int) -> Column:
        given = {s: v[key] for s, v in vocab.CHUNK_OVERRIDES.items() if key in v}
        out = F.lit(default)
        for name, value in given.items():
            out = F.when(section == name, F.lit(value)).otherwise(out)
        return out

    d = vocab.CHUNK_DEFAULT
    tables = [s for s, v in vocab.CHUNK_OVERRIDES.items() if v.get("table")]
    return F.struct(
        pick("target", d["target"]).alias("target"), F.lit(d["max"]).alias("limit"),
        F.lit(d["min"]).alias("minimum"), pick("overlap", d["overlap"]).alias("overlap"),
        F.coalesce(section.isin(tables), F.lit(False)).alias("is_table"),
    )


def content_hash(c: Column) -> Column:
    return F.sha2(text.strip(c), 256)


def chunk_sections(sections: DataFrame, reports: DataFrame) -> DataFrame:
    """Ordered chunks per report with metadata, first of equal texts kept.

    Everything after the section table is partitioned by ``report_id`` already; both
    windows reuse that.  A report is one accepted file (50 MB at most), which bounds them.
    """
    s = F.col("_s")
    plan = sections.withColumn("_s", strategy(F.col("normalized_section_name")))
    pieces = plan.withColumn(
        "_p", cut_sections("content", s["target"], s["limit"], s["overlap"], s["is_table"])
    ).select(
        "report_id", "section_id", "section_name", "normalized_section_name", "start_page",
        "end_page", "line_no", F.posexplode("_p").alias("piece", "_c"),
    ).select("*", "_c.chunk_text", "_c.token_count").drop("_c")
    order = [F.col("start_page"), F.col("line_no"), F.col("piece")]
    same = Window.partitionBy("report_id", content_hash(F.col("chunk_text"))).orderBy(*order)
    index = Window.partitionBy("report_id").orderBy(*order)
    kept = (
        pieces.filter(~text.is_blank(F.col("chunk_text")))
        .withColumn("_dup", F.row_number().over(same))
        .filter("_dup = 1")
        .withColumn("chunk_index", F.row_number().over(index) - 1)
    )
    facts = reports.select("report_id", "company_id", "company", "report_type", "year", "quarter")
    return kept.join(facts, "report_id", "left").select(
        F.concat_ws("|", "report_id", "chunk_index").alias("chunk_id"), "report_id", "company_id",
        "section_id", "chunk_index", "chunk_text", "token_count", "start_page", "end_page",
        F.col("normalized_section_name").alias("section"),
        F.struct(*vocab.CHUNK_METADATA_KEYS).alias("metadata"),
    )


def company_label(companies: DataFrame) -> DataFrame:
    return companies.select("company_id", F.coalesce("ticker", "name").alias("company"))


def check_chunks(chunks: DataFrame, *, minimum: int = 50, maximum: int = 800) -> DataFrame:
    """Fatal and warning reasons per chunk; duplicates are second and later equal texts.

    The first of equal texts is an aggregate, so a text copied very often collapses before
    it is shuffled; AQE splits the join back where one text is hot.
    """
    hashed = chunks.withColumn("_h", content_hash(F.col("chunk_text")))
    first = hashed.groupBy("report_id", "_h").agg(F.min("chunk_index").alias("_first"))
    blank = text.is_blank(F.col("chunk_text"))
    missing = F.array_except(
        F.array(*[F.lit(k) for k in vocab.CHUNK_METADATA_KEYS]), F.col("metadata_keys"))
    n = F.col("token_count")
    return hashed.join(first, ["report_id", "_h"]).select(
        "report_id", "chunk_index",
        F.array_compact(F.array(
            F.when(blank, F.lit("empty_chunk")),
            F.when(~blank & (F.col("chunk_index") > F.col("_first")), F.lit("duplicate_chunk")),
            F.when(~blank & (F.size(missing) > 0), F.concat(
                F.lit("broken_metadata: missing "), F.array_join(F.array_sort(missing), ","))),
        )).alias("fatal"),
        F.array_compact(F.array(
            F.when(~blank & (n < minimum), F.concat(F.lit("too_small: "), n, F.lit(f" < {minimum}"))),
            F.when(~blank & (n > maximum), F.concat(F.lit("too_large: "), n, F.lit(f" > {maximum}"))),
        )).alias("warnings"),
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Token statistics per (report, section) and per report in one pass."""
    named = chunks.select("report_id", F.coalesce("section", F.lit("Unknown")).alias("section"), "token_count")
    return named.rollup("report_id", "section").agg(
        F.grouping("report_id").alias("_all"), F.grouping("section").cast("int").alias("is_total"),
        F.count(F.lit(1)).alias("chunk_count"), F.sum("token_count").alias("total_tokens"),
        F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"),
        F.bround(F.avg("token_count"), 1).alias("avg_tokens"),
    ).filter("_all = 0").drop("_all")


def candidate_chunks(chunks: DataFrame, sections: list[str]) -> DataFrame:
    """Chunks of the wanted sections; a report without any keeps all of its chunks.

    Whether a report has one is an aggregate with one row per report, joined back, so a
    report's chunks are not brought into one task.
    """
    wanted = F.coalesce(F.col("section").isin(sections), F.lit(False))
    has = chunks.groupBy("report_id").agg(F.bool_or(wanted).alias("_has"))
    return chunks.join(has, "report_id").filter(wanted | ~F.col("_has")).drop("_has")


def embedding_progress(chunks: DataFrame, key: str = "report_id") -> DataFrame:
    """Counts by embedding status, coverage and readiness flags."""
    status = F.col("embedding_status")
    done = F.count("embedding")
    total = F.count(F.lit(1))
    return chunks.groupBy(key).agg(
        total.alias("total_chunks"),
        *[F.count_if(status == s).alias(s.lower()) for s in vocab.EMBEDDING_STATUSES],
        done.alias("embedded_chunks"), (total - done).alias("missing_chunks"),
        F.bround(done * 100 / total, 1).alias("coverage_pct"),
        (done == total).alias("fully_embedded"), (done > 0).alias("retrieval_ready"),
    )


def first_previews(chunks: DataFrame, chars: int = 300) -> DataFrame:
    """Opening text of the first chunk of each report."""
    return chunks.groupBy("report_id").agg(
        F.min_by(F.substring("chunk_text", 1, chars), F.col("chunk_index")).alias("text_preview"))


def embedding_cost(chunks: DataFrame, key: str = "report_id") -> DataFrame:
    """Tokens, provider batches and estimated cost of embedding what is still missing."""
    todo = chunks.filter(F.col("embedding").isNull())
    tokens = F.sum("token_count")
    return todo.groupBy(key).agg(
        F.count(F.lit(1)).alias("chunks"), tokens.alias("tokens"),
        F.ceil(F.count(F.lit(1)) / vocab.EMBED_BATCH).alias("batches"),
        F.bround(tokens / 1_000_000 * vocab.EMBED_PRICE_PER_MILLION, 6).alias("cost_usd"),
    )


def register_chunk_text(spark) -> None:
    """SQL table function ``chunk_text(text, section)`` -> (piece, chunk_text, token_count)."""
    defaults, overrides = vocab.CHUNK_DEFAULT, vocab.CHUNK_OVERRIDES
    prose, tables = vocab.PROSE_SEPARATORS, vocab.TABLE_SEPARATORS

    class ChunkText:
        def eval(self, body: str, section: str):
            s = {**defaults, **overrides.get(section or "", {})}
            pieces = cut(body, s["target"], s["max"], s["overlap"], tables if s.get("table") else prose)
            for piece, (content, tokens) in enumerate(pieces):
                yield piece, content, tokens

    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType="piece int, chunk_text string, token_count int"))
