"""Section detection: pages of lines to named page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions import money, text

# A line ends after any of these; the marks stay on the line so lengths give offsets.
LINE_END = r"(?<=[\n\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029])|(?<=\r)(?!\n)"
OTHER_LINE_ENDS = r"[\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
TOC_TAIL = r"(\.{2,}\s*\d{1,4}|\s{2,}\d{1,4})\s*$"
ENUMERATION = r"^\s*([0-9]{1,2}[A-Za-z]?|[IVXivx]+)[\.\)\:\-]\s+"
ITEM_LINE = r"(?i)^\s*item\s+(\d{1,2}[A-Za-z]?)\b[\.\:\)\-\s]*(.*)$"
PART_LINE = r"(?i)^\s*part\s+([ivx]+)\b"


# --- line level -------------------------------------------------------------------------
def page_lines(pages: DataFrame) -> DataFrame:
    """Lines of each page with their place and their length including the line end.

    Nearly all pages end lines with a line feed only and take the plain split.
    """
    odd = F.col("page_text").rlike(OTHER_LINE_ENDS)
    pieces = F.when(odd, F.split("page_text", LINE_END)).otherwise(F.split("page_text", "\n"))
    exploded = pages.select(
        "report_id", "page_number", odd.alias("_odd"), F.posexplode(pieces).alias("line_no", "_raw"))
    return exploded.select(
        "report_id", "page_number", "line_no", text.strip(F.col("_raw")).alias("line"),
        (F.length("_raw") + F.when(F.col("_odd"), F.lit(0)).otherwise(F.lit(1))).alias("_len"),
    )


def lines_with_offsets(pages: DataFrame) -> DataFrame:
    """As :func:`page_lines`, with the character offset of each line in its page.

    The window holds the lines of one page, which were one row before the explode.
    """
    w = Window.partitionBy("report_id", "page_number").orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, -1)
    return page_lines(pages).withColumn(
        "offset", F.coalesce(F.sum("_len").over(w), F.lit(0)).cast("int")
    ).filter(F.length("line") > 0).drop("_len")


def is_toc_line(line: Column) -> Column:
    return line.rlike(TOC_TAIL)


def clean_heading(line: Column) -> Column:
    out = F.regexp_replace(line, TOC_TAIL, "")
    out = F.regexp_replace(out, ENUMERATION, "")
    out = F.regexp_replace(out, r"^[ \t\-:.]+|[ \t\-:.]+$", "")
    return text.squeeze(out)


def is_strong_heading(line: Column) -> Column:
    words = F.size(F.filter(F.split(line, f"{text.WS}+"), lambda w: F.length(w) > 0))
    return (
        F.length(line).between(2, vocab.HEADING_MAX_CHARS)
        & (words <= vocab.HEADING_MAX_WORDS)
        & ~line.rlike(r"[.!?;,]$")
    )


def is_mostly_upper(line: Column) -> Column:
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    return (letters > 0) & (F.regexp_count(line, F.lit(r"\p{Lu}")) >= letters * 0.7)


def _alias_map() -> dict[str, str]:
    exact = {name.lower(): name for name in vocab.SECTIONS}
    for canonical, aliases in vocab.SECTION_ALIASES.items():
        for alias in aliases:
            exact[alias] = canonical
    return exact


def _holds_phrase(lowered: Column, phrase: Column) -> Column:
    """The first occurrence of the phrase stands on word boundaries."""
    at = F.instr(lowered, phrase)
    alnum = r"^[\p{L}\p{N}]$"
    before = F.substring(lowered, at - 1, F.lit(1))
    after = F.substring(lowered, at + F.length(phrase), F.lit(1))
    return (at > 0) & ((at == 1) | ~before.rlike(alnum)) & ~after.rlike(alnum)


def heading_exact(cleaned: Column) -> Column:
    """Canonical section of a cleaned heading that equals an alias or a section name."""
    return money.mapping(_alias_map())[F.lower(cleaned)]


def heading_within(cleaned: Column) -> Column:
    """Canonical section of the longest alias that occurs in the heading as a phrase."""
    aliases = [(a, c) for c, names in vocab.SECTION_ALIASES.items() for a in names]
    aliases.sort(key=lambda ac: -len(ac[0]))
    known = text.dictionary(aliases, "alias string, section string")
    anything = text.literal_alternation([a for a, _ in aliases])
    return text.let(F.lower(cleaned), lambda low: F.when(
        low.rlike(anything),
        F.try_element_at(F.filter(known, lambda k: _holds_phrase(low, k["alias"])), F.lit(1))["section"],
    ))


def item_section(report_type: Column, part: Column, code: Column) -> Column:
    """Section of an item number; quarterly filings depend on the part, unknown types try both."""
    flat = {f"{g}|{i}": s for g, items in vocab.ITEM_SECTIONS.items() for i, s in items.items()}
    at = lambda group: money.mapping(flat)[F.concat(group, F.lit("|"), F.upper(code))]
    annual, quarterly = at(F.lit("10-K")), at(F.concat(F.lit("10-Q-"), part))
    kind = F.upper(F.coalesce(report_type, F.lit("")))
    return (
        F.when(kind == "10-Q", quarterly).when(kind == "10-K", annual)
        .otherwise(F.coalesce(annual, at(F.lit("10-Q-I"))))
    )


# --- detection -----------------------------------------------------------------------------
def heading_hits(pages: DataFrame, reports: DataFrame) -> DataFrame:
    """Lines that start a section: report, page, line, section and confidence.

    Only short lines, item lines and part lines are kept before the one ordered step
    (the part carried forward), so that window sees a handful of rows per report.
    """
    line = F.col("line")
    lines = page_lines(pages).filter(F.length("line") > 0)
    is_part = line.rlike(PART_LINE)
    is_item = line.rlike(ITEM_LINE)
    candidates = lines.filter(is_strong_heading(line) | is_part | is_item).filter(~is_toc_line(line))
    title = text.squeeze(F.regexp_extract(line, ITEM_LINE, 2))
    cleaned = clean_heading(F.when(is_item, title).otherwise(line))
    tagged = candidates.select(
        "report_id", "page_number", "line_no", "line",
        F.when(is_part, F.upper(F.regexp_extract(line, PART_LINE, 1))).alias("part"),
        F.when(is_item & ~is_part, F.upper(F.regexp_extract(line, ITEM_LINE, 1))).alias("item"),
        cleaned.alias("cleaned"),
    ).withColumn("_exact", heading_exact(F.col("cleaned"))).withColumn(
        "_within", F.when(F.col("_exact").isNull(), heading_within(F.col("cleaned")))
    ).filter("part is not null or item is not null or _exact is not null or _within is not null")

    so_far = Window.partitionBy("report_id").orderBy("page_number", "line_no")
    placed = tagged.join(
        reports.select("report_id", "report_type"), "report_id", "left"
    ).withColumn(
        "_part", F.coalesce(F.last("part", ignorenulls=True).over(so_far), F.lit("I"))
    ).filter("part is null")

    by_item = F.when(
        F.col("item").isNotNull(), item_section(F.col("report_type"), F.col("_part"), F.col("item")))
    by_text = F.coalesce("_exact", "_within")
    c = {k: F.lit(v) for k, v in vocab.SECTION_CONFIDENCE.items()}
    tier = F.when(F.col("_exact").isNotNull(), c["exact_alias"]).otherwise(c["pattern"])
    in_transcript = (F.upper("report_type") == "TRANSCRIPT") & by_text.isin(vocab.TRANSCRIPT_SECTIONS)
    loud = F.col("_exact").isNotNull() & is_mostly_upper(F.col("line"))
    lifted = F.when(
        F.col("item").isNull() & F.coalesce(in_transcript | loud, F.lit(False)),
        F.greatest(tier, c["transcript_marker"]),
    ).otherwise(tier)
    return placed.select(
        "report_id", "page_number", "line_no", "line",
        F.coalesce(by_item, by_text).alias("section"),
        F.when(by_item.isNotNull(), c["sec_item"]).otherwise(lifted).alias("confidence"),
    ).filter("section is not null")


def section_spans(pages: DataFrame, reports: DataFrame) -> DataFrame:
    """First hit of each section with its page range; reports without a hit get one fallback."""
    order = F.struct("page_number", "line_no")
    starts = heading_hits(pages, reports).groupBy("report_id", "section").agg(
        F.min_by(F.struct("page_number", "line_no", "line", "confidence"), order).alias("h")
    )
    extent = pages.groupBy("report_id").agg(
        F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"))
    # at most one row per section name in this window
    w = Window.partitionBy("report_id").orderBy("h.page_number", "h.line_no")
    start = F.col("h.page_number")
    following = F.lead("h.page_number").over(w)
    spans = extent.join(starts, "report_id", "left")
    end = F.when(following.isNull(), F.col("last_page")).otherwise(following - 1)
    return spans.select(
        "report_id",
        F.coalesce("h.line", F.lit(vocab.FALLBACK_SECTION)).alias("section_name"),
        F.coalesce("section", F.lit(vocab.FALLBACK_SECTION)).alias("normalized_section_name"),
        F.coalesce(start, F.col("first_page")).alias("start_page"),
        F.greatest(F.coalesce(start, F.col("first_page")), end).alias("end_page"),
        F.coalesce("h.line_no", F.lit(0)).alias("line_no"),
        F.coalesce("h.confidence", F.lit(vocab.FALLBACK_CONFIDENCE)).cast("decimal(4,3)").alias("confidence_score"),
    )


def detect_sections(pages: DataFrame, reports: DataFrame) -> DataFrame:
    """Sections with their whole content.

    Pages meet their section on ``report_id`` alone, so the text is shuffled once and the
    grouping by (report, section) reuses that partitioning.
    """
    spans = section_spans(pages, reports)
    # page text is never broadcast, whatever its compressed size suggests
    inside = pages.hint("merge").join(spans, "report_id").filter(
        F.col("page_number").between(F.col("start_page"), F.col("end_page"))
    )
    keys = [c for c in spans.columns if c != "report_id"]
    content = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("page_number", "page_text"))), lambda p: p["page_text"]),
        "\n",
    )
    return inside.groupBy("report_id", "normalized_section_name").agg(
        *[F.first(k).alias(k) for k in keys if k != "normalized_section_name"],
        text.strip(content).alias("content"),
    ).withColumn("section_id", F.concat_ws("|", "report_id", "normalized_section_name"))
