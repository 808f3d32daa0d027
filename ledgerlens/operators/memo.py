"""Memo packages, deterministic memo text, citations and grounding checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions import money, text
from ledgerlens.functions.grouped import top_per
from ledgerlens.operators import quality
from ledgerlens.session import cut_lineage

NUMBER = r"\b\d+(?:,\d+)*(?:\.\d+)?%?\b"


def _nest(
    df: DataFrame, key: str, fields: list, order: list[str], name: str, k: int | None = None, also: dict[str, Column] | None = None,
) -> DataFrame:
    """All rows of a key, or its first ``k``, as one ordered array.  ``k`` rows survive the map side.

    ``also`` are aggregates of the same rows (``_n`` is the place among the first ``k``); a
    reader that needs no more than them leaves the array out, and its fields are not shuffled.
    """
    if k is None:
        rows = df.filter(F.col(key).isNotNull()).withColumn("_n", F.struct(*order))
    else:
        rows = top_per(df, [key], [F.col(o) for o in order], k, "_n")
    also = also or {}
    packed = rows.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("_n", F.struct(*fields).alias("_s")))).alias("_a"), *[c.alias(n) for n, c in also.items()])
    return packed.select(key, F.transform("_a", lambda x: x["_s"]).alias(name), *also)


def _num(c: Column) -> Column:
    return F.coalesce(F.format_number(c.cast("double"), 2), F.lit("N/A"))


def _lines(arr, cells) -> Column:
    """The rows of a markdown table."""
    return F.array_join(F.transform(arr, lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", *cells(x)), F.lit(" |"))), "\n")


def _comparison_cells(x: Column) -> list[Column]:
    return [x["metric_name"], x["comparison_type"], _num(x["current_value"]), _num(x["previous_value"]),
            F.coalesce(F.concat(_fix(x["percentage_change"] * 100, 2), F.lit("%")), F.lit("N/A"))]


def snippet(body: Column) -> Column:
    """What a memo cites of a chunk."""
    return F.substring(body, 1, 200)


def _heads(comparisons: Column) -> Column:
    """The comparisons that a memo puts into words: the first three, and the first three up and down."""
    three = lambda arr: F.slice(arr, 1, 3)
    return F.struct(
        three(comparisons).alias("all"), three(F.filter(comparisons, lambda x: x["percentage_change"] > 0)).alias("up"),
        three(F.filter(comparisons, lambda x: x["percentage_change"] < 0)).alias("down"))


def _digests(packages: DataFrame) -> DataFrame:
    """Packages with all columns that :func:`drafts` reads; those of :func:`package` have them."""
    first = F.try_element_at("evidence", F.lit(1))
    made = {
        "comparison_heads": lambda: _heads(F.col("comparisons")),
        "signal_values": lambda: _pull("analytics", "value"), "evidence_pages": lambda: _pull("evidence", "page_number"),
        "cited": lambda: F.when(first.isNotNull(), F.struct(
            first["chunk_id"].alias("chunk_id"), first["page_number"].alias("page_number"), first["section"].alias("section"),
            snippet(first["chunk_text"]).alias("snippet")))}
    return packages.withColumns({n: c() for n, c in made.items() if n not in packages.columns})


def package(
    reports: DataFrame, companies: DataFrame, metrics: DataFrame, comparisons: DataFrame, analytics: DataFrame,
    risks: DataFrame, tones: DataFrame, chunks: DataFrame, benchmark: DataFrame,
) -> DataFrame:
    """Everything a memo needs, nested under its report; comparisons are those of the whole company.

    Branch arrays hold every row of a report in key order.  The data model bounds them:
    metrics and risks have one row per name, comparisons and signals a few per metric, and
    tones one per chunk of a file.  Evidence is the set of chunks a memo may cite.  Next to
    the arrays stands what :func:`drafts` reads of the long ones (:func:`_digests`), so that
    a memo neither moves its evidence texts nor goes through all comparisons of its company.
    Chunks may bring their ``snippet``.
    """
    if "snippet" not in chunks.columns:
        chunks = chunks.withColumn("snippet", snippet(F.col("chunk_text")))
    base = reports.join(companies.select("company_id", "name"), "company_id").select(
        "report_id", "company_id", F.col("name").alias("company_name"),
        F.concat_ws(" ", "name", "report_type", F.concat(F.lit("FY"), F.col("year"))).alias("report_title"),
        F.col("year").alias("reporting_year"),
        F.when(F.col("report_type") == "10-K", F.lit("FY")).otherwise(F.lit("Q")).alias("reporting_period"))
    located = risks.join(
        chunks.select(F.col("chunk_id").alias("source_chunk_id"), F.col("start_page").alias("page_number")),
        "source_chunk_id", "left")
    # severity first, so the first rows of a package are its top concerns
    weight = F.array_position(F.array(*[F.lit(s) for s in reversed(vocab.RISK_SEVERITIES)]), F.col("severity"))
    located = located.withColumn("_w", weight)
    branches = [
        _nest(metrics, "report_id", ["metric_name", F.col("value").cast("double").alias("value"), "unit", "metric_category"],
              ["metric_id"], "metrics"),
        _nest(analytics, "report_id", ["signal_type", "metric_name", "signal_code", "value", "explanation"],
              ["signal_code", "metric_name"], "analytics", also={"signal_values": F.collect_list(F.col("value").cast("double"))}),
        _nest(located, "report_id", ["risk_id", "category", "severity", "risk_description", "source_chunk_id", "page_number"],
              ["_w", "risk_id"], "risks"),
        _nest(tones, "report_id", [
            "sentiment", "confidence_level", "hedging_score",
            (F.col("positive_score") - F.col("negative_score")).alias("sentiment_score")], ["seq", "tone_id"], "tones"),
        _nest(chunks, "report_id", ["chunk_id", "chunk_text", F.coalesce("start_page", F.lit(1)).alias("page_number"), "section"],
              ["start_page", "chunk_index"], "evidence", vocab.MEMO_EVIDENCE_CHUNKS, {
                  "evidence_pages": F.collect_list(F.coalesce("start_page", F.lit(1)).cast("double")),
                  "cited": F.min_by(F.struct("chunk_id", F.coalesce("start_page", F.lit(1)).alias("page_number"), "section", "snippet"), "_n")}),
        # last: from here on every report holds the rows of its whole company, and no such row is shuffled
        _nest(comparisons.drop("report_id"), "company_id",
              ["metric_name", "comparison_type", "current_value", "previous_value", "percentage_change"],
              ["metric_id", "comparison_type"], "comparisons").withColumns({  # once a company, not once a report
                  "comparison_lines": _lines("comparisons", _comparison_cells), "comparison_heads": _heads(F.col("comparisons"))}),
    ]
    base = base.join(benchmark.drop("cohort_id").dropDuplicates(["company_id"]).select(
        "company_id", F.struct("overall_score", "financial_score", "risk_score", "tone_score",
                               "capital_allocation_score", "rank").alias("benchmark")), "company_id", "left")
    out = base
    for branch in branches:
        out = out.join(branch, branch.columns[0], "left")
    return out


def _join(arr: Column, item, sep: str = ", ") -> Column:
    return F.array_join(F.transform(arr, item), sep)


def _fix(c: Column, places: int, sign: bool = False) -> Column:
    return money.fixed(c.cast("decimal(30,10)"), places, sign=sign)


def section_texts() -> list[Column]:
    """The eight section texts of a package row with its digests, in memo order."""
    c = F.col
    name, empty = c("company_name"), lambda x: F.coalesce(F.size(x), F.lit(0)) == 0
    some = lambda x: F.coalesce(x, F.array())
    head = lambda x, n: F.slice(some(c(x)), 1, n)
    compared = lambda part: some(c("comparison_heads")[part])
    pct = lambda x, sign: F.coalesce(
        F.concat(_fix(x["percentage_change"], 1, sign), F.lit("%")), F.lit("N/A"))

    overview = F.concat(
        F.lit("This section provides an overview of "), name, F.lit(" based on its "), c("report_title"), F.lit(" for "),
        c("reporting_period"), F.lit(" "), c("reporting_year"), F.lit("."),
        F.when(c("cited").isNull(), F.lit("")).otherwise(F.concat(
            F.lit(" The source report details are extracted from the primary document text (e.g., page "),
            c("cited")["page_number"], F.lit(")."))))
    figures = _join(head("metrics", 5), lambda m: F.concat(
        m["metric_name"], F.lit(" of "), F.coalesce(_fix(m["value"], 2), F.lit("N/A")),
        F.coalesce(F.concat(F.lit(" "), m["unit"]), F.lit(""))))
    changes = _join(compared("all"), lambda x: F.concat(
        x["metric_name"], F.lit(" changed by "), pct(x, True), F.lit(" ("), x["comparison_type"], F.lit(")")))
    financial = F.when(empty("metrics"), F.lit("No financial metrics were extracted for this period.")).otherwise(F.concat(
        F.lit("Financial performance analysis for "), name, F.lit(" indicates the following metrics: "), figures, F.lit("."),
        F.when(F.size(compared("all")) == 0, F.lit("")).otherwise(
            F.concat(F.lit(" Period-over-period comparisons show: "), changes, F.lit(".")))))
    worst = _join(head("risks", 3), lambda r: F.concat(
        r["category"], F.lit(" ("), r["severity"], F.lit(" severity: "), r["risk_description"], F.lit(")")), "; ")
    risk = F.when(empty("risks"), F.lit("No risk factors were identified for this company.")).otherwise(F.concat(
        F.lit("A risk profile assessment for "), name, F.lit(" identified "), F.size("risks"),
        F.lit(" key risk areas. Top concerns include: "), worst, F.lit(".")))
    t = F.try_element_at("tones", F.lit(1))
    management = F.when(empty("tones"), F.lit("No management commentary tone disclosures were analysed.")).otherwise(F.concat(
        F.lit("Management commentary for "), name, F.lit(" is characterized by an overall "), t["sentiment"],
        F.lit(" sentiment and a "), t["confidence_level"], F.lit(" confidence level. The computed sentiment score stands at "),
        _fix(t["sentiment_score"], 2), F.lit(" (where higher is more positive) with a hedging/uncertainty score of "),
        _fix(t["hedging_score"], 2), F.lit(".")))
    b = c("benchmark")
    score = lambda f: F.coalesce(_fix(b[f], 1), F.lit("N/A"))
    position = F.when(b.isNull(), F.lit("Benchmark comparison data was not supplied for this report.")).otherwise(F.concat(
        F.lit("Compared to its peer cohort, "), name, F.lit(" ranked "), F.coalesce(b["rank"].cast("int").cast("string"), F.lit("N/A")),
        F.lit(" overall with a score of "), score("overall_score"),
        F.lit("/100. Relational dimension performance breakdown: Financial performance scored "), score("financial_score"),
        F.lit(", risk metrics scored "), score("risk_score"), F.lit(", management commentary tone scored "), score("tone_score"),
        F.lit(", and capital allocation scored "), score("capital_allocation_score"), F.lit(".")))
    # three are shown at most, so no more are put into words
    three = lambda arr, cond: F.slice(F.filter(some(c(arr)), cond), 1, 3)
    grown = F.transform(
        compared("up"),
        lambda x: F.concat(F.lit("growth in "), x["metric_name"], F.lit(" ("), pct(x, True), F.lit(")")))
    leader = F.when(b["rank"] <= 3, F.array(F.concat(
        F.lit("top-tier ranking ("), b["rank"].cast("int"), F.lit(") within peer benchmarking cohort")))).otherwise(
            F.array().cast("array<string>"))
    ups = F.slice(F.concat(grown, leader), 1, 3)
    bull = F.concat(
        F.lit("The bull case for "), name, F.lit(" is supported by key operational signals: "),
        F.when(F.size(ups) > 0, F.concat(F.lit("Indicators include "), F.array_join(ups, ", "), F.lit("."))).otherwise(
            F.lit("No significant positive growth comparisons were deterministically verified.")))
    severe = F.transform(
        three("risks", lambda r: r["severity"].isin("CRITICAL", "HIGH")),
        lambda r: F.concat(r["category"], F.lit(" risk ("), F.substring(r["risk_description"], 1, 50), F.lit("...)")))
    shrunk = F.transform(
        compared("down"),
        lambda x: F.concat(F.lit("decline in "), x["metric_name"], F.lit(" ("), pct(x, False), F.lit(")")))
    downs = F.slice(F.concat(severe, shrunk), 1, 3)
    bear = F.concat(
        F.lit("The bear case for "), name, F.lit(" is centered on documented vulnerabilities: "),
        F.when(F.size(downs) > 0, F.concat(F.lit("Key vulnerabilities include "), F.array_join(downs, ", "), F.lit("."))).otherwise(
            F.lit("No critical risks or negative comparisons were deterministically highlighted.")))
    questions = F.concat(
        F.lit("1. How does management plan to mitigate the highlighted risk exposures?\n"
              "2. What macro or operational drivers are causing the volatility in key metrics?"),
        F.when(b.isNotNull(), F.concat(
            F.lit("\n3. What strategic changes are required to improve cohort ranking from rank "),
            F.coalesce(b["rank"].cast("int").cast("string"), F.lit("N/A")), F.lit("?"))).otherwise(F.lit("")))
    return [overview, financial, risk, management, position, bull, bear, questions]


def drafts(packages: DataFrame) -> DataFrame:
    """One row per package with all that a memo needs of it: texts, citations, and the numbers of its own report.

    What a package nests of the whole company is left behind, so drafts can be written
    where packages, a company's rows times its reports, are too large.
    """
    c, first = F.col, F.col("cited")
    packages = _digests(packages)
    cite = F.when(first.isNotNull(), F.array(F.struct(
        c("report_id"), first["chunk_id"].alias("chunk_id"), first["page_number"].alias("page_number"),
        F.coalesce(first["section"], F.lit("Overview")).alias("section_name"), F.lit("text_chunk").alias("source_type"),
        first["snippet"].alias("text_snippet"))))
    parts = F.array(*[
        F.struct(F.lit(n).alias("section_order"), F.lit(name).alias("section_name"), body.alias("content"))
        for n, (name, body) in enumerate(zip(vocab.MEMO_SECTIONS, section_texts()), start=1)])
    return packages.select(
        F.col("report_id").alias("memo_id"), "report_id", "company_id",
        F.concat(F.lit("Investment Memo: "), c("company_name"), F.lit(" ("), c("reporting_period"), F.lit(" "),
                 c("reporting_year"), F.lit(")")).alias("title"),
        F.concat(
            F.lit("This structured investment memo compiles relational intelligence for "), c("company_name"),
            F.lit(" based on the "), c("report_title"),
            F.lit(". Key findings highlight financial metrics, risk profiles, management commentary tone, and "
                  "competitive benchmarking performance.")).alias("executive_summary"),
        parts.alias("parts"), cite.alias("citations"), _own_numbers().alias("own_numbers"))


def memo_tables(drafted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memos, sections) of drafts."""
    memos = drafted.select("memo_id", "report_id", "title", "executive_summary")
    return memos, drafted.select("memo_id", F.explode("parts").alias("_p"), "citations").select("memo_id", "_p.*", "citations")


def write_memo(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memos, sections): the deterministic memo of every package."""
    return memo_tables(drafts(packages))


# --- grounding ---------------------------------------------------------------------------------
def numbers_in(body: Column) -> Column:
    """Every number in a text, commas and percent signs removed."""
    return F.transform(
        F.regexp_extract_all(body, F.lit(f"({NUMBER})"), F.lit(1)), lambda n: F.regexp_replace(n, "[,%]", ""))


def _pull(rows, *fields: str) -> Column:
    return F.coalesce(F.flatten(F.transform(rows, lambda x: F.array(*[x[f].cast("double") for f in fields]))), F.array().cast("array<double>"))


def _own_numbers() -> Column:
    """The source numbers of a package with its digests, but for the comparisons of its company."""
    year, b = F.col("reporting_year"), F.col("benchmark")
    own = F.array(*[x.cast("double") for x in (
        year, year - 1, year + 1, year % 100, b["overall_score"], b["financial_score"], b["risk_score"],
        b["tone_score"], b["capital_allocation_score"], b["rank"])])
    given = lambda n: F.coalesce(n, F.array().cast("array<double>"))
    return F.concat(
        own, _pull("metrics", "value"), given("signal_values"), _pull("risks", "page_number"),
        _pull("tones", "sentiment_score", "hedging_score"), given("evidence_pages"))


_COMPARED = ["current_value", "previous_value", "percentage_change"]


def _with_roundings(numbers: DataFrame, key: str) -> DataFrame:
    """(key, value) of ``_v`` and the same rounded to 0, 1 and 2 places, each once."""
    forms = F.array("_v", *[F.bround("_v", places) for places in ROUNDED])
    return numbers.select(key, F.explode(F.array_distinct(forms)).alias("value")).filter("value is not null").distinct()


ROUNDED = (0, 1, 2)  # places to which a memo may round a source number


def allowed_values(packages: DataFrame) -> DataFrame:
    """(memo_id, value): every source number of a package, and the same rounded to 0, 1 and 2 places."""
    everything = F.concat(_own_numbers(), _pull("comparisons", *_COMPARED))
    return _with_roundings(_digests(packages).select(F.col("report_id").alias("memo_id"), F.explode(everything).alias("_v")), "memo_id")


def own_values(drafted: DataFrame) -> DataFrame:
    """(memo_id, value) of drafts: the source numbers of a report as they are, without the comparisons."""
    return drafted.select("memo_id", F.explode(F.array_distinct("own_numbers")).alias("value")).filter("value is not null")


def company_values(comparisons: DataFrame) -> DataFrame:
    """(company_id, value): what the comparisons of a company add to the source numbers of each of its memos."""
    numbers = F.array(*[F.col(c).cast("double") for c in _COMPARED])
    return comparisons.select("company_id", F.explode(F.array_distinct(numbers)).alias("value")).filter("value is not null")


def open_numbers(body: Column) -> Column:
    """Numbers of a text that need a source: counts up to 20, those near 100 and the years 2010..2030 do not."""
    return F.filter(F.transform(numbers_in(body), lambda n: n.try_cast("double")), lambda n: ~(
        (n <= 21) | n.between(98, 102) | n.between(2010, 2030)))


def check_grounding(
    texts: DataFrame, allowed: DataFrame, shared: DataFrame | None = None, *, fail_at: int = vocab.GROUNDING_FAIL_AT,
    places: tuple[int, ...] = (),
) -> DataFrame:
    """Numbers of each memo without a source value nearby: absolute 1 or relative 2 percent.

    ``texts`` is (memo_id, body), ``allowed`` (memo_id, value).  Numbers near a count up to
    20 or near 100, and the years 2010..2030, always pass.  ``shared`` is (company_id, value),
    values that hold for all memos of a company; ``texts`` then have ``company_id`` too, and
    these values are not repeated for each memo.  A value holds as it is and rounded to each
    of ``places``.
    """
    company = [] if shared is None else ["company_id"]
    return _grounding(texts.select("memo_id", *company, open_numbers(F.col("body")).alias("_open")), allowed, shared, fail_at, places)


def _grounding(read: DataFrame, allowed: DataFrame, shared: DataFrame | None, fail_at: int, places: tuple[int, ...]) -> DataFrame:
    """:func:`check_grounding` of the open numbers of texts.

    The band join is an equi-join: source values are put into buckets of one percent of
    their magnitude, texts look into the buckets their band touches, so no number meets all
    values of its memo.  Roundings are tried where a number and a value meet, and the band is
    wider by what they can add, so a value is one row.
    """
    company = [] if shared is None else ["company_id"]
    grouped = read.select("memo_id", *company, F.explode("_open").alias("number")).groupBy("memo_id", *company, "number").agg(
        F.count(F.lit(1)).alias("times"))
    # bucket = floor(log(1 + |v|) * 32): a bucket is about 3 percent wide, wider than either band above 50
    bucket = lambda v: F.floor(F.log(F.abs(v) + 1) * 32).cast("int")
    more = 0.52 if places else 0.0  # what rounding adds to either band
    low = lambda v: F.least(v - 1.0, v / 1.02) - more
    high = lambda v: F.greatest(v + 1.0, v / 0.98) + more
    values = lambda df, key: df.filter(F.col("value").isNotNull()).select(
        key, F.col("value").cast("double").alias("value")).distinct().withColumn("_b", bucket(F.col("value")))
    probe = grouped.withColumn("_b", F.explode(F.sequence(
        bucket(F.greatest(F.lit(0.0), low(F.col("number")))), bucket(high(F.col("number"))))))

    def near(value: Column) -> Column:
        gap = F.abs(value - F.col("number"))
        return (gap <= 1.0) | ((value != 0) & (gap / F.abs(value) <= 0.02))

    holds = near(F.col("value"))
    if places:
        # rounding moves a value by a half at most, so most pairs need not be rounded
        close = F.abs(F.col("value") - F.col("number")) <= F.greatest(F.lit(1.0), F.abs("value") * 0.02) + more
        rounded = near(F.bround("value", places[0]))
        for k in places[1:]:
            rounded = rounded | near(F.bround("value", k))
        holds = holds | (close & rounded)
    hits = probe.join(values(allowed, "memo_id"), ["memo_id", "_b"]).filter(holds).select("memo_id", "number")
    if shared is not None:
        hits = hits.unionByName(probe.join(values(shared, "company_id"), ["company_id", "_b"]).filter(holds).select("memo_id", "number"))
    loose = grouped.join(hits.distinct(), ["memo_id", "number"], "left_anti").groupBy("memo_id").agg(F.sum("times").alias("ungrounded"))
    return read.select("memo_id").distinct().join(loose, "memo_id", "left").select(
        "memo_id", F.coalesce("ungrounded", F.lit(0)).alias("ungrounded"),
        (F.coalesce("ungrounded", F.lit(0)) >= fail_at).alias("failed"))


def validate_memos(texts: DataFrame, allowed: DataFrame, shared: DataFrame | None = None, *, places: tuple[int, ...] = ()) -> DataFrame:
    """Prohibited phrases and grounding of each memo; see :func:`check_grounding`.  A text is read once."""
    company = [] if shared is None else ["company_id"]
    read = cut_lineage(texts.select(
        "memo_id", *company, quality.phrase_flags(F.col("body"), vocab.PROHIBITED_PHRASES).alias("phrases"),
        open_numbers(F.col("body")).alias("_open")))
    grounding = _grounding(read, allowed, shared, vocab.GROUNDING_FAIL_AT, places)
    return read.select("memo_id", "phrases").join(grounding, "memo_id").withColumn(
        "accepted", (F.size("phrases") == 0) & ~F.col("failed"))


# --- citations ------------------------------------------------------------------------------------
def resolve_citations(raw: DataFrame, chunks: DataFrame, risks: DataFrame, *, threshold: float = 0.05) -> DataFrame:
    """Citations matched to sources: chunk id, risk id, metric label, else most similar chunk.

    Only the chunks that a memo's package holds as evidence can be cited, the report's first
    ``MEMO_EVIDENCE_CHUNKS``.  Similarity is word overlap with them, so a citation meets a
    bounded number of chunks, on the words they share.
    """
    chunks = top_per(chunks, ["report_id"], [F.col("start_page"), F.col("chunk_index")], vocab.MEMO_EVIDENCE_CHUNKS, "_place").drop("_place")
    c = chunks.select(
        F.col("chunk_id").alias("c_id"), F.col("report_id").alias("c_report"), F.col("start_page").alias("c_page"),
        F.col("section").alias("c_section"), F.substring("chunk_text", 1, 200).alias("c_text"))
    r = risks.select(
        F.col("risk_id").alias("r_id"), F.col("report_id").alias("r_report"), F.col("source_chunk_id").alias("r_chunk"),
        F.substring("risk_description", 1, 200).alias("r_text"))
    kind = F.lower(F.coalesce("source_type", F.lit("text_chunk")))
    j = raw.withColumn("_kind", kind).join(
        c, (F.col("_kind") == "text_chunk") & (F.col("ref_id") == F.col("c_id")) & (F.col("report_id") == F.col("c_report")), "left"
    ).join(r, (F.col("_kind") == "risk_factor") & (F.col("ref_id") == F.col("r_id")) & (F.col("report_id") == F.col("r_report")), "left")
    direct = F.col("c_id").isNotNull() | F.col("r_id").isNotNull() | (F.col("_kind") == "financial_metric")
    open_ = j.filter(~direct & F.col("text_snippet").isNotNull()).select("citation_id", "report_id", "text_snippet")

    def words(df: DataFrame, key: str, column: str) -> DataFrame:
        return df.select("report_id", key, text.word_set(F.col(column)).alias("_w")).select(
            "report_id", key, F.size("_w").alias(f"_{key}_n"), F.explode("_w").alias("word"))

    left = words(open_, "citation_id", "text_snippet")
    pool = chunks.join(open_.select("report_id").distinct(), "report_id", "left_semi")
    shared = left.join(words(pool, "chunk_id", "chunk_text"), ["report_id", "word"]).groupBy(
        "citation_id", "chunk_id").agg(
            F.count(F.lit(1)).alias("_s"), F.first("_citation_id_n").alias("_a"), F.first("_chunk_id_n").alias("_b"))
    score = F.col("_s") / (F.col("_a") + F.col("_b") - F.col("_s"))
    best = shared.withColumn("_score", score).filter(F.col("_score") > threshold).groupBy("citation_id").agg(
        F.min_by("chunk_id", F.struct(-F.col("_score"), F.col("chunk_id"))).alias("_best"))
    found = best.join(c.select(F.col("c_id").alias("_best"), F.col("c_page").alias("b_page"), F.col("c_section").alias("b_section")), "_best")
    metric = F.col("_kind") == "financial_metric"
    return j.join(found, "citation_id", "left").select(
        "citation_id", "report_id", F.coalesce("c_id", "r_chunk", "_best").alias("chunk_id"),
        F.coalesce("c_page", "b_page", "page_number").alias("page_number"),
        F.coalesce("c_section", "b_section", "section_name",
                   F.when(F.col("r_id").isNotNull(), F.lit("Risk Factors")).when(metric, F.lit("Financials"))).alias("section_name"),
        F.when(F.col("_best").isNotNull(), F.lit("text_chunk")).otherwise(F.col("_kind")).alias("source_type"),
        F.coalesce("text_snippet", "c_text", "r_text",
                   F.when(metric, F.concat(F.lit("Financial Metric: "), F.col("metric_name")))).alias("text_snippet"))


def citation_rates(sections: DataFrame) -> DataFrame:
    """Share of sections with a citation and of citations that resolve to a source."""
    good = F.size(F.filter("citations", lambda x: x["report_id"].isNotNull() & (
        (x["source_type"] != "text_chunk") | x["chunk_id"].isNotNull())))
    n = F.coalesce(F.size("citations"), F.lit(0))
    return sections.groupBy("memo_id").agg(
        F.bround(F.avg((n > 0).cast("int")), 6).alias("coverage"),
        F.bround(F.coalesce(F.try_divide(F.sum(F.coalesce(good, F.lit(0))), F.sum(n)), F.lit(0.0)), 6).alias("grounding_rate"))


# --- evidence tables ---------------------------------------------------------------------------------
def evidence_tables(packages: DataFrame) -> DataFrame:
    """One markdown text per package with a table per branch."""
    def table(title: str, columns: list[str], arr: str, lines: Column, none: str) -> Column:
        head = f"### {title}\n| " + " | ".join(columns) + " |\n|" + " :--- |" * len(columns) + "\n"
        body = F.concat(F.lit(head), lines, F.lit("\n"))
        return F.when(F.coalesce(F.size(arr), F.lit(0)) == 0, F.lit(f"### {title}\n{none}\n")).otherwise(body)

    made = "comparison_lines" in packages.columns
    parts = [
        table("Financial Metrics", ["Metric Name", "Value", "Category"], "metrics", _lines(
            "metrics", lambda m: [m["metric_name"], F.concat_ws(" ", _num(m["value"]), m["unit"]), m["metric_category"]]),
              "No financial metrics found matching the query criteria."),
        table("Period-over-Period Comparisons", ["Metric Name", "Type", "Current Val", "Prev Val", "% Change"], "comparisons",
              F.col("comparison_lines") if made else _lines("comparisons", _comparison_cells), "No comparison records found."),
        table("Risk Factors", ["Category", "Severity", "Description"], "risks", _lines(
            "risks", lambda r: [r["category"], r["severity"], r["risk_description"]]), "No risk factors found."),
        table("Management Tone", ["Sentiment", "Confidence Level", "Hedging Score"], "tones", _lines(
            "tones", lambda t: [t["sentiment"], t["confidence_level"], _fix(t["hedging_score"], 3)]),
              "No management tone records found."),
    ]
    return packages.select("report_id", F.concat_ws("\n\n", *parts).alias("fused_evidence"))
