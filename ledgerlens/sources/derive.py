"""Filing tables derived from the star-schema and text tables.

The registered queries need companies, reports, metrics, chunks and so on.  These
functions build them from whatever Parquet tables a directory holds, so all work grows
with those tables:

* metrics come from ``lineitem`` joined to ``orders``, summed per supplier and quarter as
  exact decimals, with annual totals added from the quarterly sums;
* filings come from ``documents``; since the prose there is invented, each text gets
  fixed finance sentences chosen by ``doc_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.session import cut_lineage

# Parts that the periods of one split of line items (128 MB at most) are dealt to.
PARTS_PER_SPLIT = 8

RISK_SENTENCES = [
    "Our supply chain depends on a single source supplier and any failure to deliver could disrupt production.",
    "A data breach or ransomware event may impact our reputation and could materially harm customers.",
    "New regulatory requirements create uncertainty and may affect compliance cost.",
    "Intense competition and pricing pressure could reduce our market share.",
    "Rising interest rate levels pose a serious risk to our liquidity and debt covenant headroom.",
    "Patent litigation and class action lawsuits are a threat to our intellectual property.",
    "Climate change and natural disaster events may disrupt logistics, a minor exposure so far.",
    "Political instability and new tariff rules could limit international trade; the adverse effect is unlikely to be large.",
    "An economic downturn with high inflation would adversely impact consumer spending and foreign exchange.",
    "Loss of key personnel is a risk to business continuity and could cause a significant disruption.",
    "Substantial doubt about our ability to continue as a going concern is a systemic risk for credit.",
    "Technological change brings a risk of obsolescence for our software.",
    "The team met in the usual place and reviewed the plan.",
]
RISK_THEMES = [
    "Supply chain problems could affect deliveries",
    "Litigation is a risk",
    "A data breach may harm trust",
    "Weak liquidity is a threat",
    "Uncertainty about tariff rules continues",
]
RISK_TAILS = [
    ".", " with a material adverse effect.", " in a minor way.", " and could end in bankruptcy.",
]
TONE_SENTENCES = [
    "We are confident in our ability to deliver strong growth and margin expansion.",
    "We expect continued growth with healthy demand, although results may vary and could be volatile.",
    "Headwinds and cost inflation put pressure on results and revenue decline is possible.",
    "Record performance exceeded expectations and we remain optimistic.",
    "Demand is uncertain, the forecast depends on assumptions and might change.",
    "Operations were stable in the period.",
    "Solid execution and a solid pipeline keep us on track despite softer market conditions.",
    "Impairment charge and weakness in Europe were estimated at approximately the same level.",
    "We believe our proven model gives strong visibility.",
    "Sluggish growth and higher expenses were a negative impact on margin.",
    "Outstanding results with robust demand and a record performance.",
]
METRIC_SENTENCES = [
    "Total revenue was $96.7 billion and net income was $5,123 million in fiscal 2024.",
    "Operating margin expanded to 28.5% while gross profit margin was 43.3 percent.",
    "Free cash flow was $(1,234) million and capital expenditures were €3.1bn.",
    "Total debt at year end was $25,000 million; adjusted EBITDA reached 18.2 billion.",
    "Full-year revenue is expected to be approximately $105 billion.",
    "Net cash provided by operating activities was £12.4 billion.",
    "No figures were given.",
]


def risk_text(i: Column) -> Column:
    """Two sentences: one that changes with every document, one whose theme lasts four."""
    theme = F.concat(pick(RISK_THEMES, F.floor(i / 4)), pick(RISK_TAILS, F.floor(i / 3)))
    return F.concat_ws(" ", pick(RISK_SENTENCES, i), theme)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table, in the splits the scan gives.

    A session may ask for text tables to be dealt out anew by ``spark.ledgerlens.spread``
    (a number of partitions), as the bench does for its files of a single split.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get("spark.ledgerlens.spread", None)
    return df.repartition(int(spread)) if spread and name in ("documents", "pages", "conversations") else df


def pick(words: list[str], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(by, F.lit(len(words))) + 1).cast("int"))


# --- companies, reports and metrics ------------------------------------------------------
def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").cast("string").alias("company_id"), F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("S"), F.col("s_suppkey"))).alias("ticker"),
        F.col("n_name").alias("sector"), F.lit(None).cast("string").alias("industry"),
    )


def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("nation-"), F.col("s_nationkey")).alias("cohort_id"),
        F.col("s_suppkey").cast("string").alias("company_id"))


def quarter_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sums per (company, year, quarter): one join, one aggregation of the line items."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", F.col("l_quantity").cast("decimal(12,2)").alias("q"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("p"),
        F.col("l_discount").cast("decimal(4,2)").alias("d"), F.col("l_tax").cast("decimal(4,2)").alias("t"))
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("fiscal_year"), F.quarter("o_orderdate").alias("fiscal_quarter"))
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy(
        F.col("l_suppkey").cast("string").alias("company_id"), "fiscal_year", "fiscal_quarter"
    ).agg(
        _total(F.col("p") * (1 - F.col("d"))).alias("rev"), _total(F.col("p") * F.col("t")).alias("tax"),
        _total(F.col("p") * F.col("d")).alias("disc"), F.sum("q").cast("bigint").alias("qty"),
    )


def _total(c: Column) -> Column:
    return F.sum(c).cast("decimal(20,4)")


def period_sums(spark: SparkSession, sf_dir: str, quarters: DataFrame | None = None) -> DataFrame:
    """Quarterly sums, and per (company, year) those added up from them, quarter NULL.

    The rows are dealt by company, so what groups by company and more later on (metrics,
    their comparisons, signals) stays where it is.  A company has a row per quarter, so
    none is large.  The number of parts is fixed by the size of the line items: left to
    AQE it would follow the few bytes of the sums, and each becomes up to fourteen metrics
    with their texts.  ``quarters`` are the quarterly sums, if they are written already.
    """
    quarterly = quarter_sums(spark, sf_dir) if quarters is None else quarters
    splits = table(spark, sf_dir, "lineitem").select("l_suppkey").rdd.getNumPartitions()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS_PER_SPLIT * splits)
    both = quarterly.repartition(parts, "company_id").withColumn("fiscal_quarter", F.explode(F.array("fiscal_quarter", F.lit(None))))
    return both.groupBy("company_id", "fiscal_year", "fiscal_quarter").agg(
        *[_total(F.col(c)).alias(c) for c in ("rev", "tax", "disc")], F.sum("qty").alias("qty"))


def report_id(company: Column, year: Column, quarter: Column) -> Column:
    return F.concat_ws("-", company, year, F.coalesce(F.concat(F.lit("Q"), quarter), F.lit("FY")))


def metrics(spark: SparkSession, sf_dir: str, quarters: DataFrame | None = None) -> DataFrame:
    """Long metric table, up to fourteen metrics per report."""
    s = period_sums(spark, sf_dir, quarters)
    rev, tax, disc, qty = (F.col(c) for c in ("rev", "tax", "disc", "qty"))
    x = lambda v: F.lit(v).cast("decimal(4,2)")
    n = lambda mod: F.pmod(qty, F.lit(mod))
    made = {  # name: (category, value, present)
        "REVENUE": ("REVENUE", rev, F.lit(True)),
        "GROSS_PROFIT": ("PROFITABILITY", rev * x("0.60") - tax, n(5) != 0),
        "GROSS_MARGIN": ("MARGINS", n(30) + 5, n(5) == 0),
        "OPERATING_INCOME": ("PROFITABILITY", rev * x("0.30") - disc, n(7) != 0),
        "OPERATING_MARGIN": ("MARGINS", n(25) + 1, n(3) == 0),
        "EBITDA": ("PROFITABILITY", rev * x("0.35") - disc, F.lit(True)),
        "NET_INCOME": ("PROFITABILITY", rev * x("0.05") - tax * x("1.20"), F.lit(True)),
        "TOTAL_DEBT": ("DEBT", tax * 10, F.lit(True)),
        "OPERATING_CASH_FLOW": ("CASH_FLOW", rev * x("0.25") - disc * 2, F.lit(True)),
        "FREE_CASH_FLOW": ("CASH_FLOW", rev * x("0.10") - disc * 2, F.lit(True)),
        "CAPEX": ("CAPEX", disc, n(11) != 0),
        "REVENUE_GUIDANCE": ("GUIDANCE", rev * x("1.05") - disc, n(2) == 0),
        "MARGIN_GUIDANCE": ("GUIDANCE", n(40) + 5, n(4) == 0),
        "DIVIDENDS": ("OTHER", tax * x("0.10"), n(6) == 0),
    }
    cells = F.array(*[
        F.when(there, F.struct(
            F.lit(name).alias("name"), F.lit(cat).alias("cat"), value.cast("decimal(22,6)").alias("value")))
        for name, (cat, value, there) in made.items()
    ])
    rid = report_id(F.col("company_id"), F.col("fiscal_year"), F.col("fiscal_quarter"))
    long = s.withColumn("report_id", rid).withColumn("_m", F.explode(F.array_compact(cells)))
    name = F.col("_m.name")
    percent = name.isin("GROSS_MARGIN", "OPERATING_MARGIN", "MARGIN_GUIDANCE")
    return long.select(
        F.concat_ws("|", "report_id", name).alias("metric_id"), "report_id", "company_id",
        F.initcap(F.replace(name, F.lit("_"), F.lit(" "))).alias("metric_name"),
        name.alias("normalized_metric_name"), F.col("_m.cat").alias("metric_category"),
        F.col("_m.value").alias("value"),
        F.when(~percent, F.lit("USD")).alias("currency"),
        F.when(percent, F.lit("PERCENT")).otherwise(F.lit("ABSOLUTE")).alias("unit"),
        "fiscal_year", "fiscal_quarter",
        (F.lit(60) + F.pmod(qty + F.length(name), F.lit(40))).cast("decimal(5,0)").alias("_c"),
        F.when(F.pmod(qty, F.lit(4)) == 0, F.lit("HYBRID_VALIDATED")).otherwise(F.lit("RULE_BASED")).alias("extraction_method"),
    ).withColumn("confidence_score", (F.col("_c") / 100).cast("decimal(4,3)")).drop("_c")


def candidate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidates for every third metric, so choosing between them is exercised."""
    m = metrics(spark, sf_dir)
    again = F.pmod(F.length("metric_id") + F.col("fiscal_year"), F.lit(3)) == 0
    copies = F.when(again, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    out = m.withColumn("_v", F.explode(copies))
    second = F.col("_v") == "b"
    return out.withColumn("metric_id", F.concat_ws("#", "metric_id", "_v")).withColumn(
        "value", F.when(second, F.col("value") + 1).otherwise(F.col("value")).cast("decimal(22,6)")
    ).withColumn(
        "confidence_score", F.when(
            second & (F.pmod(F.length("normalized_metric_name"), F.lit(2)) == 0), F.col("confidence_score") + F.lit(0.01).cast("decimal(4,3)")
        ).otherwise(F.col("confidence_score")).cast("decimal(4,3)")
    ).drop("_v")


def reports(spark: SparkSession, sf_dir: str, quarters: DataFrame | None = None) -> DataFrame:
    """One report per company and period that has line items; annual ones are 10-K."""
    s = period_sums(spark, sf_dir, quarters)
    qty = F.col("qty")
    statuses = ["UPLOADED", "CHUNKED", "EMBEDDED", "FAILED", "METRICS_READY", "RISKS", "READY"]
    stages = [None, *vocab.STAGES]
    stage = F.element_at(
        F.array(*[F.lit(x) for x in stages]), (F.pmod(qty, F.lit(len(stages))) + 1).cast("int"))
    return s.select(
        report_id(F.col("company_id"), F.col("fiscal_year"), F.col("fiscal_quarter")).alias("report_id"),
        "company_id",
        F.when(F.col("fiscal_quarter").isNull(), F.lit("10-K")).otherwise(F.lit("10-Q")).alias("report_type"),
        F.col("fiscal_year").alias("year"), F.col("fiscal_quarter").alias("quarter"),
        F.pmod(qty, F.lit(120)).cast("int").alias("total_pages"),
        pick(statuses, qty).alias("status"), stage.alias("completed_stage"),
        F.timestamp_seconds(F.lit(946684800) + qty * 3600).alias("uploaded_at"),
    )


# --- filings from documents ---------------------------------------------------------------
def filing_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is one report; sixteen consecutive documents are one company."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    k = F.pmod(i, F.lit(4))
    return d.select(
        i.cast("string").alias("report_id"), F.floor(i / 16).cast("string").alias("company_id"),
        F.when(k == 3, F.lit("10-K")).when(k == 2, F.lit("TRANSCRIPT")).otherwise(F.lit("10-Q")).alias("report_type"),
        (F.lit(2018) + F.floor(F.pmod(i, F.lit(16)) / 4)).cast("int").alias("year"),
        F.when(k != 3, k + 1).cast("int").alias("quarter"), F.col("source").alias("company"), "source",
    )


def filing_pages(spark: SparkSession, sf_dir: str, lines_per_page: int = 40) -> DataFrame:
    """Document text with headings of its report type, cut into pages of forty lines."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    k = F.pmod(i, F.lit(4))
    risk, tone, fin = risk_text(i), pick(TONE_SENTENCES, i), pick(METRIC_SENTENCES, i)
    annual = F.concat_ws(
        "\n", F.lit("PART I"), F.lit("Risk Factors ........ 12"), F.lit("Item 1. Business"), F.col("text"),
        F.lit("Item 1A. Risk Factors"), risk, F.lit("Item 7. Management Discussion"), tone, fin)
    quarterly = F.concat_ws(
        "\n", F.lit("PART I"), F.lit("Item 2. Discussion"), tone, F.col("text"), F.lit("PART II"),
        F.lit("Item 1A. Risk Factors"), risk, F.lit("FINANCIAL OUTLOOK"), fin)
    call = F.concat_ws(
        "\n", F.lit("Prepared Remarks"), tone, F.col("text"), F.lit("Question-and-Answer Session"), risk, fin)
    body = F.when(k == 3, annual).when(k == 2, call).otherwise(quarterly)
    lines = d.select(i.cast("string").alias("report_id"), F.split(body, "\n").alias("_l"))
    pages = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / lines_per_page).cast("int")),
        lambda p: F.array_join(F.slice("_l", p * lines_per_page + 1, lines_per_page), "\n"))
    return lines.select("report_id", F.posexplode(pages).alias("_p", "page_text")).select(
        "report_id", (F.col("_p") + 1).alias("page_number"), "page_text")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document: its text followed by a risk, a tone and a metric sentence."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    names = vocab.SECTIONS
    c = d.select(
        i.cast("string").alias("report_id"), i.cast("string").alias("chunk_id"), F.lit(0).alias("chunk_index"),
        pick(names, F.floor(i / 3)).alias("section"), "source",
        F.concat_ws(" ", F.col("text"), risk_text(i), pick(TONE_SENTENCES, i),
                    pick(METRIC_SENTENCES, i)).alias("chunk_text"), "doc_id")
    return c.select(
        "*", F.floor(i / 16).cast("string").alias("company_id"),
        (F.lit(2018) + F.floor(F.pmod(i, F.lit(16)) / 4)).cast("int").alias("fiscal_year"),
        F.when(F.pmod(i, F.lit(4)) != 3, F.pmod(i, F.lit(4)) + 1).cast("int").alias("fiscal_quarter"),
    )


def report_places(filed: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What deals rows to the companies that have reports, and to each one's reports from the newest.

    The rows are document chunks, or were made of them and still have their document as
    ``report_id``; sentences and scores can so be found where the texts lie, and no text is
    shuffled for it.  Every document finds a report, whatever the numbers of both.  A company
    has at most one report per period, so numbering them is bounded.
    """
    from ledgerlens.functions.grouped import number_rows

    numbered = number_rows(
        filed, ["company_id"],
        [F.col("year").desc(), F.col("quarter").desc_nulls_first()], "_n", bounded=True,
    ).select("company_id", "report_id", "_n")
    held = filed.groupBy("company_id").agg(F.count(F.lit(1)).alias("_reports"))
    holders = number_rows(held, [], [F.col("company_id").cast("bigint")], "_c")
    n, i = held.agg(F.count(F.lit(1))).scalar(), F.col("report_id").cast("bigint")

    def deal(rows: DataFrame) -> DataFrame:
        turns = rows.withColumns({"_c": F.pmod(i, n) + 1, "_turn": F.floor(i / n)}).drop("company_id", "report_id")
        placed = turns.join(holders, "_c").withColumn("_n", F.col("_turn") % F.col("_reports") + 1)
        return placed.join(numbered, ["company_id", "_n"]).drop("_n", "_c", "_turn", "_reports")

    return deal


def company_chunks(spark: SparkSession, sf_dir: str, filed: DataFrame | None = None) -> DataFrame:
    """Document chunks dealt by :func:`report_places`; ``filed`` are the reports, if they are written already."""
    filed = cut_lineage(reports(spark, sf_dir)) if filed is None else filed
    return report_places(filed)(document_chunks(spark, sf_dir))


# --- vectors --------------------------------------------------------------------------------
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows as chunks with a section and period to filter on."""
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    return e.select(
        "vec_id", "embedding", pick(vocab.SECTIONS, F.col("label")).alias("section"), "label",
        F.concat(F.lit("r"), F.floor(i / 20)).alias("report_id"),
        (F.lit(2020) + F.pmod(F.floor(i / 20), F.lit(5))).cast("int").alias("year"),
    )
