"""Sources: file acceptance, pages, taxonomies, gold sets, companies, external candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schemas, vocab
from ledgerlens.functions import money, text
from ledgerlens.functions.grouped import first_per
from ledgerlens.operators import risks


# --- files and pages -------------------------------------------------------------------
def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of raw files; only the first bytes of the content are kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.lit(None).cast("string").alias("content_type"), "length",
        F.substring("content", 1, len(vocab.PDF_MAGIC)).cast("string").alias("head"))


def rejection(meta_prefix: str = "") -> Column:
    """First rule a file breaks, or NULL when it is accepted."""
    c = lambda n: F.col(meta_prefix + n)
    ext = F.lower(F.regexp_extract(c("filename"), r"[^/.](\.[^./]+)$", 1))
    return (
        F.when(F.coalesce(c("filename"), F.lit("")) == "", F.lit("missing_filename"))
        .when(~ext.isin(vocab.FILE_EXTENSIONS), F.lit("unsupported_extension"))
        .when(~F.lower(c("content_type")).isin(vocab.CONTENT_TYPES), F.lit("unsupported_content_type"))
        .when(c("length") <= 0, F.lit("empty_file"))
        .when(c("length") > vocab.MAX_FILE_BYTES, F.lit("file_too_large"))
        .when(~F.coalesce(c("head").startswith(vocab.PDF_MAGIC), F.lit(False)), F.lit("not_a_pdf"))
    )


def accept_files(meta: DataFrame) -> DataFrame:
    return meta.withColumn("reason", rejection()).withColumn("accepted", F.col("reason").isNull())


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages with a declared schema; missing text becomes empty text."""
    pages = spark.read.schema(schemas.TABLES["pages"]).parquet(path)
    return pages.withColumn("page_text", F.coalesce("page_text", F.lit("")))


# --- dimensions --------------------------------------------------------------------------
def metric_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Alias rows of a taxonomy file: metric, category, value kind, alias; first definition wins."""
    schema = (
        "metrics array<struct<canonical:string,category:string,value_kind:string,"
        "aliases:array<string>,expected_sections:array<string>>>"
    )
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    rows = raw.select(F.posexplode("metrics").alias("ord", "m")).select(
        "ord", "m.*", F.posexplode("m.aliases").alias("alias_ord", "alias"))
    named = rows.withColumn("alias", F.lower(F.trim("alias")))
    return first_per(named.select(
        "alias", "canonical", "category", "value_kind", "expected_sections", "ord", "alias_ord"),
        ["alias"], [F.col("ord"), F.col("alias_ord")]).drop("ord", "alias_ord")


def section_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """alias -> section rows of a section taxonomy file."""
    raw = spark.read.schema("aliases map<string,string>").option("multiLine", "true").json(path)
    return raw.select(F.explode("aliases").alias("alias", "section")).withColumn("alias", F.lower(F.trim("alias")))


def risk_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """keyword -> category rows of a risk taxonomy file; unknown categories are left out."""
    schema = "categories map<string,struct<display_name:string,description:string,keywords:array<string>>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    rows = raw.select(F.explode("categories").alias("category", "d")).filter(
        F.col("category").isin(vocab.RISK_CATEGORIES))
    return rows.select("category", F.coalesce("d.display_name", "category").alias("display_name"),
                       F.posexplode_outer("d.keywords").alias("ord", "keyword"))


def gold_examples(spark: SparkSession, path: str, item: str, root: str = "examples") -> DataFrame:
    """Rows of a gold file: one per example, shaped by the struct ``item``."""
    raw = spark.read.schema(f"{root} array<struct<{item}>>").option("multiLine", "true").json(path)
    return raw.select(F.explode(root).alias("e")).select("e.*")


# --- companies ------------------------------------------------------------------------------
def upsert_companies(dim: DataFrame, incoming: DataFrame) -> DataFrame:
    """Company rows to add: one per new ticker (or name where no ticker is given).

    The name falls back to the file's stem, then to a fixed label.
    """
    stem = F.regexp_extract("filename", r"([^/]+?)(?:\.[^./]*)?$", 1)
    named = incoming.select(
        F.coalesce(text.non_blank(F.col("name")), text.non_blank(stem), F.lit("Unknown Company")).alias("name"),
        F.upper(text.non_blank(F.col("ticker"))).alias("ticker"), "sector")
    key = F.coalesce(F.concat(F.lit("t:"), "ticker"), F.concat(F.lit("n:"), F.col("name")))
    fresh = named.withColumn("_k", key).groupBy("_k").agg(
        F.min_by(F.struct("name", "ticker", "sector"), F.struct("name", "sector")).alias("r"))
    known = dim.select(F.coalesce(F.concat(F.lit("t:"), F.upper("ticker")), F.concat(F.lit("n:"), F.col("name"))).alias("_k"))
    return fresh.join(known, "_k", "left_anti").select(F.sha2("_k", 256).alias("company_id"), "r.*")


# --- external candidates -----------------------------------------------------------------------
def _parsed(raw: DataFrame, item: str, *, single: bool = False) -> DataFrame:
    """Items of a JSON text per chunk; text that is not valid JSON of that shape is dropped."""
    shape = f"struct<{item}>" if single else f"array<struct<{item}>>"
    # a whole-document mode: any malformed part makes the value NULL
    wrapped = F.from_json(F.concat(F.lit('{"v":'), "response", F.lit("}")), f"v {shape}", {"mode": "PERMISSIVE"})
    parsed = raw.withColumn("_v", wrapped["v"]).filter("_v is not null")
    one = F.col("_v") if single else F.explode("_v")
    return parsed.select(*[c for c in raw.columns if c != "response"], one.alias("_i"))


def _unit_interval(c: Column, default: float) -> Column:
    number = c.try_cast("double")
    return F.coalesce(F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))), F.lit(default))


def metric_candidates(raw: DataFrame) -> DataFrame:
    """Candidate metrics from ``response`` JSON arrays per chunk.

    Names resolve through the aliases, unit words scale the value, a stated period wins
    over the chunk's, confidence is kept within 0..1.
    """
    i = F.col("_i")
    items = _parsed(raw, schemas.TABLES["metric_candidates"].replace(" ", ":").replace(",:", ","))
    name = F.trim(i["metric_name"])
    exact = {m: m for m in vocab.METRICS}
    alias = {a: m for m, spec in vocab.METRICS.items() for a in spec[2]}
    canonical = F.coalesce(money.mapping(exact)[name], money.mapping(alias)[F.lower(text.squeeze(name))])
    kind = money.mapping({m: s[1] for m, s in vocab.METRICS.items()})
    known = items.withColumn("metric", canonical).filter("metric is not null").withColumn(
        "_number", i["value"].try_cast("decimal(22,6)")).filter("_number is not null")
    word = F.regexp_replace(F.lower(F.trim(F.coalesce(i["unit"], F.lit("")))), r"\.+$", "")
    percent = (kind[F.col("metric")] == "percent") | word.isin(vocab.PERCENT_WORDS)
    label = F.when(~percent, money.mapping(vocab.CANDIDATE_SCALES)[word])
    currency = F.when(kind[F.col("metric")] != "percent", money.currency_code(i["currency"]))
    unit = F.when(percent, F.lit("PERCENT")).otherwise(F.coalesce(label, F.lit("ABSOLUTE")))
    sections = {f"{m}|{s}": "y" for m, spec in vocab.METRICS.items() for s in spec[3]}
    return known.select(
        "company_id", "report_id", "chunk_id", "chunk_index",
        F.coalesce(money.parse_year(i["period"]), "fiscal_year").alias("fiscal_year"),
        F.coalesce(money.parse_quarter(i["period"]), "fiscal_quarter").alias("fiscal_quarter"),
        F.col("metric").alias("normalized_metric_name"), name.alias("metric_name"),
        money.mapping({m: s[0] for m, s in vocab.METRICS.items()})[F.col("metric")].alias("metric_category"),
        F.lit(0).alias("pos"), (F.col("_number") * money.scale_factor(label)).cast("decimal(28,6)").alias("value"),
        currency.alias("currency"), unit.alias("unit"),
        text.strip(F.substring("chunk_text", 1, 300)).alias("source_text"),
        (currency.isNotNull() | (unit != "ABSOLUTE")).alias("marked"),
        money.mapping(sections)[F.concat("metric", F.lit("|"), F.coalesce("section", F.lit("")))].isNotNull().alias("section_match"),
        _unit_interval(i["confidence"], 0.7).alias("raw_confidence"),
    )


def risk_candidates(raw: DataFrame) -> DataFrame:
    """Candidate risks from ``response`` JSON arrays per chunk; best per (report, name)."""
    i = F.col("_i")
    items = _parsed(raw, schemas.TABLES["risk_candidates"].replace(" ", ":").replace(",:", ","))
    rows = items.filter(~text.is_blank(i["risk_name"])).select(
        "report_id", "chunk_id", text.strip(i["risk_name"]).alias("risk_name"),
        risks.normalize_name(i["risk_name"]).alias("normalized_risk_name"),
        text.squeeze(F.coalesce(i["risk_description"], F.lit(""))).alias("risk_description"),
        i["category"].alias("_c"), risks.normalize_severity(F.coalesce(i["severity"], F.lit("MEDIUM"))).alias("severity"),
        _unit_interval(i["confidence"], 0.7).alias("raw_confidence"),
        risks.section_matches(F.col("section")).alias("section_match"),
    )
    full = rows.withColumn("category", risks.normalize_category(F.col("_c"), F.col("risk_description"))).drop("_c")
    return first_per(full, ["report_id", "normalized_risk_name"], [-F.col("raw_confidence"), F.col("chunk_id"), F.col("risk_name")])


def tone_candidates(raw: DataFrame) -> DataFrame:
    """Candidate tone from a ``response`` JSON object per chunk; unknown labels take defaults."""
    i = F.col("_i")
    items = _parsed(raw, schemas.TABLES["tone_candidates"].replace(" ", ":").replace(",:", ","), single=True)
    mood, level = F.upper(F.trim(i["sentiment"])), F.upper(F.trim(i["confidence_level"]))
    return items.select(
        "report_id", F.col("chunk_id").alias("source_chunk_id"),
        F.coalesce("section", F.lit(vocab.DEFAULT_TONE_SOURCE)).alias("source_type"),
        F.when(mood.isin(vocab.SENTIMENTS), mood).otherwise(F.lit("NEUTRAL")).alias("sentiment"),
        F.when(level.isin(vocab.CONFIDENCE_LEVELS), level).otherwise(F.lit("CONFIDENT")).alias("confidence_level"),
        _unit_interval(i["hedging_strength"], 0.0).alias("hedging_score"),
        _unit_interval(i["positive_strength"], 0.0).alias("positive_score"),
        _unit_interval(i["negative_strength"], 0.0).alias("negative_score"),
        _unit_interval(i["confidence"], 0.8).alias("confidence_score"),
    )
