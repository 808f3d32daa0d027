"""Risk extraction from text and risk evolution between consecutive reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
import pandas as pd

from ledgerlens import vocab
from ledgerlens.functions import money, text
from ledgerlens.functions.grouped import first_per, number_rows, top_per
from ledgerlens.operators import dictionaries
from ledgerlens.operators.periods import prior_report


# --- expressions -------------------------------------------------------------------
def has_trigger(c: Column) -> Column:
    return text.matches_any(c, vocab.RISK_TRIGGERS)


def keyword_hits(lowered: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """Per category with a keyword in the text: (place, category, keyword).

    ``keyword`` is the category's first keyword in definition order, ``place`` the rank of
    its longest one (longest first, definition order on ties).  The vocabulary is one
    literal array, so the expression stays small.
    """
    taxonomy = keywords or vocab.RISK_KEYWORDS
    flat = [(w.lower(), w, cat) for cat, words in taxonomy.items() for w in words]
    order = sorted(range(len(flat)), key=lambda i: -len(flat[i][0]))
    rows = [(place, i, *flat[i]) for place, i in enumerate(order)]
    known = text.dictionary(
        rows, "place int, defined int, lower string, keyword string, category string")
    found = text.let(lowered, lambda low: F.filter(known, lambda k: low.contains(k["lower"])))
    firsts = F.aggregate(
        found, F.expr("cast(array() as array<struct<place:int,category:string,keyword:string,defined:int>>)"),
        lambda acc, k: F.when(
            F.exists(acc, lambda a: a["category"] == k["category"]),
            F.transform(acc, lambda a: F.when(
                (a["category"] == k["category"]) & (k["defined"] < a["defined"]),
                F.struct(a["place"].alias("place"), a["category"].alias("category"),
                         k["keyword"].alias("keyword"), k["defined"].alias("defined")),
            ).otherwise(a)),
        ).otherwise(F.array_append(acc, F.struct(
            k["place"].alias("place"), k["category"].alias("category"),
            k["keyword"].alias("keyword"), k["defined"].alias("defined")))),
    )
    return firsts


def classify_category(c: Column) -> Column:
    """Category of the longest keyword found, or NULL."""
    flat = [(w.lower(), cat) for cat, words in vocab.RISK_KEYWORDS.items() for w in words]
    rows = sorted(flat, key=lambda wc: -len(wc[0]))
    known = text.dictionary(rows, "lower string, category string")
    found = text.let(F.lower(c), lambda low: F.filter(known, lambda k: low.contains(k["lower"])))
    return F.try_element_at(found, F.lit(1))["category"]


def severity(c: Column) -> Column:
    """First level from CRITICAL down to LOW with a keyword in the text, else MEDIUM."""
    def level(low: Column) -> Column:
        out = None
        for name, words in vocab.SEVERITY_KEYWORDS.items():
            hit = low.contains(words[0])
            for w in words[1:]:
                hit = hit | low.contains(w)
            out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
        return out.otherwise(F.lit("MEDIUM"))

    return text.let(F.lower(c), level)


def severity_evidence(c: Column) -> Column:
    """The keyword that decided :func:`severity`, or NULL."""
    lowered = F.lower(c)
    return F.coalesce(*[
        F.when(lowered.contains(w), F.lit(w))
        for words in vocab.SEVERITY_KEYWORDS.values() for w in words
    ])


def normalize_name(c: Column) -> Column:
    """Known alias, else UPPER_SNAKE_CASE cut to 128 characters."""
    cleaned = F.translate(F.upper(text.strip(c)), "-/.,'", "_____")
    snake = F.substring(F.regexp_replace(text.strip(cleaned), f"{text.WS}+", "_"), 1, 128)
    return F.coalesce(money.mapping(vocab.RISK_NAME_ALIASES)[F.lower(text.strip(c))], snake)


def normalize_category(category: Column, description: Column) -> Column:
    upper = F.upper(category)
    return F.coalesce(
        F.when(upper.isin(vocab.RISK_CATEGORIES), upper), classify_category(description),
        F.lit("OTHER"),
    )


def normalize_severity(c: Column) -> Column:
    upper = F.upper(text.strip(c))
    return F.when(upper.isin(vocab.RISK_SEVERITIES), upper).otherwise(F.lit("MEDIUM"))


def section_matches(section: Column) -> Column:
    return F.coalesce(F.upper(section).isin(vocab.RISK_SECTION_MATCH), F.lit(False))


def risk_confidence(
    method: Column, section_match: Column, external: Column | None = None,
    disagreement: Column | None = None,
) -> Column:
    """0.95(+.03) agreed, 0.80(+.05) rule, 0.60+.15c or 0.70 (+.05) external, 0.45 disputed."""
    add = lambda x: F.when(section_match, F.lit(x)).otherwise(F.lit(0.0))
    ext = F.lit(0.70)
    if external is not None:
        bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), external))
        ext = F.when(external.isNotNull(), F.lit(0.60) + F.lit(0.15) * bounded).otherwise(ext)
    score = (
        F.when(method == "HYBRID_VALIDATED", F.lit(0.95) + add(0.03))
        .when(method == "RULE_BASED", F.lit(0.80) + add(0.05))
        .when(method == "LLM_BASED", ext + add(0.05))
        .otherwise(F.lit(0.50))
    )
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)
    return score if disagreement is None else F.when(disagreement, F.lit(0.45)).otherwise(score)


# --- extraction -----------------------------------------------------------------------
def risk_sentences(chunks: DataFrame) -> DataFrame:
    """Sentences with a risk trigger.  A chunk has a trigger when one of its sentences has.

    Plain substring tests on the trigger stems come first, for the chunk and for each
    sentence, so the patterns run on few sentences only.
    """
    stems = lambda c: text.contains_any(F.lower(c), vocab.RISK_TRIGGER_STEMS)
    return (
        chunks.filter(stems(F.col("chunk_text")))
        .select(
            "company_id", "report_id", "chunk_id", "chunk_index",
            section_matches(F.col("section")).alias("section_match"),
            F.posexplode(text.sentences(F.col("chunk_text"), blanks_only=True)).alias("pos", "sentence"),
        )
        .filter(stems(F.col("sentence")))
        .filter(has_trigger(F.col("sentence")))
    )


def _sentence_keywords(sentences: DataFrame, taxonomy: DataFrame | None) -> DataFrame:
    """Each sentence with one ``_h`` (place, category, keyword) per category found in it."""
    if taxonomy is None:
        return sentences.withColumn("_h", F.explode(keyword_hits(F.lower("sentence"))))
    keyed = sentences.withColumn("_key", F.concat_ws("\x01", "report_id", "chunk_id", "pos")).withColumn("_low", F.lower("sentence"))
    hits = dictionaries.keyword_categories(keyed, "_key", "_low", taxonomy)
    return keyed.join(hits.select("_key", F.struct("place", "category", "keyword").alias("_h")), "_key")


def risk_candidates(chunks: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """Sentence x category candidates, before the best one per name is kept.

    With a ``taxonomy``, a table like :func:`dictionaries.risk_terms` of any size, its keywords
    are found by joins; chunk_id must then be unique in its report.
    """
    name = F.concat(F.initcap(F.col("_h.keyword")), F.lit(" Risk"))
    found = _sentence_keywords(risk_sentences(chunks), taxonomy)
    described = found.select(
        "company_id", "report_id", "chunk_id", "chunk_index", "pos", "section_match",
        F.col("_h.place").alias("place"), F.col("_h.category").alias("category"),
        F.col("_h.keyword").alias("matched_keyword"), name.alias("risk_name"),
        text.squeeze(F.col("sentence")).alias("risk_description"),
        F.col("sentence").alias("source_text"),
    )
    return described.withColumn("normalized_risk_name", normalize_name(F.col("risk_name"))).withColumn(
        "severity", severity(F.col("risk_description"))
    ).withColumn(
        "raw_confidence", F.when(F.col("section_match"), F.lit(0.80)).otherwise(F.lit(0.75))
    )


def extract_risks(
    chunks: DataFrame, taxonomy: DataFrame | None = None, *, place: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Best candidate per (report, normalized name), scored.

    Highest confidence wins; on a tie the first in (chunk, sentence, keyword) order.
    ``place`` gives the candidates the company and report that their chunks do not have yet.
    """
    candidates = risk_candidates(chunks, taxonomy)
    best = first_per(
        candidates if place is None else place(candidates), ["company_id", "report_id", "normalized_risk_name"],
        [-F.col("raw_confidence"), F.col("chunk_index"), F.col("chunk_id"), F.col("pos"), F.col("place")],
    )
    return best.select(
        F.concat_ws("|", "report_id", "normalized_risk_name").alias("risk_id"),
        "company_id", "report_id", F.col("chunk_id").alias("source_chunk_id"), "risk_name",
        "normalized_risk_name", "risk_description", "category", "severity",
        risk_confidence(F.lit("RULE_BASED"), F.col("section_match")).alias("confidence_score"),
        "section_match",
    )


# --- evolution ---------------------------------------------------------------------------
def _sides(risks: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current risks with their prior report, and the same risks seen as previous ones."""
    steps = prior_report(reports).filter("prior_report_id is not null").select(
        "report_id", "prior_report_id"
    )
    current = risks.join(steps, "report_id")
    previous = risks.join(
        steps.select(F.col("prior_report_id").alias("_p"), F.col("report_id").alias("for_report")),
        F.col("report_id") == F.col("_p"),
    ).drop("_p", "report_id").withColumnRenamed("for_report", "report_id")
    return current, previous


def match_exact(current: DataFrame, previous: DataFrame, *, unique_names: bool = False) -> DataFrame:
    """The nth current risk of a name pairs with the nth previous one of that name.

    Extraction leaves one risk per (report, name); ``unique_names`` says so and saves the
    numbering.
    """
    keys = ["report_id", "normalized_risk_name"]
    if unique_names:
        return current.select(*keys, F.col("risk_id").alias("current_risk_id")).join(
            previous.select(*keys, F.col("risk_id").alias("previous_risk_id")), keys
        ).select("report_id", "current_risk_id", "previous_risk_id")
    c = number_rows(current, keys, [F.col("risk_id")], "_n").select(
        *keys, "_n", F.col("risk_id").alias("current_risk_id"))
    p = number_rows(previous, keys, [F.col("risk_id")], "_n").select(
        *keys, "_n", F.col("risk_id").alias("previous_risk_id"))
    return c.join(p, [*keys, "_n"]).select("report_id", "current_risk_id", "previous_risk_id")


_PICK = "report_id string, category string, current_risk_id string, previous_risk_id string, match_score double"


def _claim(pairs: pd.DataFrame) -> pd.DataFrame:
    """One report and category: in current order, each takes its best free previous risk."""
    pairs = pairs.sort_values(
        ["current_risk_id", "match_score", "previous_risk_id"], ascending=[True, False, True]
    )
    taken: set[str] = set()
    done: set[str] = set()
    keep = []
    for row, c, p in zip(pairs.index, pairs["current_risk_id"], pairs["previous_risk_id"]):
        if c not in done and p not in taken:
            done.add(c)
            taken.add(p)
            keep.append(row)
    return pairs.loc[keep]


def fuzzy_pairs(
    current: DataFrame, previous: DataFrame, *, threshold: float = vocab.RISK_FUZZY_THRESHOLD
) -> DataFrame:
    """Pairs of one report and category whose names share enough words.

    Only pairs that share a word are formed: both sides explode their name tokens and
    meet on (report, category, token), so no group is paired with itself in full.
    """
    def tokens(df: DataFrame, as_id: str) -> DataFrame:
        return df.select(
            "report_id", "category", F.col("risk_id").alias(as_id),
            text.name_tokens(F.col("risk_name"), vocab.RISK_STOP_WORDS).alias("_t"),
        ).filter(F.size("_t") > 0).select("*", F.size("_t").alias("_s"), F.explode("_t").alias("token"))

    c = tokens(current, "current_risk_id").withColumnRenamed("_s", "_cs").drop("_t")
    p = tokens(previous, "previous_risk_id").withColumnRenamed("_s", "_ps").drop("_t")
    shared = c.join(p, ["report_id", "category", "token"]).groupBy(
        "report_id", "category", "current_risk_id", "previous_risk_id"
    ).agg(F.count(F.lit(1)).alias("_n"), F.first("_cs").alias("_cs"), F.first("_ps").alias("_ps"))
    score = F.col("_n") / (F.col("_cs") + F.col("_ps") - F.col("_n"))
    return shared.select(
        "report_id", "category", "current_risk_id", "previous_risk_id", score.alias("match_score")
    ).filter(F.col("match_score") >= threshold)


def match_fuzzy(
    current: DataFrame, previous: DataFrame, *, threshold: float = vocab.RISK_FUZZY_THRESHOLD
) -> DataFrame:
    """Greedy one-to-one choice among :func:`fuzzy_pairs`, independent per (report, category).

    Names are unique per report and built from the closed keyword list, which bounds the
    pairs of one (report, category).
    """
    picked = fuzzy_pairs(current, previous, threshold=threshold).groupBy(
        "report_id", "category"
    ).applyInPandas(_claim, _PICK)
    return picked.select(
        "report_id", "current_risk_id", "previous_risk_id", F.bround("match_score", 3).alias("match_score")
    )


def match_risks(
    risks: DataFrame, reports: DataFrame, *, fuzzy_threshold: float = vocab.RISK_FUZZY_THRESHOLD,
    unique_names: bool = False,
) -> DataFrame:
    """Every current risk and every previous risk once: paired, new or removed."""
    current, previous = _sides(risks, reports)
    exact = match_exact(current, previous, unique_names=unique_names)
    left_c = current.join(
        exact.select("report_id", F.col("current_risk_id").alias("risk_id")), ["report_id", "risk_id"], "left_anti")
    left_p = previous.join(
        exact.select("report_id", F.col("previous_risk_id").alias("risk_id")), ["report_id", "risk_id"], "left_anti")
    fuzzy = match_fuzzy(left_c, left_p, threshold=fuzzy_threshold)
    new = left_c.join(
        fuzzy.select("report_id", F.col("current_risk_id").alias("risk_id")), ["report_id", "risk_id"], "left_anti")
    gone = left_p.join(
        fuzzy.select("report_id", F.col("previous_risk_id").alias("risk_id")), ["report_id", "risk_id"], "left_anti")
    none = F.lit(None).cast("string")
    return (
        exact.withColumn("match_type", F.lit("EXACT")).withColumn("match_score", F.lit(1.0))
        .unionByName(fuzzy.withColumn("match_type", F.lit("FUZZY")))
        .unionByName(new.select(
            "report_id", F.col("risk_id").alias("current_risk_id"), none.alias("previous_risk_id"),
            F.lit("NONE").alias("match_type"), F.lit(0.0).alias("match_score")))
        .unionByName(gone.select(
            "report_id", none.alias("current_risk_id"), F.col("risk_id").alias("previous_risk_id"),
            F.lit("NONE").alias("match_type"), F.lit(0.0).alias("match_score")))
    )


def classify_evolution(matches: DataFrame, risks: DataFrame) -> DataFrame:
    """NEW / REMOVED / ESCALATED / REDUCED / UNCHANGED with confidence and explanation."""
    cols = ["risk_id", "company_id", "risk_name", "category", "severity", "confidence_score"]
    cur = risks.select(*[F.col(c).alias(f"c_{c}") for c in cols])
    prev = risks.select(*[F.col(c).alias(f"p_{c}") for c in cols])
    m = matches.join(cur, F.col("current_risk_id") == F.col("c_risk_id"), "left").join(
        prev, F.col("previous_risk_id") == F.col("p_risk_id"), "left"
    )

    def weight(c: Column) -> Column:
        return F.coalesce(F.nullif(F.array_position(
            F.array(*[F.lit(s) for s in vocab.RISK_SEVERITIES]), c), F.lit(0)), F.lit(2))

    step = weight(F.col("c_severity")) - weight(F.col("p_severity"))
    kind = (
        F.when(F.col("previous_risk_id").isNull(), F.lit("NEW_RISK"))
        .when(F.col("current_risk_id").isNull(), F.lit("REMOVED_RISK"))
        .when(step > 0, F.lit("ESCALATED_RISK"))
        .when(step < 0, F.lit("REDUCED_RISK"))
        .otherwise(F.lit("UNCHANGED_RISK"))
    )
    both = F.bround((F.col("c_confidence_score") + F.col("p_confidence_score")).cast("double") / 2.0, 3)
    confidence = F.coalesce(both, F.col("c_confidence_score"), F.col("p_confidence_score")).cast("double")
    q = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    named = F.concat(F.lit("Risk "), q(F.col("c_risk_name")))
    moved = F.concat(F.lit(" from "), F.col("p_severity"), F.lit(" to "), F.col("c_severity"), F.lit(" severity."))
    explanation = (
        F.when(F.col("previous_risk_id").isNull(), F.concat(
            F.lit("New "), text.title_words(F.col("c_category")), F.lit(" risk disclosed ("),
            q(F.col("c_risk_name")), F.lit(") with "), F.col("c_severity"), F.lit(" severity.")))
        .when(F.col("current_risk_id").isNull(), F.concat(
            F.lit("Risk related to "), text.title_words(F.col("p_category")), F.lit(" ("),
            q(F.col("p_risk_name")), F.lit(") has been removed from disclosures.")))
        .when(step > 0, F.concat(named, F.lit(" escalated"), moved))
        .when(step < 0, F.concat(named, F.lit(" reduced"), moved))
        .otherwise(F.concat(named, F.lit(" remained unchanged at "), F.col("c_severity"), F.lit(" severity.")))
    )
    return m.select(
        F.coalesce("c_company_id", "p_company_id").alias("company_id"), "report_id",
        "current_risk_id", "previous_risk_id", kind.alias("evolution_type"),
        confidence.alias("confidence_score"), explanation.alias("explanation"),
        "match_type", "match_score",
    )


def risk_evolution(
    risks: DataFrame, reports: DataFrame, *, fuzzy_threshold: float = vocab.RISK_FUZZY_THRESHOLD,
    unique_names: bool = False,
) -> DataFrame:
    """Matched, new and removed risks of every report against the report before it."""
    matches = match_risks(risks, reports, fuzzy_threshold=fuzzy_threshold, unique_names=unique_names)
    return classify_evolution(matches, risks)


# --- reads -----------------------------------------------------------------------------------
def evolutions_of_reports(evolutions: DataFrame, risks: DataFrame, report_ids: DataFrame) -> DataFrame:
    """Evolutions whose current **or** previous risk belongs to a wanted report.

    Two semi-joins and a union of disjoint halves instead of one join under OR.
    """
    ids = risks.join(report_ids.select("report_id"), "report_id", "left_semi").select("risk_id")
    now = evolutions.join(ids, F.col("current_risk_id") == F.col("risk_id"), "left_semi")
    rest = evolutions.join(ids, F.col("current_risk_id") == F.col("risk_id"), "left_anti")
    return now.unionByName(
        rest.join(ids, F.col("previous_risk_id") == F.col("risk_id"), "left_semi")
    )


def top_risks(risks: DataFrame, k: int = 3) -> DataFrame:
    """Most severe risks per report, CRITICAL first."""
    weight = F.array_position(F.array(*[F.lit(s) for s in vocab.RISK_SEVERITIES]), F.col("severity"))
    return top_per(risks, ["report_id"], [weight.desc(), F.col("risk_id")], k)
