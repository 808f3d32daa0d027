import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions import chunking, text
from ledgerlens.operators import chunks, extract, risks, sections, tone

CHUNK = "company_id string, report_id string, chunk_id string, chunk_index int, section string, chunk_text string, fiscal_year int, fiscal_quarter int"


def chunk_rows(spark, *rows):
    return spark.createDataFrame(
        [("c", f"r{i}", f"k{i}", 0, sec, body, 2024, None) for i, (sec, body) in enumerate(rows)], CHUNK)


def page_rows(spark, *texts, report="r"):
    return spark.createDataFrame([(report, i, t) for i, t in enumerate(texts, 1)], "report_id string, page_number int, page_text string")


def report(spark, kind):
    return spark.createDataFrame([("r", kind)], "report_id string, report_type string")


def found(spark, kind, *texts):
    out = sections.detect_sections(page_rows(spark, *texts), report(spark, kind)).collect()
    return {r["normalized_section_name"]: (r["start_page"], r["end_page"], float(r["confidence_score"]), r["content"]) for r in out}


def test_annual_report_sections_skip_contents_lines(spark):
    s = found(
        spark, "10-K", "Contents\nItem 1A. Risk Factors ...... 12\nItem 7. MD&A ...... 30", "PART I\nItem 1. Business\nWe make pumps.",
        "Item 1A. Risk Factors\nMany things may fail.", "They go on here.", "Item 7. Discussion\nSales rose.", "ITEM 8 - Statements\nTables.")
    assert {k: v[:3] for k, v in s.items()} == {
        "Business Overview": (2, 2, .95), "Risk Factors": (3, 4, .95), "MD&A": (5, 5, .95), "Financial Statements": (6, 6, .95)}
    assert s["Risk Factors"][3] == "Item 1A. Risk Factors\nMany things may fail.\nThey go on here."


def test_quarterly_items_follow_the_part(spark):
    s = found(spark, "10-Q", "PART I\nItem 1. Statements\nx", "Item 2. Discussion\nx", "PART II\nItem 1A. Risks\nx\nItem 1. Suits\ny")
    assert {k: v[0] for k, v in s.items()} == {"Financial Statements": 1, "MD&A": 2, "Risk Factors": 3, "Legal Proceedings": 3}


def test_transcript_and_confidence_tiers(spark):
    s = found(spark, "TRANSCRIPT", "Operator\nGood day.", "Prepared Remarks\nA. Person - Chief Executive Officer\nWe did well.", "Closing Remarks\nBye.")
    assert {k: v[2] for k, v in s.items()} == {"Operator Remarks": .9, "Prepared Remarks": .9, "CEO Commentary": .75, "Closing Remarks": .9}
    assert found(spark, "OTHER", "Risk Factors\nx")["Risk Factors"][2] == .85
    assert found(spark, "OTHER", "RISK FACTORS\nx")["Risk Factors"][2] == .9
    assert found(spark, "OTHER", "Summary of Risk Factors\nx")["Risk Factors"][2] == .75
    assert "Business Overview" not in found(spark, "OTHER", "A businesslike heading\nx")


def test_fallback_section(spark):
    assert found(spark, "OTHER", "plain prose one.", "plain prose two.") == {
        "Uncategorized": (1, 2, .3, "plain prose one.\nplain prose two.")}


def test_line_offsets_with_mixed_line_ends(spark):
    body = "first\r\n\n  second \rthird\x0bfourth"
    got = sections.lines_with_offsets(page_rows(spark, body)).orderBy("offset").select("offset", "line").collect()
    want, at = [], 0
    for line in body.splitlines(keepends=True):
        if line.strip():
            want.append((at, line.strip()))
        at += len(line)
    assert [tuple(r) for r in got] == want


# --- chunking -----------------------------------------------------------------------------
def tokens(s):
    return len(re.findall(r"\w+|[^\w\s]", s))


def sentences(*sizes):
    """Paragraphs of the given token counts, all words different."""
    return "\n\n".join(" ".join(f"p{k}w{i}" for i in range(n)) for k, n in enumerate(sizes))


@pytest.mark.parametrize("sizes, target, overlap, want", [
    ((10, 10, 10), 30, 5, [[0, 1, 2]]),               # all fits
    ((10, 10, 10), 20, 0, [[0, 1], [2]]),             # full at the target
    ((10, 10, 10), 20, 10, [[0, 1], [1, 2]]),         # the last paragraph comes again
    ((10, 10, 10), 20, 5, [[0, 1], [1, 2]]),          # even if it is longer than the overlap
    ((4, 4, 4, 10), 12, 8, [[0, 1, 2], [1, 2, 3]]),   # two of them fit the overlap
    ((20, 5), 20, 3, [[0], [0, 1]]),                  # a whole piece may come again
])
def test_pieces_of_paragraphs(sizes, target, overlap, want):
    paragraphs = sentences(*sizes).split("\n\n")
    got = chunking.cut(sentences(*sizes), target, max(sizes), overlap, vocab.PROSE_SEPARATORS)
    assert got == [("\n\n".join(paragraphs[k] for k in ks), sum(sizes[k] for k in ks)) for ks in want]


def test_pieces_cover_the_text_in_order_and_within_bounds():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randint(0, 120)
        body = "".join(f"w{i}{rng.choice(['', '.', ','])}" + rng.choice([" ", " ", "  ", "\n", "\n\n", ". "]) for i in range(n))
        target, limit, overlap = rng.choice([(20, 25, 5), (10, 12, 0), (30, 30, 9), (8, 20, 12)])
        got = chunking.cut(body, target, limit, overlap, rng.choice([vocab.PROSE_SEPARATORS, vocab.TABLE_SEPARATORS]))
        spans = [[int(w) for w in re.findall(r"w(\d+)", t)] for t, _ in got]
        assert all(size == tokens(t) and size <= max(target, limit) + max(overlap, limit) for t, size in got)
        assert sorted({w for s in spans for w in s}) == list(range(n))   # nothing is lost
        assert all(s == list(range(s[0], s[-1] + 1)) for s in spans)     # in order, without holes
        for one, two in zip(spans, spans[1:]):
            assert one[0] <= two[0] <= one[-1] + 1 and two[-1] > one[-1]  # each goes on where the last ended
            if overlap == 0:
                assert two[0] == one[-1] + 1


def test_chunk_job_numbers_and_dedupes(spark):
    s = spark.createDataFrame([
        ("r", "s1", "A", "MD&A", 1, 1, "Same text here.", 0), ("r", "s2", "B", "Outlook", 2, 2, " Same text here. ", 0),
        ("r", "s3", "C", "Risk Factors", 3, 3, "\n\n".join("word " * 200 for _ in range(6)), 0)],
        "report_id string, section_id string, section_name string, normalized_section_name string, start_page int, end_page int, content string, line_no int")
    r = spark.createDataFrame([("r", "c", "ACME", "10-K", 2024, None)],
                              "report_id string, company_id string, company string, report_type string, year int, quarter int")
    out = chunks.chunk_sections(s, r).orderBy("chunk_index").collect()
    assert [x["chunk_index"] for x in out] == list(range(len(out)))
    assert [x["section"] for x in out][:2] == ["MD&A", "Risk Factors"]
    assert len(out) == 2                       # the six paragraphs are equal, so are all pieces of two
    assert out[1]["token_count"] == 400 and out[0]["metadata"]["company"] == "ACME"


def test_chunk_checks(spark):
    keys = [k for k in vocab.CHUNK_METADATA_KEYS]
    df = spark.createDataFrame(
        [("r", 0, "one two", 2, keys), ("r", 1, " one two ", 60, keys), ("r", 2, " ", 0, keys), ("r", 3, "x", 900, keys[1:])],
        "report_id string, chunk_index int, chunk_text string, token_count int, metadata_keys array<string>")
    out = {r["chunk_index"]: (r["fatal"], r["warnings"]) for r in chunks.check_chunks(df).collect()}
    assert out == {
        0: ([], ["too_small: 2 < 50"]), 1: (["duplicate_chunk"], []), 2: (["empty_chunk"], []),
        3: (["broken_metadata: missing company"], ["too_large: 900 > 800"])}


def test_candidate_sections_fall_back_to_all(spark, rows):
    c = spark.createDataFrame([("a", 1, "MD&A"), ("a", 2, "Other"), ("b", 3, "Other"), ("b", 4, None)], "report_id string, chunk_id int, section string")
    assert rows(chunks.candidate_chunks(c, ["MD&A"]), "chunk_id") == [(1,), (3,), (4,)]


# --- risk -------------------------------------------------------------------------------------
@pytest.mark.parametrize("body, category, level, name", [
    ("A significant disruption of our global supply chain could affect the plants.", "SUPPLY_CHAIN", "HIGH", "SUPPLY_CHAIN_RISK"),
    ("New regulatory rules bring a risk of moderate cost.", "REGULATORY", "MEDIUM", "REGULATORY_RISK"),
    ("A security breach is an existential threat to us.", "CYBERSECURITY", "CRITICAL", "SECURITY_BREACH_RISK"),
    ("Local competition is a minor risk.", "COMPETITION", "LOW", "COMPETITION_RISK"),
])
def test_risk_extraction(spark, body, category, level, name):
    out = {r["category"]: r for r in risks.extract_risks(chunk_rows(spark, ("Risk Factors", body))).collect()}
    assert out[category]["severity"] == level and out[category]["normalized_risk_name"] == name
    assert out[category]["confidence_score"] == 0.85


def test_risk_name_is_first_defined_keyword_and_alias_resolves(spark):
    hits = risks.keyword_hits(F.lower(F.lit("Debt covenant and credit facility risk")))
    got = {h["category"]: h["keyword"] for h in spark.range(1).select(hits.alias("h")).first()["h"]}
    assert got == {"LIQUIDITY": "credit"}
    names = spark.createDataFrame([("Data Breach",), ("Fuel/price, swings",), (" liquidity risk ",)], "n string").select(
        risks.normalize_name(F.col("n")).alias("n"))
    assert [r["n"] for r in names.collect()] == ["DATA_BREACH", "FUEL_PRICE__SWINGS", "LIQUIDITY_RISK"]


RISK = "risk_id string, company_id string, report_id string, risk_name string, normalized_risk_name string, category string, severity string, confidence_score double"


def two_reports(spark):
    return spark.createDataFrame([("p", "c", 2023, None), ("n", "c", 2024, None)], "report_id string, company_id string, year int, quarter int")


def test_risk_matching_is_one_to_one_and_stable(spark):
    rng = random.Random(3)
    bag = ["supply", "chain", "delay", "cost", "cyber", "threat", "credit", "market", "risk", "of"]
    def side(prefix, rep):
        out = []
        for i in range(40):
            name = " ".join(rng.sample(bag, rng.randint(1, 4)))
            out.append((f"{prefix}{i:02d}", "c", rep, name, name.upper().replace(" ", "_"), rng.choice(["A", "B"]), rng.choice(vocab.RISK_SEVERITIES), 0.8))
        return out
    current, previous = side("n", "n"), side("p", "p")
    m = risks.match_risks(spark.createDataFrame(current + previous, RISK), two_reports(spark)).collect()
    pairs = {r["current_risk_id"]: r["previous_risk_id"] for r in m if r["current_risk_id"] and r["previous_risk_id"]}
    now, then = {c[0]: c for c in current}, {p[0]: p for p in previous}
    words = lambda r: set(r[3].lower().split()) - set(vocab.RISK_STOP_WORDS)
    overlap = lambda c, p: len(words(c) & words(p)) / max(1, len(words(c) | words(p)))
    assert len(set(pairs.values())) == len(pairs)  # each previous risk is used once
    exact = {c for c in pairs if now[c][4] == then[pairs[c]][4]}
    for name in {r[4] for r in current + previous}:  # as many equal names pair as both sides have
        assert sum(now[c][4] == name for c in exact) == min(sum(r[4] == name for r in current), sum(r[4] == name for r in previous))
    fuzzy = {c: p for c, p in pairs.items() if c not in exact}
    assert all(now[c][5] == then[p][5] and overlap(now[c], then[p]) >= 0.4 for c, p in fuzzy.items())
    for c in set(now) - exact:  # what was free at its turn was no better than what it took
        earlier = {p for k, p in fuzzy.items() if k < c}
        free = [p for p in then if p not in earlier and p not in {pairs[e] for e in exact} and then[p][5] == now[c][5]]
        best = max((overlap(now[c], then[p]) for p in free), default=0)
        assert best < 0.4 if c not in fuzzy else overlap(now[c], then[fuzzy[c]]) == best
    assert len(m) == 40 + 40 - len(pairs)      # everything appears once


def test_risk_evolution_classes(spark):
    rows_ = [
        ("p1", "c", "p", "Supply Chain Delays", "SC", "SUPPLY_CHAIN", "LOW", .8), ("n1", "c", "n", "Supply Chain Delays", "SC", "SUPPLY_CHAIN", "HIGH", .9),
        ("p2", "c", "p", "Compliance costs", "CC", "REGULATORY", "CRITICAL", .8), ("n2", "c", "n", "Rising compliance costs", "RCC", "REGULATORY", "MEDIUM", .8),
        ("p3", "c", "p", "Old lawsuit", "OL", "LEGAL", "LOW", .7), ("n3", "c", "n", "Flood", "F", "ENVIRONMENTAL", "LOW", .6)]
    out = {(r["current_risk_id"], r["previous_risk_id"]): r for r in risks.risk_evolution(spark.createDataFrame(rows_, RISK), two_reports(spark)).collect()}
    assert {k: v["evolution_type"] for k, v in out.items()} == {
        ("n1", "p1"): "ESCALATED_RISK", ("n2", "p2"): "REDUCED_RISK", ("n3", None): "NEW_RISK", (None, "p3"): "REMOVED_RISK"}
    assert out["n1", "p1"]["confidence_score"] == .85 and out["n3", None]["confidence_score"] == .6
    assert out["n3", None]["explanation"] == "New Environmental risk disclosed ('Flood') with LOW severity."


# --- tone -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("body, mood, level", [
    ("We delivered exceptional performance. We expect continued growth.", "POSITIVE", "VERY_CONFIDENT"),
    ("We face headwinds. The volatile market may hurt operations.", "NEGATIVE", "VERY_CAUTIOUS"),
    ("The quarter was stable. We are on track.", "NEUTRAL", "VERY_CONFIDENT"),
])
def test_tone(spark, body, mood, level):
    r = tone.score_tone(chunk_rows(spark, ("MD&A", body))).first()
    assert (r["sentiment"], r["confidence_level"]) == (mood, level)


def test_phrases_are_raw_substrings(spark):
    n = spark.range(1).select(text.phrase_total(F.lit("maybe estimated may"), ["may", "estimate", "estimated"]).alias("n")).first()["n"]
    assert n == 4


def test_blank_chunk_has_no_tone(spark):
    assert tone.score_tone(chunk_rows(spark, ("MD&A", " \n "))).count() == 0


def test_tone_confidence_without_stated_value(spark):
    row = spark.range(1).select(
        tone.tone_confidence(F.lit("LLM_BASED"), F.lit(None).cast("double")).alias("a"),
        tone.tone_confidence(F.lit("LLM_BASED"), F.lit(3.0)).alias("b"), tone.tone_confidence(F.lit("x")).alias("c")).first()
    assert tuple(row) == (0.8, 1.0, 0.6)


# --- metric extraction ---------------------------------------------------------------------------------
@pytest.mark.parametrize("section, body, metric, value, unit, currency", [
    ("Income Statement", "Total revenue was $96.7 billion in fiscal 2024.", "REVENUE", 96_700_000_000, "BILLION", "USD"),
    ("Income Statement", "Net sales totaled $96,700 million.", "REVENUE", 96_700_000_000, "MILLION", "USD"),
    ("MD&A", "Operating margin expanded to 28.5% in the year.", "OPERATING_MARGIN", 28.5, "PERCENT", None),
    ("Cash Flow Statement", "Net cash provided by operating activities was $12.4 billion.", "OPERATING_CASH_FLOW", 12_400_000_000, "BILLION", "USD"),
    ("Forward Guidance", "Full-year revenue is expected to be about $105 billion.", "REVENUE_GUIDANCE", 105_000_000_000, "BILLION", "USD"),
    ("MD&A", "Revenue in 2024 grew to 17 stores.", "REVENUE", 17, "ABSOLUTE", None),
])
def test_metric_extraction(spark, section, body, metric, value, unit, currency):
    out = {r["normalized_metric_name"]: r for r in extract.extract_metrics(chunk_rows(spark, (section, body))).collect()}
    r = out[metric]
    assert (float(r["value"]), r["unit"], r["currency"]) == (value, unit, currency)


def test_longest_alias_claims_first():
    spans = [(s, m) for s, _, m in extract.alias_spans("total net sales and gross profit margin, sales")]
    assert spans == [(0, "REVENUE"), (20, "GROSS_MARGIN"), (41, "REVENUE")]
