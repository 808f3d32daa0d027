import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import robust_outliers as m
from ledgerlens.llm import site_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if seen[t] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(documents, odd_docs):
    for docs in (documents.select("doc_id", "text", "lang", "source"), odd_docs):
        texts = {}
        for r in docs.collect():
            texts.setdefault(r["doc_id"], set()).add(brute_counts(r["text"]))
        out = m.quality_verdicts(docs).collect()
        assert len(out) == docs.count()
        for r in out:
            got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
            assert got in texts[r["doc_id"]]
            failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
            assert r["base_failed"] == failed and (not failed or not r["kept"])


def test_one_space_alphabet(spark):
    text = "a b c d\x1ce \t\x0bf​"
    r = m.text_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first()
    assert (r["n_words"], r["word_chars"]) == brute_counts(text)[:2]


def brute_fit(x):
    """The same estimator with numpy: two starts, concentration steps on binned distances, smaller determinant."""
    low, mid, high = (np.sort(np.floor(x * 128), axis=0)[max(math.ceil(q * len(x)) - 1, 0)] / 128 for q in (0.25, 0.5, 0.75))
    scale, floor = np.maximum((high - low) / 1.349, m.FLOOR), np.diag(np.square(m.FLOOR))
    z = np.round(np.tanh((x - mid) / scale) * 1024) / 1024
    starts = [(mid, np.diag(scale**2)), (mid + z.mean(0) * scale, (np.cov(z.T, bias=True) + floor) * np.outer(scale, scale) + floor)]
    dist = lambda mu, c: np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(c), x - mu)
    best = None
    for mu, c in starts:
        for _ in range(m.STEPS):
            b = np.floor(np.log1p(dist(mu, c)) * 64)
            core = x[b <= np.sort(b)[math.ceil(m.CORE * len(x)) - 1]]
            mu, c = core.mean(0), np.cov(core.T, bias=True) + floor
        if best is None or np.linalg.slogdet(c)[1] < best[0] - 1e-9:
            best = (np.linalg.slogdet(c)[1], mu, c)
    d = dist(best[1], best[2])
    b = np.sort(np.floor(np.log1p(d) * 64))[math.ceil(0.5 * len(x)) - 1]
    return d / max(1.0, math.expm1((b + 0.5) / 64) / m.MEDIAN)


def test_distances_equal_a_numpy_estimate(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(60, 400))]
        if i % 15 == 0:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w), "en", "x" if i < 200 else "y"))
    out = m.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    for group in ("x", "y"):
        own = [r for r in out if (r["doc_id"] < 200) == (group == "x")]
        x = np.array([[math.log1p(r["n_words"]), math.log1p(r["word_chars"] / r["n_words"]), math.sqrt(r["n_symbols"] / r["n_words"]), 0,
                       math.sqrt(r["n_repeat_words"] / r["n_words"])] for r in own])
        want = brute_fit(np.round(x * 1024) / 1024)
        assert np.allclose([r["distance"] for r in own], want, rtol=1e-3)
    assert {r["doc_id"] for r in out if not r["kept"]} == {i for i in range(300) if i % 15 == 0}


def test_rejects_junk_and_keeps_clean(spark, sf):
    big = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = m.quality_verdicts(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = [r for r in rows if r["quality"]], [r for r in rows if not r["quality"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.05 * len(bad)


def test_no_rows(no_docs):
    assert m.quality_verdicts(no_docs).count() == 0


# ---- site quality -----------------------------------------------------------------------

def test_sparse_sites_shrink(spark):
    """Posteriors equal the formulas computed by hand; a path with one document stays near its host."""
    rng = random.Random(8)
    rows = [(h, f"{h}/{i % (1 + i % 9)}", 0.9 if rng.random() < (0.9 if h < "h5" else 0.2) else 0.1) for h in (f"h{k}" for k in range(10)) for i in range(50)]
    df = spark.createDataFrame(rows, "host string, path string, evidence double")
    sites, rate, weight = site_quality.site_posteriors(df)
    assert rate == pytest.approx(sum(r[2] for r in rows) / len(rows))
    for r in sites.collect():
        own = [x[2] for x in rows if x[0] == r["host"]]
        lowest, highest = sorted((rate, sum(own) / len(own)))
        assert lowest - 1e-9 <= r["host_posterior"] <= highest + 1e-9
        assert (r["host_posterior"] > 0.5) == (r["host"] < "h5")
    assert site_quality.WEAKEST <= weight <= site_quality.STRONGEST


def test_site_moves_undecided_documents(spark):
    """Equal texts with undecided evidence follow their host."""
    rng = random.Random(2)
    text = lambda junk: " ".join(f"w{rng.randrange(500)}" + ("##" if junk else "") for _ in range(60))
    docs, labels = [], []
    for i in range(400):
        junk = i % 2 == 1
        docs.append((i, text(junk), "bad" if junk else "good", "p"))
        labels.append((i, int(not junk), 0))
    twin = " ".join(f"w{k}" + ("##" if k % 4 == 0 else "") for k in range(60))
    docs += [(1000, twin, "good", "p"), (1001, twin, "bad", "p")]
    out = {r["doc_id"]: r for r in site_quality.quality_scores(
        spark.createDataFrame(docs, "doc_id long, text string, h string, p string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("h"), F.col("p")).collect()}
    assert out[1000]["evidence"] == out[1001]["evidence"] and out[1000]["score"] > out[1001]["score"]
    assert sum(out[i]["kept"] == (i % 2 == 0) for i in range(400)) >= 396


def test_held_out_accuracy_on_the_tables(spark, sf):
    big = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    train = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    rows = site_quality.quality_scores(docs, labels, F.col("source"), F.col("lang"), train=train).join(labels, "doc_id").filter(~train).collect()
    assert sum(r["kept"] for r in rows if r["quality"]) >= 0.99 * sum(r["quality"] for r in rows)
    assert sum(not r["kept"] for r in rows if not r["quality"]) >= 0.9 * sum(not r["quality"] for r in rows)


def test_odd_rows_of_quality(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (None, 1, 1), (2, None, None), (1, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        out = site_quality.quality_scores(odd_docs, known, F.col("source"), F.col("lang")).collect()
        assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert site_quality.quality_scores(no_docs, labels, F.col("source"), F.col("lang")).count() == 0
