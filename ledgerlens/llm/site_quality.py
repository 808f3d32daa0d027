"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

1. Document evidence: statistics of the text, rounded to bins, with the log odds of each bin
   among labelled good and bad texts.  Their sum is again rounded to bins, and each bin's
   smoothed share of good labels is the calibrated evidence p of a document.
2. Site posteriors: p is summed by path and host.  How strongly sites differ is estimated
   from the sums themselves (method of moments), and gives the weight of the prior: a host's
   posterior shrinks to the global rate, a path's to its host's, the more the fewer
   documents it has.
3. Score: the logit of a document's own evidence plus that of its path's posterior without
   the document, less that of the global rate.

Everything is grouped aggregation, combined before the shuffle; the site tables are joined
back by host and path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage

FEATURES = ["symbols", "upper", "marks", "distinct", "length", "words", "digits"]
SMOOTH = 2.0
KEEP = 0.5
# Least and largest weight of a prior, in documents.
WEAKEST, STRONGEST = 1.0, 1e4


def _statistics(text: Column) -> list[Column]:
    """One small integer per statistic: the bin of its value."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.greatest(F.size(words), F.lit(1))
    letters = F.greatest(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(1))
    share = lambda x, per: F.least(F.ceil(20 * x / per), F.lit(20))
    return [
        share(F.regexp_count(text, F.lit(r"[#*$%&|<>{}\[\]\\^~]+")), n), share(F.regexp_count(text, F.lit(r"\p{Lu}")), letters),
        share(F.regexp_count(text, F.lit(r"[!?]{2,}")), n), share(F.size(F.array_distinct(words)), n),
        F.least(F.round(2 * F.length(text) / n), F.lit(40)), F.least(F.floor(F.log2(n)), F.lit(16)),
        share(F.regexp_count(text, F.lit(r"[0-9]")), F.greatest(F.length(text), F.lit(1))),
    ]


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def evidence(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, host, path, text) with ``evidence`` instead of the text: the calibrated chance of a good label."""
    text = F.coalesce(F.col("text"), F.lit(""))
    binned = cut_lineage(docs.select("doc_id", "host", "path", F.array(*[x.cast("int") for x in _statistics(text)]).alias("bins")))
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    if train is not None:
        known = known.filter(train)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("good"))
    shown = cut_lineage(binned.join(known, "doc_id").select("bins", "good"))
    odds = shown.select("good", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin").agg(
        F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b")).collect()  # a few hundred bins
    totals = shown.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum(1 - F.col("good")), F.lit(0))).first()
    good, bad = totals[0] + SMOOTH, totals[1] + SMOOTH
    score = F.lit(0.0)
    for k in range(len(FEATURES)):
        own = {r["bin"]: r for r in odds if r["feature"] == k}
        table = [0.0] * 41
        for b, r in own.items():
            prior = SMOOTH / 2
            table[b] = float(_log_ratio((r["g"] + prior) / good, (r["b"] + prior) / bad))
        score = score + F.get(F.array(*[F.lit(v) for v in table]), F.greatest(F.col("bins")[k], F.lit(0)))
    level = F.greatest(F.least(F.round(score), F.lit(20)), F.lit(-20)).cast("int")
    rate = shown.select(level.alias("level"), "good").groupBy("level").agg(F.sum("good").alias("g"), F.count(F.lit(1)).alias("n")).collect()
    overall = float((totals[0] + 1) / (totals[0] + totals[1] + 2))
    share = {r["level"]: (r["g"] + SMOOTH * _squash(r["level"], overall)) / (r["n"] + SMOOTH) for r in rate}
    chance = F.get(F.array(*[F.lit(float(share.get(v, _squash(v, overall)))) for v in range(-20, 21)]), level + 20)
    return binned.select("doc_id", "host", "path", F.least(F.greatest(chance, F.lit(0.001)), F.lit(0.999)).alias("evidence"))


def _log_ratio(a: float, b: float) -> float:
    from math import log

    return log(a / b)


def _squash(score: float, overall: float) -> float:
    """Chance of a good label for a summed log odds, as naive Bayes has it."""
    from math import exp

    return 1 / (1 + (1 - overall) / overall * exp(-score))


def _prior_weight(groups: DataFrame, rate: Column) -> float:
    """Documents that the prior counts as, from how far group means spread beyond what chance explains.

    ``groups`` has n, s (sum of p) and the rate each shrinks to.
    """
    n = F.col("n")
    mean = F.col("s") / n
    row = groups.filter("n >= 2").agg(
        F.sum(n * (mean - rate) * (mean - rate)), F.sum(rate * (1 - rate)), F.sum(n), F.sum(n * rate * (1 - rate)), F.count(F.lit(1))).first()
    if not row[4]:
        return STRONGEST
    spread, chance, total, room = (float(x) for x in row[:4])
    between = max(0.0, (spread - chance) / total)
    within = room / total
    return STRONGEST if between <= within / STRONGEST else min(max(within / between - 1, WEAKEST), STRONGEST)


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float, float]:
    """Per (host, path): n, s and its host's posterior; the global rate; the weight of a host's posterior for its paths."""
    paths = cut_lineage(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    rate = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    rate = 0.5 if rate is None else float(rate)
    weight = _prior_weight(hosts, F.lit(rate))
    posterior = hosts.select(F.col("host").alias("_h"), ((F.lit(weight * rate) + F.col("s")) / (F.lit(weight) + F.col("n"))).alias("host_posterior"))
    placed = cut_lineage(paths.join(posterior, F.col("host").eqNullSafe(F.col("_h"))).drop("_h"))
    return placed, rate, _prior_weight(placed, F.col("host_posterior"))


def quality_scores(docs: DataFrame, labels: DataFrame, host: Column, path: Column, *, train: Column | None = None, keep: float = KEEP) -> DataFrame:
    """``doc_id``, ``host``, ``path``, ``evidence``, ``host_posterior``, ``path_posterior``, ``score`` and ``kept``.

    A NULL or empty text is a text without words.  NULL hosts and paths are sites of their
    own.  Without labels all evidence is one half and sites do not differ.  Repeated rows
    count each; NULL ids are kept and never labelled.  ``train`` limits the labels used.
    """
    scored = cut_lineage(evidence(docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text")), labels, train))
    sites, rate, weight = site_posteriors(scored)
    sites = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", "s", "host_posterior")
    met = scored.join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    prior = F.lit(weight) * F.col("host_posterior")
    others = (prior + F.col("s") - F.col("evidence")) / (F.lit(weight) + F.col("n") - 1)
    score = _logit(F.col("evidence")) + _logit(F.least(F.greatest(others, F.lit(0.001)), F.lit(0.999))) - float(_log_ratio(max(rate, 0.001), max(1 - rate, 0.001)))
    chance = 1 / (1 + F.exp(-score))
    return met.select(
        "doc_id", "host", "path", "evidence", "host_posterior", ((prior + F.col("s")) / (F.lit(weight) + F.col("n"))).alias("path_posterior"),
        chance.alias("score"), (chance >= keep).alias("kept"))
