"""Filtered nearest-neighbour search, fusion, reranking, context and evaluation.

Search is exact.  Blocks of queries meet blocks of vectors in one task each, a task keeps
its k best per query while vectors stream past, and only those rows are merged.  No
(query, vector) pair is materialized and nothing passes through the driver.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions import money, text
from ledgerlens.functions.grouped import number_rows, running_total, top_per
from ledgerlens.session import cut_lineage

# Queries a task holds (a 768-dim block stays below 130 MB), vectors that stream past them, and the
# tile of scores computed at once (16 MB).
QUERY_BLOCK = 20_000
VECTOR_BLOCK = 500_000
QUERY_TILE, VECTOR_TILE = 512, 4096
_EMBED_TOKEN = re.compile(r"[a-z0-9]+")
REPORT_FILTERS = ["company_id", "year", "quarter", "report_type"]  # held by reports, not by chunks
FILTERS = ["report_id", "company_id", "year", "quarter", "report_type", "section"]


# --- vectors ------------------------------------------------------------------------------
def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit vector; NULL for a zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def embedding_issues(v: Column, dimension: int, status: Column | None = None) -> Column:
    """Fatal reasons of a vector about to be stored."""
    filled = F.size(v) > 0
    zero = F.forall(v, lambda x: x == 0)
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    already = F.lit(None).cast("string") if status is None else F.when(
        status == "COMPLETED", F.lit("duplicate_generation"))
    return F.array_compact(F.array(
        already,
        F.when(v.isNull(), F.lit("null_embedding")).when(F.size(v) == 0, F.lit("empty_vector")),
        F.when(v.isNotNull() & filled & (F.size(v) != dimension), F.concat(
            F.lit("wrong_dimension: "), F.size(v), F.lit(f" != {dimension}"))),
        F.when(v.isNotNull() & filled & zero, F.lit("zero_vector")).when(
            v.isNotNull() & filled & bad, F.lit("non_finite_values")),
    ))


def hashing_embedder(dimension: int):
    """Bag-of-tokens test embedder: md5 of each token picks a slot, counts are normalized."""
    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out, slots = [], {}
        for body in texts:
            v = np.zeros(dimension)
            for token, times in Counter(_EMBED_TOKEN.findall((body or "").lower())).items():
                at = slots.get(token)
                if at is None:
                    at = slots[token] = int(hashlib.md5(token.encode()).hexdigest(), 16) % dimension
                v[at] += times
            size = float(np.sqrt(v @ v))
            out.append((v / size if size else v).tolist())
        return pd.Series(out)

    return embed


def content_vector(dimension: int):
    """Same text, same vector: digests give 16-bit numbers, centred and normalized."""
    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        rounds = math.ceil(dimension * 2 / 32)
        out = []
        for body in texts:
            raw = b"".join(hashlib.sha256(f"{body}|{i}".encode()).digest() for i in range(rounds))
            v = np.frombuffer(raw[:dimension * 2], dtype=">u2").astype(float) / 65535.0 - 0.5
            out.append((v / (float(np.sqrt(v @ v)) or 1.0)).tolist())
        return pd.Series(out)

    return embed


def embed_batches(df: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = vocab.EMBED_BATCH):
    """Any provider callable, fed ``batch`` texts at a time; a failing batch yields NULL vectors."""
    schema = "chunk_id string, embedding array<double>, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                try:
                    vectors, error = embed(part["chunk_text"].tolist()), None
                except Exception as exc:  # one bad batch must not lose the run
                    vectors, error = [None] * len(part), f"{type(exc).__name__}: {exc}"
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "embedding": vectors, "error": error})

    return df.select("chunk_id", "chunk_text").mapInPandas(run, schema)


# --- search ---------------------------------------------------------------------------------
class _Best:
    """The k best vectors of each query of a block, kept while vectors stream past in tiles.

    A query's bound is its k-th best score so far; only scores that reach it are looked at.
    Scores are rounded to six places, and equal ones rank by id, so candidates are taken
    from one last place below the bound and rounded afterwards.
    """

    SLACK = 1e-6

    def __init__(self, batches: list[pa.RecordBatch], k: int, filters: list[str], own: bool):
        block = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.q, self.k = _unit_rows(block.column("_v")), k
        self.query_ids = block.column("query_id")
        self.own = block.column("_own").to_numpy(zero_copy_only=False) if own else None
        self.wanted = {}
        for f in filters:  # queries ask for few different sets of values
            asked = [None if w is None else frozenset(w) for w in block.column(f"want_{f}").to_pylist()]
            sets = list(dict.fromkeys(asked))
            place = {w: i for i, w in enumerate(sets)}
            self.wanted[f] = np.array([place[w] for w in asked]), sets
        self.bound = np.full(len(self.q), -np.inf)
        self.rows, self.scores, self.ids = np.empty(0, np.int64), np.empty(0), None

    def _masks(self, batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per filter: the queries' set, the vectors' value, and which set accepts which value."""
        out = []
        for f, (asked, sets) in self.wanted.items():
            held = batch.column(f).dictionary_encode(null_encoding="encode")
            values = held.dictionary.to_pylist()
            accepts = np.array([[w is None or (x is not None and x in w) for x in values] for w in sets], dtype=bool)
            out.append((asked, held.indices.to_numpy(zero_copy_only=False), accepts))
        return out

    def add(self, batch: pa.RecordBatch) -> None:
        v, ids, masks = _unit_rows(batch.column("_v")), batch.column("vec_id").to_numpy(zero_copy_only=False), self._masks(batch)
        if v.shape[1] != self.q.shape[1]:
            raise ValueError(f"queries have {self.q.shape[1]} dimensions, vectors {v.shape[1]}")
        for at in range(0, len(v), VECTOR_TILE):
            cols = slice(at, at + VECTOR_TILE)
            found = [(self.rows, self.ids, self.scores)] if self.ids is not None else []
            for start in range(0, len(self.q), QUERY_TILE):
                r, c, s = self._hits(slice(start, start + QUERY_TILE), v[cols], ids[cols], [(a, h[cols], t) for a, h, t in masks])
                found.append((r + start, ids[cols][c], s))
            self._settle(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def _hits(self, queries: slice, v: np.ndarray, ids: np.ndarray, masks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = self.q[queries] @ v.T
        for asked, held, accepts in masks:
            s[~accepts[asked[queries]][:, held]] = -np.inf
        if self.own is not None:
            s[self.own[queries][:, None] == ids[None, :]] = -np.inf
        bound = self.bound[queries]
        if s.shape[1] > self.k and not np.isfinite(bound).all():
            bound = np.maximum(bound, -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1])
        r, c = np.nonzero((s >= bound[:, None] - self.SLACK) & np.isfinite(s))
        return r, c, np.round(s[r, c], 6) + 0.0

    def _settle(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(-scores[order], kind="stable")]
        order = order[np.argsort(rows[order], kind="stable")]
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = place < self.k
        full = place == self.k - 1
        self.bound[rows[full]] = scores[order][full]
        self.rows, self.ids, self.scores = rows[keep], ids[order][keep], scores[order][keep]

    def results(self, id_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [self.query_ids.take(pa.array(self.rows)), pa.array(self.ids, type=id_type), pa.array(self.scores, type=pa.float64())],
            names=["query_id", "vec_id", "score"])


def _unit_rows(vectors: pa.ListArray) -> np.ndarray:
    """One row per vector, of length 1 (a zero vector stays zero); all must have one dimension."""
    size = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(size) != 1:
        raise ValueError(f"vectors of different dimensions: {sorted(size)}")
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), size[0])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _search(batches: Iterator[pa.RecordBatch], k: int, filters: list[str], own: bool) -> Iterator[pa.RecordBatch]:
    """Cells of one partition, each its queries first and then its vectors, which only stream past."""
    cell, asked, best, id_type = None, [], None, None
    for batch in batches:
        id_type = batch.schema.field("vec_id").type
        keys = batch.column("_cell").to_numpy()
        vector = batch.column("_vector").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(keys) != 0) | (vector[1:] != vector[:-1])) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            part = batch.slice(start, end - start)
            if keys[start] != cell:
                if best is not None and best.ids is not None:
                    yield best.results(id_type)
                cell, asked, best = keys[start], [], None
            if not vector[start]:
                asked.append(part)
            elif asked:
                best = best or _Best(asked, k, filters, own)
                best.add(part)
    if best is not None and best.ids is not None:
        yield best.results(id_type)


def _request_columns(queries: DataFrame, filters: list[str], *more: str) -> DataFrame:
    """query_id, vector, ``more`` and one array of accepted values per filter (NULL accepts all)."""
    have = {c: t for c, t in queries.dtypes}
    def want(name: str) -> Column:
        if name not in have:
            return F.lit(None).cast("array<string>")
        if have[name].startswith("array"):
            return F.when(F.size(name) > 0, F.col(name).cast("array<string>"))
        return F.when(F.col(name).isNotNull(), F.array(F.col(name).cast("string")))

    return queries.select("query_id", "vector", *more, *[want(f).alias(f"want_{f}") for f in filters])


def knn(
    queries: DataFrame, vectors: DataFrame, k: int = vocab.TOP_K_DEFAULT, *, filters: tuple[str, ...] = (),
    own: str | None = None, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK,
) -> DataFrame:
    """Exact cosine top-k of every query: query_id, vec_id, score (6 places), rank.

    ``queries`` has query_id, vector and optionally one column per filter, a value or an
    array of accepted values; NULL accepts everything.  Filters apply before ranking.
    ``own`` names a column of ``queries`` with the id of a vector that its query must not
    find (judged questions that were made from a stored chunk).  Rows of either side
    without an id or a vector take no part; a repeated vector is found as often as it
    occurs.  All vectors must have one dimension.

    One plan at every size, and nothing but two counts reaches the driver.  Queries and
    vectors are dealt by hash into blocks, and each pair of blocks is a cell of its own
    partition.  A task holds the queries of its cell, at most about ``query_block``, while
    the vectors stream past in tiles against each query's k-th best score so far; k rows
    per query leave a cell, and Spark cuts them to k per task again before it merges them.
    """
    filters = list(filters)
    spark = queries.sparkSession
    wants = [f"want_{f}" for f in filters]
    own_id = F.lit(None).cast(dict(vectors.dtypes)["vec_id"]) if own is None else F.col(own).cast(dict(vectors.dtypes)["vec_id"])
    requests = _request_columns(queries.withColumn("_own", own_id), filters, "_own").filter(
        F.col("query_id").isNotNull() & F.col("vector").isNotNull())
    pool = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    # all rows count, with a vector or not, so that no vector is computed for it
    counts = {r["s"]: r["n"] for r in queries.select(F.lit("q").alias("s")).unionAll(vectors.select(F.lit("v"))).groupBy("s").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    nq = max(1, -(-counts.get("q", 0) // query_block))
    fewest = -(-spark.sparkContext.defaultParallelism // nq)  # cells for every core, if each has a tile to do
    nv = max(1, -(-counts.get("v", 0) // vector_block), min(fewest, -(-counts.get("v", 0) // QUERY_TILE)))

    types = dict(requests.dtypes)["vector"], dict(pool.dtypes)["embedding"]
    kind = types[0] if types[0] == types[1] else "array<double>"
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    none = lambda t: F.lit(None).cast(t)
    asked = requests.select(
        F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("_b"), block("query_id", nq).alias("_a"), F.lit(False).alias("_vector"),
        "query_id", none(dict(pool.dtypes)["vec_id"]).alias("vec_id"), F.col("vector").cast(kind).alias("_v"), "_own", *wants,
        *[none("string").alias(f) for f in filters])
    held = pool.select(
        block("vec_id", nv).alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("_a"), F.lit(True).alias("_vector"),
        none(dict(requests.dtypes)["query_id"]).alias("query_id"), "vec_id", F.col("embedding").cast(kind).alias("_v"),
        none(dict(pool.dtypes)["vec_id"]).alias("_own"), *[none("array<string>").alias(w) for w in wants],
        *[F.col(f).cast("string").alias(f) for f in filters])
    cells = asked.unionByName(held).withColumn("_cell", F.col("_a") * nv + F.col("_b")).drop("_a", "_b")
    schema = f"query_id {dict(requests.dtypes)['query_id']}, vec_id {dict(pool.dtypes)['vec_id']}, score double"
    partial = cells.repartitionById(nq * nv, "_cell").sortWithinPartitions("_cell", "_vector").mapInArrow(
        lambda batches: _search(batches, k, filters, own is not None), schema)
    return top_per(partial, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)


def report_base(queries: DataFrame, vectors: DataFrame, reports: DataFrame, filters: tuple[str, ...]) -> DataFrame:
    """Vectors with the report columns that filters ask for; as they are when they have them all.

    Only then are reports joined (inner), and only those that some query accepts: the
    different sets of accepted values of the queries and each report's values, each also
    as "any", meet in a semi-join, so vectors of other reports never reach the search.
    """
    needed = [f for f in filters if f in REPORT_FILTERS and f not in vectors.columns]
    if not needed:
        return vectors
    anything, nothing = F.lit("\x00any"), F.lit("\x00null")
    wanted = _request_columns(queries, needed).select(*[f"want_{f}" for f in needed]).distinct()
    cells = reports.select("report_id", *needed, *[F.col(f).cast("string").alias(f"want_{f}") for f in needed])
    for f in needed:
        w = f"want_{f}"
        wanted = wanted.withColumn(w, F.explode(F.coalesce(w, F.array(anything))))
        cells = cells.withColumn(w, F.explode(F.array(F.coalesce(w, nothing), anything)))
    accepted = cells.join(wanted, [f"want_{f}" for f in needed], "left_semi").select("report_id", *needed).distinct()
    return vectors.join(accepted, "report_id")


def candidate_counts(queries: DataFrame, vectors: DataFrame, filters: tuple[str, ...]) -> DataFrame:
    """Vectors that pass each query's filters, and the share of the corpus they spare."""
    names = list(filters)
    requests = _request_columns(queries, names)
    pool = vectors.filter(F.col("embedding").isNotNull()).select(*names)
    # identical attribute combinations collapse before they meet the queries; each is then
    # rolled up over every subset of filters ("any"), so a query finds its candidates, and
    # the corpus size, by equi-joins instead of a scan of all combinations
    anything, nothing = F.lit("\x00any"), F.lit("\x00null")
    cells = pool.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).select(
        "_n", *[F.array(F.coalesce(F.col(f).cast("string"), nothing), anything).alias(f) for f in names])
    for f in names:
        cells = cells.withColumn(f, F.explode(f))
    cube = cells.groupBy(*names).agg(F.sum("_n").alias("_n"))
    keyed = requests.select("query_id", *[f"want_{f}" for f in names])
    for f in names:
        keyed = keyed.withColumn(f, F.explode(F.coalesce(f"want_{f}", F.array(anything))))
    keyed = keyed.select("query_id", *names, F.lit(True).alias("_own")).unionByName(
        requests.select("query_id", *[anything.alias(f) for f in names], F.lit(False).alias("_own")))
    counted = keyed.join(cube, names, "left").groupBy("query_id").agg(
        F.coalesce(F.sum(F.when(F.col("_own"), F.col("_n"))), F.lit(0)).alias("candidates"),
        F.max(F.when(~F.col("_own"), F.col("_n"))).alias("_corpus"),
    )
    spared = F.greatest(F.lit(0.0), 1 - F.col("candidates") / F.col("_corpus")) * 100
    return counted.select(
        "query_id", "candidates",
        F.coalesce(F.bround(spared, 2), F.lit(0.0)).alias("reduction_pct"))


def check_requests(requests: DataFrame) -> DataFrame:
    """First problem of each search request, or NULL."""
    c = F.col
    return requests.select(
        "query_id",
        F.when(text.is_blank(c("query")), F.lit("empty_query"))
        .when(F.length("query") > vocab.MAX_QUERY_CHARS, F.lit("query_too_long"))
        .when(~c("top_k").between(vocab.TOP_K_MIN, vocab.TOP_K_MAX), F.lit("bad_top_k"))
        .when(~c("year").between(1900, 2200), F.lit("bad_year"))
        .when(~c("quarter").between(1, 4), F.lit("bad_quarter"))
        .when(~c("report_type").isin(vocab.REPORT_TYPES), F.lit("unknown_report_type"))
        .when(~c("section").isin(vocab.SECTIONS), F.lit("unknown_section"))
        .when(c("quarter").isNotNull() & (c("report_type") == "10-K"), F.lit("quarter_on_annual_report"))
        .alias("problem"),
    )


def check_targets(requests: DataFrame, reports: DataFrame, companies: DataFrame) -> DataFrame:
    """Requests against the data: the report exists and agrees with the other filters."""
    r = reports.select(
        F.col("report_id").alias("_rid"), F.col("company_id").alias("_c"), F.col("year").alias("_y"),
        F.col("quarter").alias("_q"), F.col("report_type").alias("_t"))
    known = companies.select(F.col("company_id").alias("_known"))
    j = requests.join(r, F.col("report_id") == F.col("_rid"), "left").join(
        known, F.col("company_id") == F.col("_known"), "left")
    pinned = F.col("report_id").isNotNull()
    differs = lambda want, have: F.col(want).isNotNull() & ~F.col(want).eqNullSafe(F.col(have))
    return j.select(
        "query_id",
        F.when(pinned & F.col("_rid").isNull(), F.lit("report_not_found"))
        .when(pinned & differs("company_id", "_c"), F.lit("other_company"))
        .when(pinned & differs("year", "_y"), F.lit("other_year"))
        .when(pinned & differs("quarter", "_q"), F.lit("other_quarter"))
        .when(pinned & differs("report_type", "_t"), F.lit("other_report_type"))
        .when(~pinned & F.col("company_id").isNotNull() & F.col("_known").isNull(), F.lit("company_not_found"))
        .alias("problem"),
    )


def filter_predicate(
    *, report_id=None, company_id=None, year=None, quarter=None, report_type=None, section_name=None,
    section=None, profile: str = "GENERAL",
) -> Column:
    """One request's filters as a predicate on chunks; the profile's sections apply only
    when no section is pinned.  Spark pushes it below joins and to the scan."""
    given = {
        "report_id": report_id, "company_id": company_id, "year": year, "quarter": quarter,
        "report_type": report_type, "section_name": section_name, "section": section,
    }
    out = F.lit(True)
    for name, value in given.items():
        if value is not None:
            out = out & (F.col(name) == value)
    preferred = vocab.PROFILES[profile.upper()]
    if section is None and preferred:
        out = out & F.col("section").isin(preferred)
    return out


# --- query understanding ------------------------------------------------------------------------
def _class_scores(lowered: Column) -> dict[str, Column]:
    def total(name: str, words: list[str]) -> Column:
        hits = sum((lowered.contains(w).cast("int") for w in words), F.lit(0))
        return hits * (1 if name == "GENERAL" else 2)

    return {name: total(name, words) for name, words in vocab.QUERY_KEYWORDS.items()}


def classify_query(query: Column) -> Column:
    """struct(query_class, confidence): keyword score, two active classes give MIXED."""
    scores = _class_scores(F.lower(query))
    active = sum(((s > 1).cast("int") for s in scores.values()), F.lit(0))
    names = list(scores)
    best = F.array_sort(F.array(*[
        F.struct((-scores[n]).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(names)
    ]))[0]
    label = F.when(active >= 2, F.lit("MIXED")).when(best["s"] == 0, F.lit("GENERAL")).otherwise(best["n"])
    sure = F.when(active >= 2, F.lit(0.7)).when(best["s"] == 0, F.lit(0.5)).otherwise(F.lit(0.85))
    return F.struct(label.alias("query_class"), sure.alias("confidence"))


def sub_queries(query: Column) -> Column:
    """Split on " and ", else on " or ", else the query itself."""
    lowered = F.lower(query)
    parts = F.when(lowered.contains(" and "), F.split(query, " and ")).when(
        lowered.contains(" or "), F.split(query, " or ")).otherwise(F.array(query))
    return F.transform(parts, text.strip)


def query_keywords(query: Column) -> Column:
    marks = "[?,.!:;\"']+"
    words = F.transform(
        F.filter(F.split(query, f"{text.WS}+"), lambda w: F.length(w) > 0),
        lambda w: F.regexp_replace(w, f"^{marks}|{marks}$", ""),
    )
    stop = [F.lit(w) for w in vocab.QUERY_STOP_WORDS]
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(F.array(*stop), F.lower(w)))


def rewrite_query(query: Column, query_class: Column) -> Column:
    """Keywords of the query and expansion terms of its class, each once, in order."""
    terms = None
    for name, words in vocab.QUERY_EXPANSIONS.items():
        if name != "GENERAL":
            arr = F.array(*[F.lit(w) for w in words])
            terms = F.when(query_class == name, arr) if terms is None else terms.when(query_class == name, arr)
    terms = terms.otherwise(F.array(*[F.lit(w) for w in vocab.QUERY_EXPANSIONS["GENERAL"]]))
    return F.array_join(F.array_distinct(F.concat(query_keywords(query), terms)), " ")


def hypothetical_passage(query: Column) -> Column:
    lowered = F.lower(query)
    p = vocab.PASSAGES
    return (
        F.when(lowered.rlike("supply chain|risk|concerns"), F.lit(p["risk"]))
        .when(lowered.rlike("margin|revenue|profit"), F.lit(p["financial"]))
        .when(lowered.rlike("sentiment|tone|management"), F.lit(p["tone"]))
        .otherwise(F.concat(F.lit("Regarding the query '"), query, F.lit("', "), F.lit(p["other"])))
    )


def strategy_table(spark) -> DataFrame:
    rows = [(name, *spec) for name, spec in vocab.STRATEGIES.items()]
    return spark.createDataFrame(
        rows, "strategy string, rewrite boolean, passage boolean, depth int, rerank boolean, budget string, profile string")


# --- fusion, reranking, context ------------------------------------------------------------------
def fuse(results: DataFrame) -> DataFrame:
    """Union of result lists: the best score of each (query, chunk)."""
    return results.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def lexical_score(query: Column, body: Column) -> Column:
    """min(1, jaccard + min(.05 * shared words, .5)) to four places."""
    return lexical_set_score(text.word_set(query), text.word_set(body))


def lexical_set_score(query_words: Column, body_words: Column) -> Column:
    """:func:`lexical_score` for word sets that exist already."""
    def score(s: Column) -> Column:
        shared = F.size(F.array_intersect(s["q"], s["b"]))
        union = F.size(s["q"]) + F.size(s["b"]) - shared
        ratio = F.when(union > 0, shared / union).otherwise(F.lit(0.0))
        return F.bround(F.least(F.lit(1.0), ratio + F.least(shared * 0.05, F.lit(0.5))), 4)

    return text.let(F.struct(query_words.alias("q"), body_words.alias("b")), score)


def rerank(results: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """0.3 vector + 0.7 text score; scores outside 0..1 pass a sigmoid first.

    ``results`` has query_id, query, chunk_id, chunk_text, score.  ``scorer`` may be any
    Column or pandas UDF of (query, text).
    """
    return _rerank(results, k, scorer(F.col("query"), F.col("chunk_text")))


def _rerank(results: DataFrame, k: int, raw: Column) -> DataFrame:
    squashed = F.when((raw > 1) | (raw < 0), 1.0 / (1.0 + F.exp(-raw))).otherwise(raw)
    scored = results.withColumn("vector_score", F.col("score")).withColumn(
        "text_score", F.bround(squashed, 6)
    ).withColumn("score", F.bround(0.3 * F.col("vector_score") + 0.7 * squashed, 6))
    return top_per(scored, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)


def admit(results: DataFrame, limit: int, tokens: str = "token_count") -> DataFrame:
    """Prefix of each query's ranking that fits the budget; stops at the first overflow.

    The running sum never falls, so comparing it with the limit is exactly that stop.  A
    query has at most ``TOP_K_MAX`` results, which bounds the window.
    """
    order = [F.col("score").desc(), F.col("year").desc_nulls_last(), F.col("chunk_id")]
    summed = running_total(results, ["query_id"], order, tokens, "_used", bounded=True)
    kept = summed.filter(F.col("_used") <= limit)
    return number_rows(kept, ["query_id"], order, "citation_id", bounded=True).drop("_used")


def assemble(results: DataFrame, budget: str = "SMALL") -> DataFrame:
    """Evidence blocks and citations per query, within the token budget."""
    unique = results.dropDuplicates(["query_id", "chunk_id"])
    kept = admit(unique, vocab.BUDGETS[budget])
    section = F.coalesce("section", F.lit("Unknown Section"))
    page = F.coalesce(F.col("start_page").cast("string"), F.lit("Unknown"))
    block = F.concat(
        F.lit('<evidence id="'), F.col("citation_id"), F.lit('" report_id="'), F.col("report_id"),
        F.lit('" page="'), page, F.lit('" section="'), section, F.lit('">\n'),
        text.strip(F.col("chunk_text")), F.lit("\n</evidence>"),
    )
    cite = F.struct(
        "citation_id", "chunk_id", "report_id", F.col("start_page").alias("page_number"),
        F.col("section").alias("section_name"),
        F.concat(text.strip(F.substring("chunk_text", 1, 120)), F.lit("...")).alias("preview"),
    )
    packed = kept.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("citation_id", block.alias("block")))).alias("_b"),
        F.array_sort(F.collect_list(cite)).alias("citations"),
    )
    body = F.array_join(F.transform("_b", lambda b: b["block"]), "\n\n")
    return packed.select("query_id", body.alias("context_text"), "citations").withColumn(
        "tokens_used", text.token_count(F.col("context_text"))
    ).withColumn("budget_limit", F.lit(vocab.BUDGETS[budget]))


# --- evaluation -----------------------------------------------------------------------------------
def judge(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Mark each result: by curated chunk ids, else by sections, else by report ids."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    relevant = (
        F.when(some("expected_chunk_ids"), F.array_contains("expected_chunk_ids", F.col("chunk_id")))
        .when(some("expected_sections"), F.array_contains("expected_sections", F.col("section")))
        .when(some("expected_report_ids"), F.array_contains("expected_report_ids", F.col("report_id")))
    )
    return results.join(truth, "query_id").withColumn("relevant", F.coalesce(relevant, F.lit(False)))


def total_relevant(truth: DataFrame, chunks: DataFrame) -> DataFrame:
    """How many stored chunks are relevant to each query (the recall denominator)."""
    pool = chunks.filter(F.col("embedding").isNotNull())
    by_section = pool.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    by_report = pool.groupBy("report_id").agg(F.count(F.lit(1)).alias("n"))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    ids, secs, reps = "expected_chunk_ids", "expected_sections", "expected_report_ids"
    curated = truth.filter(some(ids)).select("query_id", F.size(ids).cast("bigint").alias("total_relevant"))
    def summed(part: DataFrame, values: str, counts: DataFrame, key: str) -> DataFrame:
        return part.select("query_id", F.explode(F.array_distinct(values)).alias(key)).join(
            counts, key, "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_relevant"))

    return (
        curated
        .unionByName(summed(truth.filter(~some(ids) & some(secs)), secs, by_section, "section"))
        .unionByName(summed(truth.filter(~some(ids) & ~some(secs) & some(reps)), reps, by_report, "report_id"))
    )


def evaluate(judged: DataFrame, totals: DataFrame, k: int = vocab.TOP_K_DEFAULT) -> DataFrame:
    """Recall, precision, reciprocal rank, hit rate and nDCG of each query at ``k``.

    Precision divides by what was returned; the ideal ranking is over retrieved flags.
    """
    rel = F.col("relevant")
    inside = F.col("rank") <= k
    gain = F.bround(F.sum(F.when(rel & inside, 1.0 / F.log2(F.col("rank") + 1.0))), 9)
    per = judged.groupBy("query_id", "category").agg(
        F.count_if(inside).alias("returned"), F.count_if(rel & inside).alias("hits"),
        F.min(F.when(rel, F.col("rank"))).alias("first_hit"), gain.alias("dcg"),
    ).join(totals, "query_id", "left")
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.col("hits").cast("int")), F.lit(0.0),
        lambda a, i: a + 1.0 / F.log2(i + 1.0))
    hits, total = F.col("hits"), F.coalesce("total_relevant", F.lit(0))
    return per.select(
        "query_id", "category", "returned", total.alias("total_relevant"),
        F.bround(F.when(total > 0, hits / total).otherwise(F.lit(0.0)), 6).alias("recall"),
        F.bround(F.when(F.col("returned") > 0, hits / F.col("returned")).otherwise(F.lit(0.0)), 6).alias("precision"),
        F.bround(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)), 6).alias("mrr"),
        F.when(hits > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("hit_rate"),
        F.bround(F.when(hits > 0, F.col("dcg") / ideal).otherwise(F.lit(0.0)), 6).alias("ndcg"),
    )


def aggregate_run(per_query: DataFrame) -> DataFrame:
    """Means over all queries and per category in one pass (``is_total`` marks the former)."""
    mean = lambda c: F.bround(F.avg(F.col(c).cast("decimal(12,6)")).cast("double"), 6)
    return per_query.rollup("category").agg(
        F.grouping("category").cast("int").alias("is_total"), F.count(F.lit(1)).alias("num_queries"),
        mean("recall").alias("mean_recall"), mean("precision").alias("mean_precision"),
        mean("mrr").alias("mean_mrr"), mean("hit_rate").alias("hit_rate"), mean("ndcg").alias("mean_ndcg"),
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest run of each strategy."""
    cols = [c for c in runs.columns if c != "retrieval_type"]
    return runs.groupBy("retrieval_type").agg(F.max_by(F.struct(*cols), F.struct("ts", "run_id")).alias("_r")).select(
        "retrieval_type", "_r.*")


def compare_runs(runs: DataFrame, base: str = "vector", other: str = "hybrid") -> DataFrame:
    """Difference of the newest runs of two strategies, per measure."""
    measures = ["mean_recall", "mean_precision", "mean_mrr", "mean_ndcg"]
    latest = latest_runs(runs)
    pick = lambda kind, m: F.max(F.when(F.col("retrieval_type") == kind, F.col(m)))
    return latest.agg(*[F.bround(pick(other, m) - pick(base, m), 6).alias(f"delta_{m}") for m in measures])


def _strategy(name: str, top_k: int | None) -> tuple[tuple, int]:
    spec = vocab.STRATEGIES.get(name.upper(), vocab.STRATEGIES["GENERAL_ANALYSIS"])
    return spec, max(vocab.TOP_K_MIN, min(top_k or spec[2], vocab.TOP_K_MAX))


def _profiled(subs: DataFrame, pinned: list[str], profile: str) -> tuple[DataFrame, tuple[str, ...]]:
    """Requests with the sections of a profile asked for, and the filters to apply."""
    preferred, filters = vocab.PROFILES[profile], list(pinned)
    if preferred:
        wanted = F.array(*[F.lit(s) for s in preferred])
        if "section" in subs.columns:
            wanted = F.when(F.col("section").isNotNull(), F.array("section")).otherwise(wanted)
        subs = subs.withColumn("section", wanted)
        filters = [*dict.fromkeys([*filters, "section"])]
    return subs, tuple(filters)


def _merged(requests: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], spec: tuple) -> DataFrame:
    """What a strategy finds, before any reranking: the best score of each query and chunk."""
    rewrite, passage, depth, _, _, profile = spec
    q = F.col("query")
    base = requests.withColumn("_cls", classify_query(q)["query_class"])
    rewritten = rewrite_query(q, F.col("_cls")) if rewrite else q
    asked = F.array(hypothetical_passage(rewritten)) if passage else (sub_queries(q) if rewrite else F.array(q))
    pinned = [c for c in FILTERS if c in requests.columns]
    # what is asked, by its text and filters: many requests come to the same passage, which is embedded and searched once
    subs = base.select(F.col("query_id").cast("string").alias("_root"), F.explode(asked).alias("_text"), *pinned).withColumn(
        "_ask", F.sha2(F.to_json(F.struct("_text", *pinned)), 256))
    asks = subs.dropDuplicates(["_ask"]).select(F.col("_ask").alias("query_id"), *pinned, embed(F.col("_text")).alias("vector"))
    asks, filters = _profiled(asks, pinned, profile)
    found = knn(asks, chunks.withColumnRenamed("chunk_id", "vec_id"), depth, filters=filters)
    asked_by = subs.select(F.col("_root").alias("query_id"), "_ask").distinct()
    return cut_lineage(fuse(found.withColumnRenamed("query_id", "_ask").join(asked_by, "_ask").select(
        "query_id", F.col("vec_id").alias("chunk_id"), "score")))


def _ranked(
    merged: DataFrame, requests: DataFrame, chunks: DataFrame, k: int, reranked: bool, scorer: Callable[[Column, Column], Column]
) -> DataFrame:
    """The final list of each query."""
    asked_by = requests.select(F.col("query_id").cast("string").alias("query_id"), "query")
    if not reranked:
        return top_per(merged, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)
    if scorer is lexical_score:
        # word sets are built once per chunk and per query, not once per pair
        wanted = merged.select("chunk_id").distinct()
        chunk_words = chunks.join(wanted, "chunk_id", "left_semi").select(
            "chunk_id", text.word_set(F.col("chunk_text")).alias("_cw"))
        query_words = asked_by.select("query_id", text.word_set(F.col("query")).alias("_qw"))
        pairs = merged.join(chunk_words, "chunk_id").join(query_words, "query_id")
        return _rerank(pairs, k, lexical_set_score(F.col("_qw"), F.col("_cw"))).drop("_qw", "_cw")
    pairs = merged.join(chunks.select("chunk_id", "chunk_text"), "chunk_id").join(asked_by, "query_id")
    return rerank(pairs, k, scorer).drop("chunk_text", "query")


def retrieve_and_assemble(
    requests: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], *, strategy: str = "GENERAL_ANALYSIS",
    top_k: int | None = None, scorer: Callable[[Column, Column], Column] = lexical_score,
) -> tuple[DataFrame, DataFrame]:
    """Whole request table in one job: understand, search, fuse, rerank, assemble.

    Returns (context per query, ranked results).  ``chunks`` carry chunk_id, chunk_text,
    token_count, embedding, section, year, start_page and the filter columns.
    """
    spec, k = _strategy(strategy, top_k)
    merged = _merged(requests, chunks, embed, spec)
    ranked = _ranked(merged, requests, chunks, k, spec[3], scorer)
    # texts join the few rows that stay
    facts = chunks.select("chunk_id", "chunk_text", "token_count", "report_id", "section", "year", "start_page")
    detail = ranked.join(facts, "chunk_id")
    return assemble(detail, spec[4]), detail


def staged_results(
    requests: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], *, strategy: str = "GENERAL_ANALYSIS",
    top_k: int | None = None, scorer: Callable[[Column, Column], Column] = lexical_score,
) -> DataFrame:
    """The lists of a strategy by stage (see ``strategies``): plain search, all that was found, final order."""
    from ledgerlens.operators import strategies

    spec, k = _strategy(strategy, top_k)
    pinned = [c for c in FILTERS if c in requests.columns]
    plain, filters = _profiled(requests.withColumn("vector", embed(F.col("query"))), pinned, spec[5])
    first = knn(plain, chunks.withColumnRenamed("chunk_id", "vec_id"), k, filters=filters).withColumnRenamed("vec_id", "chunk_id")
    merged = _merged(requests, chunks, embed, spec)
    final = _ranked(merged, requests, chunks, k, spec[3], scorer)
    lists = [strategies.tagged(s, r) for s, r in zip(strategies.STAGES, (first, merged, final), strict=True)]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])
