"""Toxicity scores from a weighted finite-state grammar over clauses.

Four small transducers read the word classes of a clause side by side: negation (in reach
for ``NEGATION_REACH`` words), reported speech (to the clause's end), target (a person
addressed or named within ``TARGET_REACH`` words) and the emitter of insults and threats.
``compose`` builds their product once, over its reachable states.  Running it, every insult
or threat emits one event that says in which context it stood; the clause keeps its
gravest event, and a document is scored by how many clauses matched each event.

The insult class is a short list of seed words plus words and word beginnings learned from
labelled rows.  A document counts there with one over the number of training documents that
share its smallest shingle, so thousands of copies of one text weigh about as much as one.
The event weights are the maximum a posteriori fit of a logistic model around stated
priors, which also serve alone where no labels exist.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import map_rows, text_name, text_slices, unused
from ledgerlens.session import cut_lineage

# ---- fixed values: seed words of the grammar, in English, German, French and Spanish ----
INSULTS = """asshole bastard clown cretin disgusting dumb fool idiot imbecile jerk loser moron pathetic scum
stupid trash vermin worthless arschloch abschaum blödmann dummkopf idiotin trottel versager wichser abruti
connard crétin débile imbécile ordure salaud basura cabrón escoria estúpido gilipollas idiota imbécil""".split()
THREATS = """kill murder hurt stab shoot strangle destroy töten umbringen verprügeln erschießen tuer frapper
égorger poignarder matar golpear apuñalar disparar""".split()
TARGETS = """you your yours u he she they them him her his their du dich dir dein deine ihr euch sie er tu toi te vous
votre vos ils elles lui tú ti usted ustedes vosotros él ella ellos ellas""".split()
NEGATIONS = """not no never none neither nor cannot don't isn't aren't wasn't won't nicht kein keine keinen nie niemals
ne pas jamais aucun aucune ni nunca jamás ningún ninguna tampoco""".split()
REPORTS = """said says say saying told tells claimed claims wrote quoted called calls alleged reported according sagte sagt
sagten behauptet schrieb laut nannte dit disait déclaré écrit selon appelé dijo dice dicen afirmó escribió según llamó""".split()
# -----------------------------------------------------------------------------------------

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
END = 8  # added to a class: the word ends its clause
NEGATION_REACH, TARGET_REACH = 3, 4
# Events from gravest to mildest, with the prior mean of their weights.
EVENTS = ["targeted threat", "targeted insult", "insult", "threat", "reported", "negated"]
PRIOR = np.array([-4.0, 4.0, 5.0, 4.5, 1.0, 0.5, 0.5])
PRIOR_SPREAD = np.array([3.0, 2.0, 2.0, 2.0, 1.0, 1.0, 1.0])

FIT_ROWS = 20_000
PREFIXES = (3, 4, 5, 6, 7, 8)
PURITY, SURPRISE = 0.9, 16.0
CACHED_WORDS = 200_000
MARKS = ".,;:!?\"'()[]{}<>#*$%&|«»“”„‘’…–—-_/\\=+~`"
STOPS = frozenset(".;:!?")


# ---- the composed transducer ----------------------------------------------------------

def compose() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted event (-1: none) by state and word class; state 0 starts a clause.

    A state is (words negation still reaches, whether speech is reported, words a target
    still reaches).
    """
    states, todo = {(0, False, 0): 0}, [(0, False, 0)]
    step, emit = [], []
    while todo:
        negated, reported, near = todo.pop(0)
        row, out = [], []
        for kind in range(6):
            nxt = (
                NEGATION_REACH if kind == NEGATION else max(negated - 1, 0),
                reported or kind == REPORT,
                TARGET_REACH if kind == TARGET else max(near - 1, 0),
            )
            event = -1
            if kind in (INSULT, THREAT):
                if negated:
                    event = 5
                elif reported:
                    event = 4
                elif kind == THREAT:
                    event = 0 if near else 3
                else:
                    event = 1 if near else 2
            if nxt not in states:
                states[nxt] = len(states)
                todo.append(nxt)
            row.append(states[nxt])
            out.append(event)
        step.append(row)
        emit.append(out)
    return np.array(step), np.array(emit)


class Grammar:
    """Lexicon and composed transducer, as sent to the tasks."""

    def __init__(self, terms: list[str]) -> None:
        self.words = {w: kind for kind, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, INSULTS)) for w in ws}
        self.words |= {t[1:]: INSULT for t in terms if t[0] == "="}
        self.stems = frozenset(t[1:] for t in terms if t[0] == "^")
        self.step, self.emit = (x.tolist() for x in compose())

    def kind(self, raw: str) -> int:
        word = raw.strip(MARKS)
        kind = self.words.get(word)
        if kind is None:
            kind = INSULT if any(word[:n] in self.stems for n in PREFIXES if len(word) > n) else OTHER
        return kind + END * (raw[-1:] in STOPS)

    def events(self, kinds: np.ndarray) -> np.ndarray:
        """How many clauses of a text have each event as their gravest."""
        found = np.zeros(len(EVENTS), np.int64)
        hits = np.flatnonzero((kinds & 7 == INSULT) | (kinds & 7 == THREAT))
        if not len(hits):
            return found
        ends = np.flatnonzero(kinds >= END)
        clause = np.searchsorted(ends, hits)  # clause k runs to ends[k]
        for k in np.unique(clause).tolist():
            start = int(ends[k - 1]) + 1 if k else 0
            stop = int(ends[k]) + 1 if k < len(ends) else len(kinds)
            state, gravest = 0, -1
            for c in (kinds[start:stop] & 7).tolist():
                event = self.emit[state][c]
                if event >= 0 and (gravest < 0 or event < gravest):
                    gravest = event
                state = self.step[state][c]
            if gravest >= 0:
                found[gravest] += 1
        return found


class _Kinds(dict):
    def __init__(self, grammar: Grammar) -> None:
        super().__init__()
        self.grammar = grammar

    def __missing__(self, raw: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[raw] = kind = self.grammar.kind(raw)
        return kind


# ---- learning -------------------------------------------------------------------------

def in_training(doc_id: Column) -> Column:
    """True for the two thirds of documents whose labels may be learned from."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Text and label of at most about ``rows`` labelled training documents, chosen by a hash of the id.

    Of rows that share an id one counts, that with the least hash of its text; so rows are
    bounded, not only ids.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(in_training(F.col("doc_id"))).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    # bounded by ``rows``, so every task may hold it
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _shared_key(words: list[str]) -> int:
    import xxhash

    return min((xxhash.xxh64_intdigest(" ".join(words[i:i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1


def learn_terms(train: DataFrame) -> list[str]:
    """All words (``=word``) and beginnings (``^begin``) that almost only toxic training texts hold.

    The training rows bound their number.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            made = [_shared_key(t.decode("utf-8", "replace").lower().split()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.int64())], names=["text", "toxic", "key"])

    keyed = cut_lineage(train.mapInArrow(keys, "text string, toxic int, key long"))
    share = keyed.groupBy("key").agg((1 / F.count(F.lit(1))).alias("weight"))
    weighted = keyed.join(share, "key").select("text", "toxic", "weight")
    base = weighted.agg((F.sum(F.col("weight") * F.col("toxic")) + 1) / (F.sum("weight") + 10)).first()[0]
    if base is None:
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = defaultdict(float), defaultdict(float)  # the training rows are bounded, and so are their words
        for batch, texts in text_slices(batches):
            for raw, toxic, weight in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = {w.strip(MARKS) for w in raw.decode("utf-8", "replace").lower().split()}
                terms = {"=" + w for w in words if w} | {"^" + w[:n] for w in words for n in PREFIXES if len(w) > n}
                held = bad if toxic else good
                for t in terms:
                    held[t] += weight
        terms = list(bad.keys() | good.keys())
        for at in range(0, len(terms), 50_000):
            some = terms[at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.string()), pa.array([bad.get(t, 0.0) for t in some]), pa.array([good.get(t, 0.0) for t in some])],
                names=["term", "bad", "good"])

    counts = weighted.mapInArrow(count, "term string, bad double, good double").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    pure = counts.filter((F.col("bad") * float(log(1 / base)) >= SURPRISE) & (F.col("bad") >= PURITY * (F.col("bad") + F.col("good"))))
    return [r["term"] for r in pure.orderBy(F.desc("bad"), "term").collect()]


def fit_weights(groups: list[tuple[tuple[int, ...], float, float]]) -> np.ndarray:
    """Intercept and event weights.  ``groups``: event counts, number of toxic and of other rows."""
    w = PRIOR.copy()
    if not groups:
        return w
    x = np.array([[1.0, *np.log2(1 + np.minimum(np.array(g[0], float), 7))] for g in groups])
    bad, good = np.array([g[1] for g in groups]), np.array([g[2] for g in groups])
    precision = np.diag(1 / PRIOR_SPREAD**2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (bad - (bad + good) * p) - precision @ (w - PRIOR)
        curve = (x * ((bad + good) * p * (1 - p))[:, None]).T @ x + precision
        move = np.linalg.solve(curve, slope)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    # a matched clause never speaks against toxicity, and no text is called toxic without one
    return np.concatenate((np.minimum(w[:1], -1), np.maximum(w[1:], 0)))


def clause_events(docs: DataFrame, grammar: Grammar, name: str = "_events") -> DataFrame:
    """``docs`` with the column ``name``: per document, how many clauses matched each event."""
    sent = docs.sparkSession.sparkContext.broadcast(grammar)
    column = text_name(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        kinds = _Kinds(known)
        for batch, texts in text_slices(batches, column):
            made = []
            for raw in texts:
                words = raw.decode("utf-8", "replace").lower().split()
                made.append(known.events(np.fromiter(map(kinds.__getitem__, words), np.int8, len(words))).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int64()))], names=[*batch.schema.names, "events"])

    return map_rows(docs, run, [T.StructField(name, T.ArrayType(T.LongType()))])


class Model:
    def __init__(self, grammar: Grammar, weights: np.ndarray) -> None:
        self.grammar, self.weights = grammar, weights

    def score(self, events: Column) -> Column:
        total = F.lit(float(self.weights[0]))
        for k, w in enumerate(self.weights[1:].tolist()):
            total = total + F.lit(w) * F.log2(1 + F.least(events[k], F.lit(7)).cast("double"))
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS) -> Model:
    """Learn lexicon and weights from the labels of training documents."""
    train = cut_lineage(training_rows(docs, labels, rows))
    grammar = Grammar(learn_terms(train))
    seen = clause_events(train, grammar).select(
        "toxic", F.transform("_events", lambda n: F.least(n, F.lit(7))).alias("events"))
    groups = seen.groupBy("events").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).collect()
    return Model(grammar, fit_weights([(tuple(r["events"]), float(r["bad"]), float(r["good"])) for r in groups]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS, threshold: float = 0.7) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and the number of matched ``clauses``.

    A NULL or empty text matches no clause and gets the score of a text without any.  A
    NULL id is not held out.  Repeated rows are scored each.  Without labels the priors of
    the grammar score alone.
    """
    model = fit(docs, labels, rows=rows)
    found = clause_events(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), model.grammar)
    score = model.score(F.col("_events"))
    return found.select(
        "doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score"),
        (score >= threshold).cast("int").alias("predicted"),
        F.aggregate("_events", F.lit(0).cast("long"), lambda a, b: a + b).alias("clauses"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, in one pass over them after the fit; all their columns."""
    model = fit(docs, labels, rows=rows)
    name, = unused(docs, "_events")
    return clause_events(docs, model.grammar, name).filter(model.score(F.col(name)) < threshold).drop(name)
