"""Cheapest repair of conversations, by depth-first branch and bound.

Each row is kept, given another role or deleted, and empty rows are put in, until the role
initials read ``(s?(ua)+)?``.  A search node is (row, state): how many rows are decided, and
what the last kept row was (nothing yet, s, u, a).  The search keeps

* an explicit stack, the cheapest branch on top;
* a lower bound for every suffix and state, from the same problem with free insertions;
* an incumbent (cost, audit) for every state the rows may end in, which cuts what cannot beat it;
* a dominance table: the least (cost, audit) that reached a node; a worse prefix is dropped,
  for both can go on the same ways.

When the stack is empty the incumbents are proved best.  Two prefixes of equal cost at one
node are never beginnings of one another (the longer would have paid for an insertion
more), so what is added later cannot turn their order round.

A conversation is searched in blocks of ``BLOCK`` rows, for the effort grows steeply with them.  From one to the next go at most four
states with their cost, the place of their audit among the four, and the running SHA-256 of
what they keep, so a task holds one block of texts, however long the conversation.  The
rows of one conversation do go through one task, in order: the hash of the repaired whole
cannot be put together from hashes of pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import per_worker

BLOCK = 16
REMEMBERED = 50_000
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
MUST_GO = "-"
PAIRS = {"su", "ua", "au"}


# ---- the rows ---------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``dropped``: every row as the damage rule leaves it.

    The rule is the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops, 1 empties the text, 2
    takes its sentence ends, 3 repeats the row, 4 makes it the user's.  NULLs are one space.
    Dropped rows stay as marks without text, so that no conversation is forgotten.
    """
    space = F.lit(" ")
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("long").cast("string"), space) for c in ("conv_id", "turn")])
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"), (F.crc32(named.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def fault(role: str, text: bytes, seen: bool) -> str:
    """First fault of a row: blank, duplicate, truncated or none ('')."""
    body = text.strip()  # of the six ASCII white space characters
    return "blank" if not body else "duplicate" if seen else "" if body[-1:] in (b".", b"!", b"?") else "truncated"


def code(role: str, found: str) -> str:
    """One character per row: ``-`` must go, else the role's initial (o: any other), upper case if truncated."""
    if found in ("blank", "duplicate"):
        return MUST_GO
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if found else initial


# ---- the search -------------------------------------------------------------------------

class Reached(NamedTuple):
    """Least way to a state: total cost, place of the entry's audit, audit since, and the entry."""

    cost: int
    place: int
    audit: str
    entry: int


def _next(state: int) -> int:
    """Where a user or assistant that fits leads."""
    return ASSISTANT if state == USER else USER


def moves(row: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of what can be done with a row."""
    out = [("D", DELETE, state)]
    if row != MUST_GO:
        role, extra = row.lower(), TRUNCATED if row.isupper() else 0
        if role == "s" and state == START:
            out.append(("K", extra, SYSTEM))
        if role == "ua"[_next(state) == ASSISTANT]:
            out.append(("K", extra, _next(state)))
        out.append(("R", REROLE + extra, _next(state)))
    return out


MOVES = {(r, q): sorted(moves(r, q), key=lambda m: -m[1]) for r in "-suaoSUAO" for q in STATES}
# States that can follow each.
AHEAD = {START: {*STATES}, SYSTEM: {SYSTEM, USER, ASSISTANT}, USER: {USER, ASSISTANT}, ASSISTANT: {USER, ASSISTANT}}
# The same with any number of insertions for nothing: what a role asks of the state is always met but for START.
FREE = {
    (r, q): [(min(c for _, c, _ in [m for p in reach for m in moves(r, p) if m[2] == to]), to)
             for reach in [(q, USER, ASSISTANT)] for to in STATES if any(m[2] == to for p in reach for m in moves(r, p))]
    for r in "-suaoSUAO" for q in STATES
}


def suffix_bounds(rows: str) -> list[tuple[int, ...]]:
    """For each number of decided rows and each state, no repair of the rest costs less."""
    ends = [0, 0, 0, 0]
    out = [tuple(ends)]
    for r in reversed(rows):
        ends = [min(c + ends[to] for c, to in FREE[r, q]) for q in STATES]
        out.append(tuple(ends))
    return out[::-1]


def search(rows: str, entries: dict[int, tuple[int, int]], last: bool) -> dict[int, Reached]:
    """Least (cost, audit) from the entries, state to (cost, place), to each state after all rows.

    After the ``last`` block only START and ASSISTANT count, and rows may be put in at the end.
    """
    n, bounds = len(rows), suffix_bounds(rows)
    goals = {START, ASSISTANT} if last else {*STATES}
    if START not in entries:
        goals.discard(START)
        if SYSTEM not in entries:
            goals.discard(SYSTEM)
    elif SYSTEM not in entries and "s" not in rows.lower():
        goals.discard(SYSTEM)
    ahead = {q: tuple(to & goals) for q, to in AHEAD.items()}
    best: dict[int, Reached] = {}
    table: dict[tuple[int, int], tuple[int, int, str]] = {}
    # depth first, the cheapest entry on top
    stack = sorted(((0, q, Reached(c, place, "", q)) for q, (c, place) in entries.items()), key=lambda x: (-x[2].cost, -x[2].place))
    while stack:
        i, q, way = stack.pop()
        cost, place, audit, entry = way
        if (i, q) in table and table[i, q] <= way[:3]:
            continue
        table[i, q] = way[:3]
        least = cost + bounds[i][q]
        if all((b := best.get(g)) is not None and (least > b.cost or least == b.cost and (place, audit) > (b.place, b.audit[:len(audit)]))
               for g in ahead[q]):
            continue
        if i == n and q in goals and (q not in best or way[:3] < best[q][:3]):
            best[q] = way
        # more than the two rows between any two states are never worth their price
        if (i < n or last) and not audit.endswith("II"):
            stack.append((i, _next(q), Reached(cost + INSERT, place, audit + "I", entry)))
        if i < n:
            for edit, price, to in MOVES[rows[i], q]:
                stack.append((i + 1, to, Reached(cost + price, place, audit + edit, entry)))
    return best


def _kept(ways: list[tuple[str, str]], audit: str, state: int) -> tuple[list[tuple[str, str]], int]:
    """The rows an audit makes of these, and the state after."""
    out, i = [], 0
    for edit in audit:
        role, text = ways[i] if edit != "I" else ("", "")
        i += edit != "I"
        if edit == "D":
            continue
        state = SYSTEM if edit == "K" and state == START and role.startswith("s") else _next(state)
        out.append((role if edit == "K" else ROLES[state], text))
    return out, state


class Repair:
    """One conversation, row by row in order."""

    def __init__(self, known: dict[str, Reached], texts: bool) -> None:
        self.known, self.texts = known, texts
        self.codes: list[str] = []
        self.rows: list[tuple[str, str]] = []
        self.front: dict[int, tuple[int, int]] = {START: (0, 0)}
        self.hashes = {START: hashlib.sha256()}
        self.trail: list[dict[int, Reached]] = []
        self.kept: dict[int, tuple] = {START: ()}
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal = self.turns = 0
        self.first = self.turn = self.initial = None

    def add(self, turn: int | None, role: str, text: bytes, seen: bool) -> None:
        if len(self.codes) == BLOCK:
            self._block(False)
        found = fault(role, text, seen)
        self.counts[found] += 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in PAIRS
        self.initial = role[:1]
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        self.codes.append(code(role, found))
        self.rows.append((role, text.decode("utf-8", "replace") if self.codes[-1] != MUST_GO else ""))

    def _block(self, last: bool) -> None:
        rows = "".join(self.codes)
        if last and not self.trail:
            if rows not in self.known:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                found = search(rows, self.front, True)
                self.known[rows] = min(((w[:3], q) for q, w in found.items()))[1], found
            end, found = self.known[rows]
            found = {end: found[end]}
        else:
            found = search(rows, self.front, last)
            if last:
                end = min((w[:3], q) for q, w in found.items())[1]
                found = {end: found[end]}
            else:  # after ASSISTANT all goes on as after START, but for an s row, and as after SYSTEM
                most = found[ASSISTANT].cost
                found = {q: w for q, w in found.items() if w.cost <= most + (DELETE if q == START else INSERT if q == USER else 0)}
        hashes, kept = {}, {}
        for q, way in found.items():
            out, _ = _kept(self.rows, way.audit, way.entry)
            text = "\n".join(f"{role}:{text}" for role, text in out)
            hashes[q] = self.hashes[way.entry].copy()
            hashes[q].update(("\n" + text if way.entry != START and out else text).encode())
            kept[q] = (self.kept[way.entry], out) if self.texts else ()
        order = sorted(found, key=lambda q: found[q][1:3])
        self.front = {q: (found[q].cost, place) for place, q in enumerate(order)}
        self.hashes, self.kept, self.codes, self.rows = hashes, kept, [], []
        self.trail.append(found)

    def done(self) -> dict:
        self._block(True)
        (end, (cost, _)), = self.front.items()
        audit, q = [], end
        for found in reversed(self.trail):
            audit.append(found[q].audit)
            q = found[q].entry
        out = {
            "gaps": 0 if self.first is None else self.turn - self.first + 1 - self.turns, **{k: n for k, n in self.counts.items() if k}, "illegal": self.illegal,
            "cost": cost, "audit": "".join(reversed(audit)), "repaired_sha256": self.hashes[end].hexdigest()}
        if self.texts:
            chain, blocks = self.kept[end], []
            while chain:
                chain, block = chain
                blocks.append(block)
            out["repaired"] = [{"role": r, "text": t} for block in reversed(blocks) for r, t in block]
        return out


def repair(rows: DataFrame, *, texts: bool = False) -> DataFrame:
    """One row per ``conv_id`` of ``rows`` (as ``damaged`` gives them): faults, ``cost``, ``audit`` and hash of the cheapest repair.

    ``texts`` adds ``repaired``, the repaired rows.  Rows are taken by turn, NULLs first; rows
    of one turn by role and text.  A NULL id is a conversation of its own.  One whose rows all
    are dropped has zeros, an empty audit and the hash of nothing.  An empty table gives none.
    """
    same = Window.partitionBy("conv_id", "role", "text", "dropped").orderBy(F.asc_nulls_first("turn"))
    # one shuffle: what repeats within a conversation is numbered where the conversation lies
    seen = rows.repartition("conv_id").withColumn("seen", F.row_number().over(same) > 1)
    ordered = seen.select("conv_id", "turn", "role", "text", "dropped", "seen").sortWithinPartitions(
        "conv_id", F.asc_nulls_first("turn"), "role", "text")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    if texts:
        names.append("repaired")
        kinds.append(pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
        schema += ", repaired array<struct<role: string, text: string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker("conversation repair", dict)
        at, now, made = None, None, []

        def some() -> pa.RecordBatch:
            arrays = [pa.array([i for i, _ in made], pa.int64()), *[pa.array([m[n] for _, m in made], k) for n, k in zip(names, kinds, strict=True)]]
            made.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *names])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 2)]
            bodies = batch.column(3).cast(pa.binary())
            for k, (conv, turn, role, dropped, was) in enumerate(zip(*columns, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                if now is None or conv != at:
                    if now is not None:
                        made.append((at, now.done()))
                    at, now = conv, Repair(known, texts)
                if not dropped:
                    now.add(turn, role, bodies[k].as_py(), was)
            if made:
                yield some()
        if now is not None:
            made.append((at, now.done()))
            yield some()

    return ordered.mapInArrow(run, schema)
