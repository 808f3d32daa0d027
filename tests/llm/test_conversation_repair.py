import hashlib
import random
import re
import zlib
from itertools import product

from ledgerlens.llm import conversation_repair as repair
from ledgerlens.llm.queries import QUERIES

GOOD = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\r\x0b\x0c"


def all_edits(codes):
    """(cost, audit) of every way with at most two insertions at a place."""
    for gaps in product(range(3), repeat=len(codes) + 1):
        for edits in product(("D", "K", "Ru", "Ra"), repeat=len(codes)):
            for fills in product("ua", repeat=sum(gaps)):
                roles, audit, cost, filled, right = "", "", 0, iter(fills), True
                for k, n in enumerate(gaps):
                    roles += "".join(next(filled) for _ in range(n))
                    audit, cost = audit + "I" * n, cost + 2 * n
                    if k < len(codes):
                        c, e = codes[k], edits[k]
                        right &= e == "D" or c != "-"
                        audit += e[0]
                        cost += 3 if e == "D" else (2 if e[0] == "R" else 0) + c.isupper()
                        roles += "" if e == "D" else e[1] if e[0] == "R" else c.lower()
                if right and GOOD.fullmatch(roles):
                    yield cost, audit


def table_of_prefixes(codes):
    """Least (cost, audit) by filling the whole table of rows and states."""
    step = {0: "u", 1: "u", 2: "a", 3: "u"}
    to = {"s": 1, "u": 2, "a": 3}
    now = {0: (0, "")}

    def inserted(now):
        now = dict(now)
        for _ in range(3):
            for q, (c, a) in list(now.items()):
                p = to[step[q]]
                now[p] = min(now.get(p, (1 << 60, "")), (c + 2, a + "I"))
        return now

    for code in codes:
        new = {}
        for q, (c, a) in inserted(now).items():
            ways = [(q, 3, "D")]
            if code != "-":
                late = code.isupper()
                if code.lower() == step[q] or code.lower() == "s" and q == 0:
                    ways.append((to[code.lower()], late, "K"))
                ways.append((to[step[q]], 2 + late, "R"))
            for p, price, edit in ways:
                new[p] = min(new.get(p, (1 << 60, "")), (c + price, a + edit))
        now = new
    now = inserted(now)
    return min(now[q] for q in (0, 3) if q in now)


def searched(codes):
    one = repair.Repair({}, False)
    for c in codes:
        role = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "-": "user"}[c.lower()]
        one.add(None, role, b"" if c == "-" else b"x" if c.isupper() else b"x.", False)
    out = one.done()
    return out["cost"], out["audit"]


def test_search_finds_the_least_of_all_edits():
    alphabet = "-suaoSUAO"
    for n in (0, 1, 2):
        for codes in product(alphabet, repeat=n):
            assert searched(codes) == min(all_edits(codes)), codes


def test_search_equals_a_full_table():
    rng = random.Random(12)
    for _ in range(1500):
        codes = "".join(rng.choice("-suaoSUAOuauaua") for _ in range(rng.randrange(12)))
        assert searched(codes) == table_of_prefixes(codes), codes


def test_blocks_join_without_a_seam():
    rng = random.Random(13)
    for n in (15, 16, 17, 32, 33, 49, 200):
        for alphabet in ("-suaoSUAO", "ua", "uaUA", "uuua", "s", "o", "-", "sa"):
            codes = "".join(rng.choice(alphabet) for _ in range(n))
            assert searched(codes) == table_of_prefixes(codes), (n, alphabet)


def test_bounds_never_exceed_the_cost():
    rng = random.Random(14)
    for _ in range(300):
        codes = "".join(rng.choice("-suaoSUAO") for _ in range(rng.randrange(9)))
        assert repair.suffix_bounds(codes)[0][0] <= table_of_prefixes(codes)[0]


def by_hand(rows):
    """All result columns from (conv_id, turn, role, text) rows, in plain Python."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            body = text.strip(WHITE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        codes = ["-" if f in ("blank", "duplicate") else c.upper() if f else c
                 for f, c in zip(faults, [i if i in ("s", "u", "a") else "o" for i in initials], strict=True)]
        cost, audit = table_of_prefixes(codes)
        made, rest = [], iter(own)
        for e in audit:
            row = next(rest) if e != "I" else None
            if e != "D":
                made.append((e, row))
        texts = []
        for k, (e, row) in enumerate(made):
            role = "user" if (len(made) - k) % 2 == 0 else "assistant"
            texts.append(f"{row[1]}:{row[2]}" if e == "K" else f"{role}:{row[2] if row else ''}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


def found(df):
    return {r[0]: tuple(r)[1:9] for r in df.collect()}


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op12_conversation_repair"](spark, sf)) == by_hand(rows)


def odd_rows():
    rng = random.Random(15)
    texts = ["Yes.", "No", "", None, " \n", "Really?", "é!", "x" * 100_000 + ".", " ", "a. "]
    roles = ["user", "assistant", "system", None, "", "tool", "unknown", "Å"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randrange(1, 9))]
    rows += [(1000, t, "user" if t % 2 else "assistant", f"turn {t % 40}.") for t in range(700)]  # over many blocks, rows repeat
    return rows + [(2000, t, "user", "same.") for t in [5] * 300]


def test_odd_rows(spark):
    rows = odd_rows()
    full = [(*r, "x", 1) for r in rows]
    conversations = spark.createDataFrame(full, "conv_id long, turn long, role string, text string, seen string, dropped int")
    want = by_hand(rows)
    damaged = repair.damaged(conversations)
    assert found(repair.repair(damaged)) == want
    with_texts = repair.repair(damaged, texts=True).collect()
    for r in with_texts:
        assert hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in r["repaired"]).encode()).hexdigest() == r["repaired_sha256"] == want[r["conv_id"]][-1]
    assert repair.repair(repair.damaged(conversations.limit(0))).count() == 0


def test_conversation_without_rows_is_told(spark):
    lost = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(*lost, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert found(repair.repair(repair.damaged(df))) == {lost[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
