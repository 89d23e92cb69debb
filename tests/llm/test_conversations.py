import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SF_CHECK
from pyspark.sql import functions as F
from stagewatch.llm import conversations as C
from stagewatch.llm import queries
from stagewatch.sources.tables import read_table

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    """conv_id -> its rows after damage, in order, by the rules alone."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if c is None else c for c in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    tie = lambda text: (text[:C.TIE], hashlib.md5(text.encode()).hexdigest())
    return {c: sorted(r, key=lambda r: (r[0] is not None, r[0] or 0, r[1], tie(r[2]))) for c, r in out.items()}


def faults(rows):
    seen, marks = set(), []
    for _, role, text in rows:
        end = text.strip(BLANKS)[-1:]
        marks.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    return marks


def cheapest(rows, marks):
    """(cost, audit, turns) by a programme over the last role's initial, whole audits kept."""

    def inserted(best):
        for last, (cost, audit, out) in sorted(best.items(), key=lambda kv: kv[1][:2]) * 2:
            cost, audit, out = best[last]
            role = "assistant" if last == "u" else "user"
            new = (cost + 2, audit + "I", out + [role + ":"])
            if role[0] not in best or new[:2] < best[role[0]][:2]:
                best[role[0]] = new
        return best

    best = inserted({"": (0, "", [])})
    for (_, role, text), mark in zip(rows, marks):
        options = defaultdict(list)
        for last, (cost, audit, out) in best.items():
            options[last].append((cost + 3, audit + "D", out))
            if mark not in ("blank", "duplicate"):
                extra = mark == "truncated"
                other = "assistant" if last == "u" else "user"
                options[other[0]].append((cost + 2 + extra, audit + "R", out + [f"{other}:{text}"]))
                if role[:1] == other[0] or (role[:1] == "s" and last == ""):
                    options[role[0]].append((cost + extra, audit + "K", out + [f"{role}:{text}"]))
        best = inserted({k: min(v, key=lambda o: o[:2]) for k, v in options.items()})
    return min((best[k] for k in ("", "a") if k in best), key=lambda o: o[:2])


def expected(rows):
    out = {}
    for conv, some in damaged(rows).items():
        marks = faults(some)
        n, turns = Counter(marks), {t for t, _, _ in some if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
        cost, audit, turns_out = cheapest(some, marks)
        out[conv] = (conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(turns_out).encode()).hexdigest())
    return out


def check(df, rows):
    bad = C.damage(df)
    plans = C.plan_repairs(bad)
    got = {r["conv_id"]: tuple(r) for r in C.repair_digests(bad, plans).collect()}
    want = expected(rows)
    assert {k: v for k, v in got.items() if want.get(k) != v} == {} and got.keys() == want.keys()
    return bad, plans, want


def odd_rows():
    rng = random.Random(3)
    texts = [None, "", " ", "\t\n", "Hi.", "Hi", "Hi. \n", "why?", "Hi!\r", "x\x0b", "long " * 20_000 + "end.", "Ünïcode 😀.", " "]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User", "usher"]
    rows = [(c, rng.choice([None, *range(-3, 9)]), rng.choice(roles), rng.choice(texts)) for c in range(400) for _ in range(rng.randrange(1, 9))]
    rows += [(None, t, rng.choice(roles[:4]), "No id.") for t in (0, 1, 2, None)]
    rows += [(1000, 1, "user", "The same.")] * 50 + [(1000, 2, "user", "The same.")] * 30
    rows += [(1001, t, roles[t % 2], f"Turn {t}.") for t in range(500)]
    rows += [(1002, t, rng.choice(roles[:3]), rng.choice(["a.", "b", "c!", f"{t}."])) for t in range(300)]
    rows += [(1003, 5, "user", "z" * 70 + e) for e in (".", "!", "?")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as audit", "1 as copies", "'y' as hash", "2 as part")
    return rows, df


def test_awkward_conversations(odd):
    rows, df = odd
    bad, plans, want = check(df, rows)
    turns = defaultdict(list)
    for r in sorted(C.repaired_turns(bad, plans).collect(), key=lambda r: (str(r["conv_id"]), r["turn"])):
        assert r["turn"] == len(turns[r["conv_id"]])
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}
    for c, some in turns.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in some)), c


def test_conversations_over_many_partitions(spark, odd):
    """Stretches of one conversation in different partitions join to the same repair."""
    rows, df = odd
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        check(df.where("conv_id >= 1000"), [r for r in rows if r[0] is not None and r[0] >= 1000])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_table(spark):
    rows = [tuple(r) for r in read_table(spark, SF_CHECK, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r) for r in queries.op11_conversation_repair(spark, SF_CHECK).collect()}
    assert got == expected(rows)


def test_no_conversations(spark):
    assert C.plan_repairs(C.damage(spark.createDataFrame([], SCHEMA))).collect() == []
    only = C.damage(spark.createDataFrame([(1, 1, "user", "Hi.")], SCHEMA)).withColumn("copies", F.lit(0))
    row = C.repair_digests(only, C.plan_repairs(only)).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def _all_repairs(rows):
    """Every audit with at most one insertion before each row and two at the end, by enumeration."""
    best = None
    for edits in itertools.product(*[["D"] if r[1] else ["D", "K", "R"] for r in rows]):
        for gaps in itertools.product([0, 1], repeat=len(rows)):
            for end in (0, 1, 2):
                audit = "".join("I" * g + e for g, e in zip(gaps, edits)) + "I" * end
                cost, state, at, ok = 0, C.START, 0, True
                for e in audit:
                    if e == "I":
                        cost, state = cost + 2, C.SPEAKS[state]
                        continue
                    initial, _, cut = rows[at]
                    at += 1
                    cost += {"D": 3, "R": 2 + cut, "K": int(cut)}[e]
                    if e == "R":
                        state = C.SPEAKS[state]
                    if e == "K":
                        state = C.KEEPS.get((initial, state))
                    if state is None:
                        ok = False
                        break
                if ok and state in C.ENDS and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def test_against_all_repairs():
    rng = random.Random(8)
    for _ in range(60):
        rows = tuple((rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(0, 5)))
        assert C._goal([C._spans(list(rows), (C.START,))]) == _all_repairs(rows)
        cut = rng.randrange(len(rows) + 1)
        assert C._goal([C._spans(list(rows[:cut]), C.STATES), C._spans(list(rows[cut:]), C.STATES)]) == _all_repairs(rows)
