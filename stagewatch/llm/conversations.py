"""Repair of a conversation's structure by Knuth's lightest derivation.

A repaired conversation is empty, or an optional system turn and then user and assistant
turns in alternation. Each row is kept, given another role, or deleted, and turns may be
inserted anywhere. The weight of a repair is ``(cost, audit)``: its edits' costs and their
initials in order, the smaller audit winning among equal costs.

The deductions form a weighted hypergraph. ``span(a, b, s, t)`` says: rows a to b take the
conversation from state s to state t.

* ``span(a, a, s, s)`` holds at no cost;
* ``span(a, b, s, t)`` and an edit of row b (or an insertion) give ``span(a, b', s, t')``;
* ``span(a, b, s, t)`` and ``span(b, c, t, r)`` give ``span(a, c, s, r)``;
* ``span(first, last, start, end)`` gives the goal where the end is a legal one.

Each conclusion weighs the sum of its antecedents' costs and their audits joined. That is superior
(never less than an antecedent) and monotone: of two repairs of the same rows with one cost neither
audit is a proper prefix of the other, since what it has more would be insertions, which cost.
So what the agenda pops first for an item is final.

Spans make the work divisible: rows are sorted over all partitions by conversation and turn, each
partition derives the spans of its stretch of a conversation, and the stretches (one, but for
conversations at a partition's border) are joined. No conversation has to fit into one task for that; only
a digest of a whole repaired conversation is sequential by its nature, and it is streamed.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty, stored

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ENDS = (START, ASSISTANT)
SPEAKS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # whose turn a state asks for
KEEPS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
CHUNK = 24          # rows that one agenda derives at a time
TIE = 64            # characters of a text that order rows of one turn and role before its hash does
SPACE = "concat(' ', char(9), char(10), char(11), char(12), char(13))"
ORDER = ["conv_id", "turn", "role", "head", "hash"]
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def lightest(axioms: dict, conclude, goal=None) -> dict:
    """Items and their lightest weights. ``axioms`` maps items to weights; ``conclude(item, weight, final)``
    gives the (weight, item) of the deductions that the newly final item completes. Ends with the
    ``goal``, or without one when the agenda is empty."""
    agenda = [(weight, item) for item, weight in axioms.items()]
    heapq.heapify(agenda)
    final: dict = {}
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        if item == goal:
            break
        for conclusion in conclude(item, weight, final):
            if conclusion[1] not in final:
                heapq.heappush(agenda, conclusion)
    return final


@lru_cache(maxsize=65536)
def _chunk(rows: tuple, sources: tuple) -> dict:
    """``(s, t) -> weight`` over ``rows`` of (initial, must go, cut off)."""

    def conclude(item, weight, final):
        at, s, t = item
        cost, audit = weight
        yield (cost + INSERT, audit + "I"), (at, s, SPEAKS[t])
        if at == len(rows):
            return
        initial, gone, cut_off = rows[at]
        yield (cost + DELETE, audit + "D"), (at + 1, s, t)
        if not gone:
            extra = CUT_OFF if cut_off else 0
            yield (cost + REROLE + extra, audit + "R"), (at + 1, s, SPEAKS[t])
            if (initial, t) in KEEPS:
                yield (cost + extra, audit + "K"), (at + 1, s, KEEPS[initial, t])

    final = lightest({(0, s, s): (0, "") for s in sources}, conclude)
    return {(s, t): w for (at, s, t), w in final.items() if at == len(rows)}


def _joined(left: dict, right: dict) -> dict:
    """Spans of two stretches, one after the other."""

    def conclude(item, weight, final):
        side, s, t = item
        for (other, a, b), w in list(final.items()):
            if side == 0 and other == 1 and a == t:
                yield (weight[0] + w[0], weight[1] + w[1]), (2, s, b)
            elif side == 1 and other == 0 and b == s:
                yield (w[0] + weight[0], w[1] + weight[1]), (2, a, t)

    axioms = {(0, *k): w for k, w in left.items()} | {(1, *k): w for k, w in right.items()}
    return {(s, t): w for (side, s, t), w in lightest(axioms, conclude).items() if side == 2}


def _spans(rows: list, sources: tuple) -> dict:
    tables = [_chunk(tuple(rows[i:i + CHUNK]), sources if i == 0 else STATES) for i in range(0, max(len(rows), 1), CHUNK)]
    while len(tables) > 1:
        tables = [_joined(*tables[i:i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0]


def _goal(stretches: list[dict]) -> tuple[int, str]:
    """The weight of a whole conversation from its stretches' spans, in order."""

    goal = (len(stretches) + 1, START)

    def conclude(item, weight, final):
        at, t = item
        if at < len(stretches):
            for (s, r), w in stretches[at].items():
                if s == t:
                    yield (weight[0] + w[0], weight[1] + w[1]), (at + 1, r)
        elif at == len(stretches) and t in ENDS:
            yield weight, goal

    return lightest({(0, START): (0, "")}, conclude, goal)[goal]


SEGMENT = ("conv_id {id}, part int, spans array<struct<s:int,t:int,cost:long,audit:string>>, rows long, blank long, duplicate long,"
           " truncated long, illegal long, first string, last string, first_turn long, last_turn long, turns long")


def _python_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _tables(rows: Iterator[dict], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    some: list[dict] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_pylist(some, schema)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def _runs(rows: Iterator[dict], key) -> Iterator[list[dict]]:
    run: list[dict] = []
    for row in rows:
        if run and key(row) != key(run[-1]):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def _segment(run: list[dict], first: bool) -> dict:
    """The spans and counts of one partition's stretch of a conversation; ``first``: it may have begun before."""
    rows: list[tuple] = []
    n = {"blank": 0, "duplicate": 0, "truncated": 0}
    illegal = turns = 0
    turn = None
    for r in run:
        for copy in range(r["copies"]):
            fault = ("blank" if r["tail"] == "" else "duplicate" if copy or r["again"]
                     else "truncated" if r["tail"] not in ".!?" else None)
            if fault:
                n[fault] += 1
            rows.append((r["role"][:1], fault in ("blank", "duplicate"), fault == "truncated"))
            illegal += len(rows) > 1 and rows[-2][0] + rows[-1][0] not in LEGAL
        if r["copies"] and r["turn"] is not None and r["turn"] != turn:
            turns, turn = turns + 1, r["turn"]
    numbered = [r["turn"] for r in run if r["copies"] and r["turn"] is not None]
    spans = _spans(rows, STATES if first else (START,))
    return {"conv_id": run[0]["conv_id"], "part": run[0]["part"], "rows": len(rows), **n, "illegal": illegal, "turns": turns,
            "spans": [{"s": s, "t": t, "cost": c, "audit": a} for (s, t), (c, a) in spans.items()],
            "first": rows[0][0] if rows else None, "last": rows[-1][0] if rows else None,
            "first_turn": numbered[0] if numbered else None, "last_turn": numbered[-1] if numbered else None}


def _whole(run: list[dict]) -> dict:
    """A conversation's counts and cheapest repair from its stretches."""
    out = {k: sum(r[k] for r in run) for k in ("blank", "duplicate", "truncated", "illegal")}
    some = [r for r in run if r["rows"]]
    out["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(some, some[1:]))
    timed = [r for r in some if r["turns"]]
    turns = sum(r["turns"] for r in timed) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
    out["gaps"] = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - turns if timed else 0
    out["cost"], out["audit"] = _goal([{(w["s"], w["t"]): (w["cost"], w["audit"]) for w in r["spans"]} for r in some])
    return {"conv_id": run[0]["conv_id"], **out}


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: conversations damaged row by row, by the CRC-32 of ``conv_id:turn``.

    Of twenty remainders one drops the row, one empties its text, one removes ``.!?`` from it,
    one repeats it and one makes it the user's; nulls stand as one space. ``copies`` is 0 for a
    dropped row, so that its conversation is not forgotten."""
    spaced = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat_ws(":", spaced("conv_id"), spaced("turn")), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    return rows.select(rows["conv_id"].alias("conv_id"), rows["turn"].cast("long").alias("turn"),
                       F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
                       F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _keyed(rows: DataFrame) -> DataFrame:
    """The rows with what orders them within a turn; rows that stand no time lose all but their conversation."""
    here = F.col("copies") > 0
    some = rows.select(rows["conv_id"], rows["turn"].cast("long").alias("turn"), F.coalesce(rows["role"], F.lit(" ")).alias("role"),
                       F.coalesce(rows["text"], F.lit(" ")).alias("text"), rows["copies"].cast("long").alias("copies"))
    return some.select("conv_id", F.when(here, F.col("turn")).alias("turn"), F.when(here, F.col("role")).otherwise("").alias("role"),
                       F.when(here, F.substring("text", 1, TIE)).otherwise("").alias("head"),
                       F.when(here, F.md5("text")).otherwise("").alias("hash"), "text", "copies")


def plan_repairs(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``: each conversation's faults and cheapest repair.

    ``rows`` hold ``conv_id, turn, role, text, copies``; other columns are ignored. A null role or text
    is one space; a null conv_id is a conversation like any other; null turns come first. Rows of one
    turn go by role, then by text (its first ``TIE`` characters, then its hash); repeated rows
    stand one after the other and are duplicates. Texts only count by their last character and hash
    here, however long. A conversation without rows left has zeros and an empty audit; no rows give none."""
    light = _keyed(rows)
    tail = F.expr(f"right(trim(both {SPACE} from text), 1)")
    light = light.select(*ORDER, F.when(F.col("copies") > 0, tail).otherwise("").alias("tail"), "copies")
    light = stored(light.groupBy(*ORDER, "tail").agg(F.sum("copies").alias("copies")), "turns")
    twice = (light.where("copies > 0 and tail != ''").groupBy("conv_id", "role", "hash")
             .agg(F.count("*").alias("n"), F.when(F.max(F.col("turn").isNull()), None).otherwise(F.min("turn")).alias("seen"))
             .where("n > 1").select(*[F.col(c).alias(f"__{c}") for c in ("conv_id", "role", "hash")], "seen", F.lit(True).alias("known")))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("conv_id", "role", "hash")]
    again = F.col("known").isNotNull() & ~F.col("turn").eqNullSafe(F.col("seen")) & (F.col("tail") != "")
    marked = light.join(twice, same[0] & same[1] & same[2], "left").select(*ORDER, "tail", "copies", again.alias("again"))
    ordered = marked.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(
        "conv_id", "turn", "role", "tail", "copies", "again", F.spark_partition_id().alias("part"))
    kind = light.schema["conv_id"].dataType.simpleString()
    schema = SEGMENT.format(id=kind)
    segment_schema = _arrow(light.sparkSession, schema)

    def segments(batches):
        runs = enumerate(_runs(_python_rows(batches), lambda r: r["conv_id"]))
        return _tables((_segment(run, i == 0) for i, run in runs), segment_schema)

    out_schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", cost long, audit string"
    whole_schema = _arrow(light.sparkSession, out_schema)

    def wholes(batches):
        return _tables(map(_whole, _runs(_python_rows(batches), lambda r: r["conv_id"])), whole_schema)

    parts = ordered.mapInArrow(segments, schema)
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(wholes, out_schema)


def _arrow(spark, schema) -> pa.Schema:
    return empty(spark, schema).toArrow().schema


def _edited(rows: Iterator[dict]) -> Iterator[tuple[dict, str, str, str]]:
    """(plan, edit, role, text) of each turn that a repair leaves, from plans that each precede their rows.
    A plan without turns comes once with an empty edit."""
    plan, letters, state, left = None, iter(()), START, 0

    def inserted(letter):
        nonlocal state
        state = SPEAKS[state]
        return plan, letter, "user" if state == USER else "assistant", ""

    def rest():
        for letter in letters:
            yield inserted(letter)

    for row in rows:
        if row["audit"] is not None:
            if plan is not None:
                yield from rest()
            plan, letters, state = row, iter(row["audit"]), START
            yield plan, "", "", ""
            continue
        for _ in range(row["copies"]):
            letter = next(letters)
            while letter == "I":
                yield inserted(letter)
                letter = next(letters)
            if letter == "D":
                continue
            if letter == "K":
                state = KEEPS[row["role"][:1], state]
                yield plan, letter, row["role"], row["text"]
            else:
                yield *inserted(letter)[:3], row["text"]
    if plan is not None:
        yield from rest()


def _with_plans(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan and then its rows, in order, in one partition's stream."""
    texts = _keyed(rows).where("copies > 0").withColumn("what", F.lit(1))
    plans = plans.withColumn("what", F.lit(0))
    both = plans.unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "what", *ORDER[1:]).select(
        "conv_id", *COUNTS, "cost", "audit", "role", "text", "copies")


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id, turn, edit, role, text``: the repaired conversations, turns numbered from 0; ``plans`` are
    those of ``plan_repairs`` for the same rows. Conversations without a turn left have no row."""
    kind = plans.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, turn long, edit string, role string, text string"
    out_schema = _arrow(rows.sparkSession, schema)

    def turns(batches):
        def each():
            at = 0
            for plan, edit, role, text in _edited(_python_rows(batches)):
                if not edit:
                    at = 0
                    continue
                yield {"conv_id": plan["conv_id"], "turn": at, "edit": edit, "role": role, "text": text}
                at += 1

        return _tables(each(), out_schema, 256)

    return _with_plans(rows, plans).mapInArrow(turns, schema)


def repair_digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The plans with ``repaired_sha256``: SHA-256 of the repaired ``role:text``, joined by newlines.

    A digest reads its conversation in order, so a conversation's texts pass through one task, as a
    stream: no more than a batch of them is held."""
    names = plans.columns
    schema = plans.withColumn("repaired_sha256", F.lit("")).schema
    out_schema = _arrow(rows.sparkSession, schema)

    def digests(batches):
        def each():
            plan, digest, some = None, hashlib.sha256(), False
            for owner, edit, role, text in _edited(_python_rows(batches)):
                if not edit:
                    if plan is not None:
                        yield {**{c: plan[c] for c in names}, "repaired_sha256": digest.hexdigest()}
                    plan, digest, some = owner, hashlib.sha256(), False
                    continue
                digest.update((("\n" if some else "") + role + ":").encode())
                digest.update(text.encode())
                some = True
            if plan is not None:
                yield {**{c: plan[c] for c in names}, "repaired_sha256": digest.hexdigest()}

        return _tables(each(), out_schema)

    return _with_plans(rows, plans).mapInArrow(digests, schema)
