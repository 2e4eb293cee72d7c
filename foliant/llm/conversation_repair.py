"""Conversations brought into the form `(s?(ua)+)?` of role initials by the cheapest edits.

Faults: each row's first counts. Blank: no character besides blanks. Duplicate: role and text seen earlier in the conversation. Truncated: the last character that is no blank is not one of
`.!?`. Edits: Keep costs 0; Rerole (to user or assistant) 2; Delete 3, which blank and duplicate rows must take; Insert an empty user or assistant turn anywhere 2; a truncated row that stays adds 1.

By dynamic programming: the grammar is an automaton of four states, each of which has one role that can be made up, so an edit's initial settles the role as well. From the last
turn back, the least cost to go is worked out for each state, and with it the ASCII-least initial among the edits that keep to that cost; a forward walk reads these off. The walk's string is the
audit; it is the ASCII-least of all cheapest ones, since each of its letters leads to one place and state.

How it is spread: equal rows of a turn become one row with a count before anything is shuffled by conversation, and repeats across turns are found by an aggregate and a join. Then rows stream
through Arrow batches sorted by conversation and turn, twice: narrow ones give the audit, with four bytes held for each row of the one conversation at hand (the audit itself has
one), and whole ones, with the audit in front, give the repaired turns, with one batch held. One conversation is one task's, as its one hash is; its texts are never in memory together.

Cases: rows go by (turn, role, text), null turns first; a null role or text is one space; rows without a conv_id are one conversation of their own; repeated rows repeat, so all but
the first are duplicates; role initials other than s, u and a fit nowhere; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

BLANKS = " \\x09-\\x0D"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# The automaton: 0 nothing yet, 1 after s, 2 after u, 3 after a. NEXT has the state that a kept initial leads to, MADE the role that can be made up and where it leads.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MADE = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
DONE = (True, False, False, True)
FAR = 1 << 60
FAULTS = ("", "blank", "duplicate", "truncated")
WHOLE, BLANK, DUPLICATE, CUT = range(4)


def plan(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, the ASCII-least where several are; `rows` are role initials and faults (places in FAULTS)."""
    choices = bytearray(4 * len(rows) + 4)

    def inserted(ahead: list[tuple[int, str]]) -> list[tuple[int, str]]:
        """The costs and edits of four states at one turn, with turns made up before it."""
        while True:
            best = [min(a, (INSERT + ahead[MADE[s][1]][0], "I")) for s, a in enumerate(ahead)]
            if best == ahead:
                return best
            ahead = best

    now = inserted([(0, "") if done else (FAR, "") for done in DONE])
    choices[4 * len(rows) :] = bytes(ord(x or " ") for _, x in now)
    for i in range(len(rows) - 1, -1, -1):
        initial, fault = rows[i]
        ways = []
        for s in range(4):
            options = [(DELETE + now[s][0], "D")]
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                options.append((REROLE + more + now[MADE[s][1]][0], "R"))
                if initial in NEXT[s]:
                    options.append((KEEP + more + now[NEXT[s][initial]][0], "K"))
            ways.append(min(options))
        now = inserted(ways)
        choices[4 * i : 4 * i + 4] = bytes(ord(x) for _, x in now)
    state, i, audit = 0, 0, []
    while (edit := chr(choices[4 * i + state])) != " ":
        audit.append(edit)
        if edit in "IR":
            state, i = MADE[state][1], i + (edit == "R")
        else:
            state, i = state if edit == "D" else NEXT[state][rows[i][0]], i + 1
    return now[0][0], "".join(audit)


class Repair:
    """Turns of one conversation in order, edited as the audit says: `turns` gives the (role, text) that a row leaves, and `rest` those after the last row."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def rest(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role, self.state = MADE[self.state]
            self.at += 1
            yield role, ""

    def turns(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.rest()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            role, self.state = MADE[self.state]
        elif edit == "K":
            self.state = NEXT[self.state][role[:1]]
        if edit != "D":
            yield role, text


def damaged(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n): `turns` with faults that a hash of conversation and turn picks, one row in four; n counts equal rows."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    rows = turns.where(draw != 0).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(draw == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), F.when(draw == 3, 2).otherwise(1).alias("n")
    )
    return rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))


def counted(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n) of rows as they are."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text")).groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))


def _by_turn() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")]


def faults(rows: DataFrame) -> DataFrame:
    """Adds `fault`, the place in FAULTS of the first of equal rows' first fault; the others are duplicates, or blank as it is."""
    key = F.sha2("text", 256)
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    keyed = rows.withColumn("_key", key).withColumn("_place", place)
    many = keyed.groupBy("conv", "role", "_key").agg(F.min("_place").alias("_first"), F.count("*").alias("_many")).where("_many > 1").drop("_many")
    found = keyed.join(many.select(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("_key").alias("_k"), "_first"), F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_key") == F.col("_k")), "left")
    end = F.regexp_extract("text", rf"([^{BLANKS}])[{BLANKS}]*\z", 1)
    fault = F.when(end == "", BLANK).when(F.col("_first").isNotNull() & (F.col("_first") != F.col("_place")), DUPLICATE).when(~end.isin(".", "!", "?"), CUT).otherwise(WHOLE)
    return found.withColumn("fault", fault).drop("_key", "_place", "_first", "_c", "_r", "_k")


def _streamed(rows: DataFrame, order: list[Column], keep: list[str | Column], run, schema: str) -> DataFrame:
    return rows.repartition(F.col("conv")).sortWithinPartitions(*order).select(*keep).mapInArrow(run, schema)


AUDIT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn to one row for each conversation."""

    def closed(conv: int | None, rows: list[tuple[str, int]], turns: list[int], count: list[int], illegal: int) -> tuple:
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        cost, audit = plan(rows)
        return conv, gaps, *count[1:], illegal, cost, audit

    out: list[tuple] = []
    open_, rows, turns, count, illegal, last = (object(), []), [], [], [0] * 4, 0, None
    first = True
    for batch in batches:
        for conv, turn, initial, fault, n in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "initial", "fault", "n")), strict=True):
            if first or conv != open_:
                if not first:
                    out.append(closed(open_, rows, turns, count, illegal))
                first, open_, rows, turns, count, illegal, last = False, conv, [], [], [0] * 4, 0, None
            repeats = BLANK if fault == BLANK else DUPLICATE
            rows += [(initial, fault)] + [(initial, repeats)] * (n - 1)
            count[fault] += 1
            count[repeats] += n - 1
            illegal += (last is not None and last + initial not in ("su", "ua", "au")) + (n - 1)
            last = initial
            if turn is not None and (not turns or turn != turns[1]):
                turns = [turns[0], turn, turns[2] + 1] if turns else [turn, turn, 1]
        if out:
            yield _batch(out, AUDIT)
            out = []
    if not first:
        yield _batch([closed(open_, rows, turns, count, illegal)], AUDIT)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [f for f, _ in fields])


def audits(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of `rows` (conv, turn, role, text, n, fault)."""
    return _streamed(rows, _by_turn(), ["conv", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "n"], _audits, AUDIT)


def _edited(batches: Iterator[pa.RecordBatch]):
    """(conv, [(role, text), ...]) as rows stream by; None in place of the turns where a conversation begins."""
    repair, open_ = None, None
    for batch in batches:
        for conv, audit, role, text, n in zip(*(batch.column(c) for c in ("conv", "audit", "role", "text", "n")), strict=True):
            if (found := audit.as_py()) is not None:
                if repair is not None:
                    yield open_, list(repair.rest())
                repair, open_ = Repair(found), conv.as_py()
                yield open_, None
                continue
            for _ in range(n.as_py()):
                yield open_, list(repair.turns(role.as_py(), text.as_py()))
    if repair is not None:
        yield open_, list(repair.rest())


HASHED = "conv long, repaired_sha256 string"
TURNS = "conv_id long, turn long, role string, text string"


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, open_, digest, began = [], None, None, False
    for conv, turns in _edited(batches):
        if turns is None:
            if digest is not None:
                out.append((open_, digest.hexdigest()))
            open_, digest, began = conv, hashlib.sha256(), False
            if len(out) >= 10_000:
                yield _batch(out, HASHED)
                out = []
            continue
        for role, text in turns:
            digest.update(f"{chr(10) if began else ''}{role}:{text}".encode())
            began = True
    if digest is not None:
        yield _batch([*out, (open_, digest.hexdigest())], HASHED)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size, at = [], 0, 0
    for conv, turns in _edited(batches):
        if turns is None:
            at = 0
            continue
        for role, text in turns:
            out.append((conv, at, role, text))
            at, size = at + 1, size + len(text)
        if size > 4 << 20 or len(out) >= 10_000:
            yield _batch(out, TURNS)
            out, size = [], 0
    if out:
        yield _batch(out, TURNS)


def _with_audits(rows: DataFrame, found: DataFrame, run, schema: str) -> DataFrame:
    """Rows stream behind their conversation's audit, which comes once."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = found.select("conv", F.lit(0).alias("body"), "audit", none("long", "turn"), none("string", "role"), none("string", "text"), none("long", "n"))
    body = rows.select("conv", F.lit(1).alias("body"), none("string", "audit"), "turn", "role", "text", "n")
    return _streamed(heads.unionByName(body), [F.col("conv").asc_nulls_first(), F.col("body"), *_by_turn()[1:]], ["conv", "audit", "role", "text", "n"], run, schema)


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the conversations of `turns` after the cheapest edits, turns numbered from 0. One of which nothing is left has no rows."""
    rows = written(faults(counted(turns)))
    return _with_audits(rows, audits(rows), _turns, TURNS)


def report(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """For each conv_id of `turns`: what is wrong in `rows` (of `damaged` or `counted`), the cheapest edits, and the SHA-256 of the repaired conversation."""
    rows = written(faults(rows))
    found = written(audits(rows))
    hashed = _with_audits(rows, found, _hashes, HASHED)
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    same = lambda c: F.col("conv_id").eqNullSafe(F.col(c))
    out = every.join(found, same("conv"), "left").join(hashed.withColumnRenamed("conv", "_conv"), same("_conv"), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
