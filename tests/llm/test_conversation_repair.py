import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from foliant.llm import conversation_repair as R
from foliant.llm.queries import op13_conversation_repair

ROLES = ["user", "assistant", "system", "tool", "User", " ", "agent"]


def cheapest(rows):
    """(cost, audit) of all edits by Dijkstra on (cost, audit): `rows` are initials and faults."""
    form, heap, done = re.compile(r"(s?(ua)+)?"), [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        if i == len(rows) and form.fullmatch(made):
            return cost, audit
        state = made[:1] == "s" and len(made) == 1, made[-1:], i
        if state in done:
            continue
        done.add(state)
        steps = [("I", 2, i, made + x) for x in "ua"]
        if i < len(rows):
            initial, fault = rows[i]
            steps.append(("D", 3, i + 1, made))
            if fault not in (R.BLANK, R.DUPLICATE):
                more = fault == R.CUT
                steps += [("R", 2 + more, i + 1, made + x) for x in "ua"] + [("K", more, i + 1, made + initial)]
        for letter, price, at, now in steps:
            if re.fullmatch(r"s?(ua)*u?", now):
                heapq.heappush(heap, (cost + price, audit + letter, at, now))


def plain(rows):
    """The report on (turn, role, text) of one conversation after damage, in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append(R.BLANK if not body else R.DUPLICATE if (role, text) in seen else R.CUT if body[-1] not in ".!?" else R.WHOLE)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    cost, audit = cheapest([(r[1][:1], f) for r, f in zip(rows, faults)])
    made, left, state = [], iter(rows), ""
    for x in audit:
        if x != "I":
            _, role, text = next(left)
        if x in "IR":
            role = "assistant" if state == "u" else "user"
            text = "" if x == "I" else text
        if x != "D":
            made.append(f"{role}:{text}")
            state = role[0]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in (R.BLANK, R.DUPLICATE, R.CUT)), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine, one = out.setdefault(conv, []), lambda x: " " if x is None else x
        role, text = one(role), one(text)
        draw = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        if draw == 1:
            text = ""
        elif draw == 2:
            text = re.sub("[.!?]", "", text)
        elif draw == 4:
            role = "user"
        mine += [] if draw == 0 else [(turn, role, text)] * (1 + (draw == 3))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def test_plan_against_dijkstra():
    rng = random.Random(3)
    for _ in range(2500):
        rows = [(rng.choice("uuaast"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(9))]
        assert R.plan(rows) == cheapest(rows), rows
    assert R.plan([]) == (0, "") and R.plan([("s", 0)]) == (3, "D")


def test_long_conversation():
    rows = [("ua"[i % 2], 0) for i in range(100_000)]
    assert R.plan(rows) == (0, "K" * 100_000)


def result(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(op13_conversation_repair(spark, sf_dir)) == {c: plain(v) for c, v in damage(rows).items()}


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(11)
    texts = ["Yes.", "no", "", " \t", None, "Why?", "a.\n", "x!  ", "long " * 3000, ". a", " "]
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(6), 40]), rng.choice([None, *ROLES]), rng.choice(texts)) for _ in range(400)]
    rows += [(70, 1, "user", "Hi.")] * 50 + [(71, None, None, None)] + [(72, t, "user", "Same.") for t in range(30)] + [(73, t, "ua"[t % 2] + "x", f"{t}.") for t in range(500)]
    return rows, spark.createDataFrame([(*r, 5, "z") for r in rows], "conv_id long, turn long, role string, text string, n int, audit string").repartition(7)


def test_cases(spark, odd):
    rows, turns = odd
    want = {c: plain(v) for c, v in damage(rows).items()}
    assert result(R.report(turns, R.damaged(turns))) == want
    assert any(not v for v in damage(rows).values()) or all(want.values())
    none = turns.where("false")
    assert R.report(none, R.damaged(none)).count() == 0


def test_nothing_left(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    turns = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert result(R.report(turns, R.damaged(turns))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_repaired_turns_have_the_form(spark, odd):
    rows, turns = odd
    found = {r.conv_id: r for r in R.report(turns, R.counted(turns)).collect()}
    made = {}
    for r in sorted(R.repaired(turns).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.turn)):
        made.setdefault(r.conv_id, []).append(r)
    for conv, r in found.items():
        mine = made.get(conv, [])
        assert [x.turn for x in mine] == list(range(len(mine)))
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x.role[:1] for x in mine))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in mine).encode()).hexdigest() == r.repaired_sha256
