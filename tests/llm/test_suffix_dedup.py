import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import suffix_dedup as S
from foliant.llm.rolling import text_bytes


def brute(rows, length):
    count, raws = collections.Counter(), [(i, (t or "").encode()) for i, t in rows]
    for _, b in raws:
        count.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, b in raws:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        n = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), n, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return sorted(out, key=repr)


def digests(df, *args, **kw):
    return sorted((tuple(r) for r in S.digests(S.covered(df, *args, **kw)).collect()), key=repr)


def tricky(seed=1):
    random.seed(seed)
    words = ["aa", "b", "cde", "é", "日本", "x"]
    base = ["".join(random.choice(words) for _ in range(60)) for _ in range(6)]
    rows = [(i, "".join(random.choice(base)[random.randrange(40) :][: random.randrange(80)] + random.choice(words) * random.randrange(3) for _ in range(random.randrange(6)))) for i in range(200)]
    return rows + [(1, "dup" * 30), (1, "dup" * 30), (None, "a" * 300), (None, None), (5, None), (6, ""), (7, "ab" * 200)]


@pytest.mark.parametrize("length,anchor", [(20, None), (33, 5), (50, None)])
def test_equals_brute_force(spark, length, anchor):
    rows = tricky()
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, low int, key string")
    assert digests(df, length, anchor) == brute(rows, length)


def test_driver_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert digests(docs, 400) == brute([(r.doc_id, r.text) for r in docs.collect()], 400)


def test_empty_table_and_kept_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert digests(empty, 30) == []
    same = "é" * 40
    rows = spark.createDataFrame([(1, "x" + same + "y", "a"), (2, "z" + same, "b")], "doc_id long, text string, lang string")
    kept = {r.doc_id: (r.kept, r.carry.lang) for r in S.kept_texts(S.covered(rows, 31, carry=("lang",))).collect()}
    assert kept == {1: ("xy", "a"), 2: ("z", "b")}
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in S.repeats(rows, 31).collect()}
    assert spans == {1: [(1, 81)], 2: [(1, 81)]}


def test_many_equal_rows_cost_one_list(spark):
    rows = [(None, "a passage that is long enough to count, said once a row " * 40)] * 1000 + [(7, "some words of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = S.covered(df, 400)
    assert found.agg(F.max(F.size(F.element_at("sure", 1)))).first()[0] < 40
    assert digests(df) == brute(rows, 400)


def test_segments_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 100)
    rows = [*tricky(3), (9000, tricky(3)[8][1] + "".join(t for _, t in tricky(4) if t) + "zz")]
    (_, text), (_, other) = rows[-1], rows[8]
    texts = pa.array([text])
    cuts = [c for c in S._cut(texts, None, 20, 6, 0)]
    assert len(cuts) > 10
    whole = S.Stretches(*text_bytes(texts), 20, 6).all()
    windows = lambda low, high, a: sorted((p, q) for x, y, q in zip(low.tolist(), high.tolist(), a.tolist(), strict=True) for p in range(x, y + 1))
    joined = [np.concatenate(c) for c in zip(*((low, high, a) for _, low, high, a, *_ in cuts), strict=True)]
    assert windows(*joined) == windows(*whole)
    given = pa.array([[{"low": int(x), "high": int(y), "a": int(z)} for x, y, z in zip(*joined, strict=True)]])
    for grain in (1, 2):
        parts = [np.concatenate(c) for c in zip(*S._cut(texts, given, 20, 6, grain), strict=True)]
        monkeypatch.setattr(S, "SEGMENT", 1 << 20)
        once = next(S._cut(texts, given, 20, 6, grain))
        monkeypatch.setattr(S, "SEGMENT", 100)
        key = lambda c: sorted(zip(*(x.tolist() for x in c[1:]), strict=True))
        assert key(parts) == key(once)


def rows_of(family):
    return {rank: family.run(rank, path).count() for rank, path in family.levels}


def test_levels_double_and_serve_later_sessions(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{i} says its own words " * 3 + ("a passage that several have " * 4 if i % 3 == 0 else "")) for i in range(32)], "doc_id long, text string")
    want = []
    for i in range(8):
        family = S.Family(spark, str(tmp_path))  # opened anew each time
        matches = family.add(S.entries(docs.where(f"doc_id % 8 = {i}"), 60)).collect()
        want.append(len(matches))
        assert sorted(r for r, _ in family.levels) == [k for k in range(4) if (i + 1) >> k & 1]
    assert sum(rows_of(family).values()) > 32 and want[0] > 0 and min(want[1:]) > 0
    seen = collections.Counter()
    for r in S.entries(docs, 60).collect():
        seen[r.key] += r.n
    level = family.run(*family.levels[0]).collect()
    assert sum(r.n for r in level) == sum(seen.values())
    # what a later batch shares with the index is found by its scan alone, whichever level holds it
    late = S.Family(spark, str(tmp_path)).add(S.entries(docs.where("doc_id = 3"), 60), store=False).collect()
    again = {(r.key, r.whole) for r in S.entries(docs.where("doc_id = 3"), 60).collect()}
    assert again <= {(r.key, r.whole) for r in late if r.n >= 2} and {r.key for r in late} == {k for k, _ in again}


def test_matches_come_from_the_scans(spark, monkeypatch):
    """Copies dealt to different batches: with a scan that tells nothing, nothing is removed."""
    rows = [(i, f"{i}" + "one passage, the same in each of these documents, " * 20) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(df) == brute(rows, 400)
    add = S.Family.add
    monkeypatch.setattr(S.Family, "add", lambda self, entries, store=True: add(self, entries, store).limit(0))
    assert all(n == 0 for _, _, n, *_ in digests(df))


@pytest.mark.parametrize("hold", [1, 5, 1 << 17])
def test_scan_streams_hot_keys(hold, monkeypatch):
    monkeypatch.setattr(S, "HOLD", hold)
    rng = random.Random(hold)
    rows = sorted((rng.choice([3, 3, 3, 9, 12]), rng.randrange(6), rng.choice([S.MATCH, 0, 1, 3]), rng.randrange(50)) for _ in range(300))
    rows += [(20, 1, 0, 4), (20, 2, 1, 4), (21, 1, S.MATCH, 8)]
    batches = [pa.RecordBatch.from_pydict({"key": [r[0] for r in part], "whole": [r[1] for r in part], "n": [1] * len(part), "doc": [r[3] for r in part], "rank": pa.array([r[2] for r in part], pa.int32())}) for part in (rows[i : i + 7] for i in range(0, len(rows), 7))]
    out = [r for b in S._merge_scan([0, 1], 2)(iter(batches)) for r in b.to_pylist()]
    count = collections.Counter((k, w) for k, w, *_ in rows)
    matches = {}
    for r in out:
        if r["rank"] == S.MATCH:
            assert (r["key"], r["whole"]) not in matches
            matches[r["key"], r["whole"]] = r["n"], r["several"], r["doc"]
    assert matches == {(k, w): (n, True, min(d for a, b, _, d in rows if (a, b) == (k, w))) for (k, w), n in count.items() if k < 20}
    run = collections.Counter()
    for r in out:
        if r["rank"] == 2:
            run[r["key"], r["whole"]] += r["n"]
    assert run == collections.Counter((k, w) for k, w, rank, _ in rows if rank != 3)
