import hashlib
import random
import re

import pytest

from foliant.llm import fill_middle as M
from foliant.llm.queries import op12_fill_middle, oracle_sql

PIECES = ["a", "bc ", "\n", "\n\n", " ", "é", "日本", "😀", "\r\n", "\x0b", "x\n", "<"]
UNIT = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).", "word": r"[ \t-\r]+|[^ \t-\r]+[ \t-\r]*"}


def plain(doc_id, text, seed, unit, rate=100, spm=50):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in M.MARKS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", M.UNITS)
def test_against_regular_expressions(unit):
    rng = random.Random(unit)
    for i in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(30)))
        assert M.transformed(i, text, 7, unit, 100, 50) == plain(i, text, 7, unit)
    for rate, spm in ((0, 50), (40, 0), (100, 100)):
        assert [M.transformed(i, "a\nb\nc", 1, unit, rate, spm) for i in range(200)] == [plain(i, "a\nb\nc", 1, unit, rate, spm) for i in range(200)]


def test_selection_of_ranked_bits():
    rng = random.Random(5)
    for _ in range(300):
        size = rng.randrange(1, 400)
        places = sorted(rng.sample(range(size), rng.randrange(1, size + 1)))
        bits = sum(1 << p for p in places)
        assert [M.select(bits, k, size) for k in range(len(places))] == places


def test_very_long_text():
    text = "héllo wörld\n" * 400_000
    n, form, prefix, middle, output = M.transformed(3, text, 7, "line", 100, 50)
    assert n == 400_000 and form != "plain" and (n, form, prefix, middle, output) == plain(3, text, 7, "line")


def test_cases(spark):
    texts = [(1, "a\nb\nc\n"), (1, "a\nb\nc\n"), (1, "other"), (None, "x\ny"), (2, None), (3, ""), (4, "has <M> in it"), (5, "\n"), (6, "<\nP>\n<S\n>")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in texts], "doc_id long, text string, n int, form string")  # clashing names
    want = sorted((str(i), *plain(i, t, 7, "line")) for i, t in texts)
    out = M.transform(docs)
    assert sorted((str(r.doc_id), *r[1:]) for r in out.collect()) == want
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((str(r.doc_id), r.output_sha256, r.restored_sha256) for r in M.digests(out).collect()) == sorted((str(i), sha(plain(i, t, 7, "line")[-1]), sha(t or "")) for i, t in texts)
    assert M.transform(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        M.transform(docs, unit="page")


def test_query_restores_every_text(spark, sf_dir):
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = {r.doc_id: r for r in op12_fill_middle(spark, sf_dir).collect()}
    assert {i: r.restored_sha256 for i, r in out.items()} == {i: sha(t) for i, t in texts.items()}
    assert {i: r.output_sha256 for i, r in out.items()} == {i: sha(plain(i, t, 7, "line")[-1]) for i, t in texts.items()}
    assert {r.form for r in out.values()} >= {"psm", "spm"} and "op12_fill_middle" in oracle_sql()
