import random

import pytest

from foliant.llm import edit_counts as E
from foliant.llm.queries import sample_edits
from foliant.llm.tokens import encoder, vocabulary_path

PIECES = ["ab", "c", " ", "  ", "\n", "'", "s", "1", "!", "é", "  \n", "日", "word", "'re", " the"]


def tokens(text):
    return len(encoder(vocabulary_path()).library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("leaf", [1, 2, 5, 32])
def test_edits_equal_a_fresh_count(leaf, monkeypatch):
    monkeypatch.setattr(E, "LEAF", leaf)
    rng = random.Random(leaf)
    for t in range(200):
        s = "".join(rng.choice(PIECES) for _ in range(rng.randrange(120)))
        if t % 40 == 0:
            s += "<|endoftext|>" + s
        tree = E.Tree(s, encoder(vocabulary_path()))
        for _ in range(5):
            at, cut = rng.randrange(len(s) + 3), rng.randrange(8) if rng.random() < 0.8 else rng.randrange(200)
            new = "".join(rng.choice(PIECES) for _ in range(rng.randrange(6) if rng.random() < 0.9 else 200))
            if rng.random() < 0.05:
                new = "<|endoftext|>"
            tree = E.Tree.stored(*tree.row(), tree.coder)  # as the next batch of edits reads it
            tree.edit(at, cut, new)
            at = min(at, len(s))
            s = s[:at] + new + s[at + cut :]
            assert (tree.total, tree.all()) == (tokens(s), s)


def test_query_against_brute_force(spark, sf_dir):
    rows = sample_edits(E.build(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    want = {}
    for r in rows.collect():
        s = r.text
        for e in r.edits:
            at = min(e.start, len(s))
            s = s[:at] + e.text + s[at + e.removed :]
        want[r.doc_id] = (tokens(r.text), tokens(s), len(s))
    out = E.apply(rows, keep=False).collect()
    assert {r.doc_id: (r.n_tokens, r.n_tokens_after, r.n_chars_after) for r in out} == want
    long = [r for r in out if r.n_pretokens > 2000]
    assert long and sum(r.n_pretokens_again for r in long) < 0.5 * sum(r.n_pretokens for r in long)


def test_batches_of_edits_on_stored_trees(spark, tmp_path):
    """Each batch reads the trees that the one before stored; only what is touched is encoded."""
    rng = random.Random(7)
    texts = {i: " ".join(rng.choice(["some", "words", "of", "it's", "12", "é", "…"]) for _ in range(3000)) for i in range(6)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    E.build(docs).write.parquet(str(tmp_path / "0"))
    for turn in range(3):
        trees = spark.read.parquet(str(tmp_path / str(turn)))
        edits = [(i, n, rng.randrange(9000), rng.randrange(20), rng.choice(["", "new words ", "x"])) for i in (0, 2, 4) for n in range(3)]
        for i, _, at, cut, new in edits:
            texts[i] = texts[i][:at] + new + texts[i][at + cut :]
        table = spark.createDataFrame(edits, "doc_id long, seq int, start int, removed int, text string")
        E.apply(E.with_edits(trees, table)).write.parquet(str(tmp_path / str(turn + 1)))
        out = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / str(turn + 1))).collect()}
        assert {i: (r.n_tokens_after, r.text) for i, r in out.items()} == {i: (tokens(t), t) for i, t in texts.items()}
        for i, r in out.items():
            assert r.n_pretokens_again == 0 if i % 2 else 0 < r.n_pretokens_again < 0.2 * r.n_pretokens
            fresh = E.Tree(texts[i], encoder(vocabulary_path()))
            assert sum(r["count"]) == sum(fresh.count) and r.tokens[1] == fresh.total and r.chars[1] == len(texts[i])
            assert all(r.tokens[k] == r.tokens[2 * k] + r.tokens[2 * k + 1] and r.chars[k] == r.chars[2 * k] + r.chars[2 * k + 1] for k in range(1, len(r["count"])))


def test_cases(spark):
    docs = spark.createDataFrame([(1, "one two", 3), (1, "one two", 3), (2, None, 3), (3, "", 3), (None, "x", 3), (4, "y", 3)], "doc_id long, text string, seq int")
    edits = spark.createDataFrame([(1, 2, 0, 3, "1"), (1, 1, 99, 5, " three"), (2, 1, 0, 0, "ab"), (3, 1, None, None, None), (9, 1, 0, 0, "z")], "doc_id long, seq int, start int, removed int, text string")
    got = sorted(((r.doc_id, r.n_tokens, r.n_tokens_after) for r in E.apply(E.with_edits(E.build(docs), edits)).collect()), key=repr)
    assert got == sorted([(1, 2, tokens("1 two three"))] * 2 + [(2, 0, tokens("ab")), (3, 0, 0), (None, 1, 1), (4, 1, 1)], key=repr)
    assert E.apply(E.with_edits(E.build(docs.limit(0)), edits)).collect() == []
