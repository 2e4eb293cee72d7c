import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline as C
from foliant.llm import near_copies as N

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(x, y):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in (x, y))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def groups(texts):
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if jaccard(texts[i], texts[j]) >= 0.8:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("small", [2, 32])
def test_near_duplicates_by_brute_force(spark, monkeypatch, small):
    """Copies edited so that similarities lie on both sides of 0.8; with large and small groups of a key."""
    monkeypatch.setattr(N, "SMALL", small)
    rng, texts = random.Random(3), []
    words = [f"w{i}" for i in range(300)]
    common = [rng.choice(words) for _ in range(30)]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 150))] + common
        texts.append(" ".join(base))
        for _ in range(rng.choice((1, 1, 8))):
            copy = list(base)
            for _ in range(rng.randrange(1, 1 + len(base) // 20)):
                copy[rng.randrange(len(copy))] = "new"
            texts.append(" ".join(copy))
    texts += ["", None, " \n", "a b", "A  b", "a b c", texts[0]]
    rng.shuffle(texts)
    near = [jaccard(x, y) for x, y in combinations(texts, 2)]
    assert any(0.8 <= x < 0.9 for x in near) and any(0.6 < x < 0.8 for x in near)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in C.near_duplicates(spark, df, "").collect()) == sorted(set(groups(texts)))


def test_near_duplicates_of_the_given_tables(spark):
    """Pairs of sf0.1 from 0.8 to 0.92 that lie 5 and more SimHash bits apart, and one below 0.8."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (596, 917, 989, 7711, 4474, 6578, 2, 1700)")
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(jaccard(text[i], text[j]) >= 0.8 for i, j in ((596, 917), (989, 7711), (4474, 6578))) and jaccard(text[2], text[1700]) < 0.8
    assert sorted(r.doc_id for r in C.near_duplicates(spark, docs, "").collect()) == [2, 596, 989, 1700, 4474]


def test_links_of_the_trie_are_used(spark, monkeypatch):
    """Close copies are linked by fingerprints alone: without the exact half they still become one."""
    base = " ".join(f"w{i % 97}x{i}" for i in range(400))
    texts = [base, base + " end", "start " + base, " ".join(reversed(base.split())), base.upper()]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    monkeypatch.setattr(N, "links", lambda texts, sure: sure)
    assert sorted(r.doc_id for r in C.near_duplicates(spark, df, "").collect()) == [0, 3]
    monkeypatch.undo()
    asked = []
    confirmed = N.confirmed
    monkeypatch.setattr(N, "confirmed", lambda pairs, texts: asked.append(pairs.count()) or confirmed(pairs, texts))
    assert sorted(r.doc_id for r in C.near_duplicates(spark, df, "").collect()) == [0, 3]
    assert asked[0] >= 3 and asked[1] == 0  # nothing is left to confirm


def test_many_copies_and_equal_rows(spark):
    rows = [(i, "the same words in each of these rows again") for i in range(500)] + [(None, "no id but equal words in all of them")] * 500 + [(None, "The same words in each of these rows again")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(8)
    assert sorted(((r.doc_id, r.text) for r in C.near_duplicates(spark, df, "").collect()), key=str) == [(0, rows[0][1]), (None, rows[500][1])]


def test_sketches_reject_no_near_pair():
    """Over sets of all sizes: a pair at 0.8 or more is never rejected, and most pairs well below are."""
    rng, kept, far = np.random.default_rng(6), 0, 0
    for t in range(600):
        n = int(np.exp(rng.uniform(0, 9)))
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        share = rng.uniform(0.5, 1.0)
        other = np.unique(np.concatenate([base[rng.random(len(base)) < share], rng.integers(0, 1 << 63, int(len(base) * (1 - share) / 2), dtype=np.uint64)]))
        x, y = sorted((base, other), key=len)
        if not len(x) or 5 * len(x) < 4 * len(y):
            continue
        bits = np.frombuffer(N.sketch(x) + N.sketch(y), np.uint64).reshape(2, 2, -1)
        sizes, levels = np.array([len(x), len(y)]), np.array([N.level(len(x)), N.level(len(y))])
        fine = len(N._reachable(sizes, levels, bits[:, 0], bits[:, 1], 0, np.array([1]))[0])
        both = len(np.intersect1d(x, y))
        similarity = both / (len(x) + len(y) - both)
        assert fine or similarity < 0.8, (len(x), len(y), similarity)
        if similarity < 0.6 and n > 60:
            far, kept = far + 1, kept + fine
    assert far > 30 and kept < 0.2 * far


def test_a_large_group_costs_about_a_tree(spark, monkeypatch):
    """A group of near copies of one text, similarities on both sides of 0.8: what leaves the tasks grows like its size, and no link is lost."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(50)}x{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    asked, confirmed = [], N.confirmed
    monkeypatch.setattr(N, "confirmed", lambda pairs, texts: asked.append(pairs.count()) or confirmed(pairs, texts))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    want = sorted(set(groups(texts)))
    assert 1 <= len(want) < 150 and sorted(r.doc_id for r in C.near_duplicates(spark, df, "").collect()) == want
    assert sum(asked) < 150 * 149 / 2 / 2


def test_noisy_copies_of_a_long_text_cost_about_a_tree(spark, monkeypatch):
    """Copies of a text of 396 shingles with similarities from 0.4 to 0.99: most pairs lie around the border, and what is asked still grows like the group."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(50)}x{i}" for i in range(400)]
    texts = []
    for _ in range(160):
        copy = list(base)
        for _ in range(rng.randrange(1, 17)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    asked, confirmed = [], N.confirmed
    monkeypatch.setattr(N, "confirmed", lambda pairs, texts: asked.append(pairs.count()) or confirmed(pairs, texts))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    want = sorted(set(groups(texts)))
    assert 10 < len(want) < 150 and sorted(r.doc_id for r in C.near_duplicates(spark, df, "").collect()) == want
    assert sum(asked[2:]) < 2 * len(texts), asked  # the rounds of large keys


@pytest.mark.parametrize("held", [8, 1 << 18])
def test_a_forest_reaches_what_all_pairs_reach(monkeypatch, held):
    """Members of one key in small and large components: a forest joins the components that all possible pairs would, with one pair less than it joins."""
    monkeypatch.setattr(N, "HELD", held)
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = sorted((np.unique(np.r_[base[rng.random(200) < 0.93], rng.integers(0, 1 << 63, 8, dtype=np.uint64)]) for _ in range(90)), key=len)
    size, deep = np.array([len(x) for x in sets]), np.array([N.level(len(x)) for x in sets])
    bits = np.frombuffer(b"".join(map(N.sketch, sets)), np.uint64).reshape(len(sets), 2, -1)
    label = np.minimum(rng.integers(0, 60, len(sets)), 40)

    def joined(forest):
        pairs = [p for i, j in N._met(size, deep, bits[:, 0], bits[:, 1], label.copy(), forest) for p in zip(i.tolist(), j.tolist())]
        at = label.copy()
        for i, j in pairs:
            at[at == at[j]] = at[i]
        return len(pairs), {frozenset(np.flatnonzero(at == x).tolist()) for x in np.unique(at)}

    (many, all_), (few, tree) = joined(False), joined(True)
    assert tree == all_ and few == len(np.unique(label)) - len(tree) < many / 4
