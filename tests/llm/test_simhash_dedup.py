import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from foliant.llm import simhash_dedup as M


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows):
    fp = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 4:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, f"{fp[k]:016x}", least.get(root(k))) for k, (i, _) in enumerate(rows)), key=repr)


def test_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "A B c"), (906, "x\x1cy\xa0z É é"), (907, docs[3][1]), (907, docs[3][1]), (None, docs[4][1]), (None, "alone"), (908, "w " * 3000)]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, fp int")
    assert sorted((tuple(r) for r in M.groups(df).collect()), key=repr) == slow_groups(docs)
    assert M.groups(df.limit(0)).collect() == []


def clustered(n, seed):
    random.seed(seed)
    out = set()
    for _ in range(n // 20):
        at = random.getrandbits(64)
        for _ in range(20):
            at ^= sum(1 << random.randrange(64) for _ in range(random.randrange(1, 7)))
            out.add(at % (1 << 64))
    return np.array(sorted(out), np.uint64)


def classes(values, pairs):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


@pytest.mark.parametrize("budget", [0, 3, 4])
def test_trie_join_equals_all_pairs(budget):
    values = clustered(2000, budget)
    near = [(a, b) for a, b in combinations(values.tolist(), 2) if (a ^ b).bit_count() <= budget]
    found = [(x % (1 << 64), y % (1 << 64)) for x, y in M.trie_join(values, budget)]
    assert all((a ^ b).bit_count() <= budget for a, b in found)
    assert classes(values.tolist(), found) == classes(values.tolist(), near)


@pytest.mark.parametrize("split", [3, 100_000])
def test_links_with_heavy_roots(spark, split):
    values = clustered(300, 9)
    near = [(a, b) for a, b in combinations(values.view(np.int64).tolist(), 2) if ((a ^ b) % (1 << 64)).bit_count() <= 4]
    df = spark.createDataFrame([(v,) for v in values.view(np.int64).tolist()], "fp long")
    found = [(r.a, r.b) for r in M.links(df, 4, split).collect()]
    assert classes(values.view(np.int64).tolist(), found) == classes(values.view(np.int64).tolist(), near)


def test_components_of_a_long_chain(spark):
    from foliant.llm.shared import components

    n = 200
    order = random.Random(3).sample(range(n), n)
    edges = spark.createDataFrame([*zip(order, order[1:], strict=False), (500, 501), (501, 501)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {**{i: 0 for i in range(n)}, 500: 500, 501: 500}


def test_one_of_each_keeps_all_columns(spark):
    from foliant.llm import simhash_dedup

    names = "_n int, _node string, node int, key string, row string, id int, root string, least int"
    docs = spark.createDataFrame([(i, t, i, "x", 2, "k", "r", 3, "o", 4) for i, t in [(3, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (4, ""), (5, "other words are here too ok")]], f"doc_id long, text string, {names}")
    out = simhash_dedup.one_of_each(docs)
    assert out.columns == docs.columns and sorted(tuple(r)[:3] for r in out.collect()) == [(1, "a b c d e f", 1), (2, None, 2), (5, "other words are here too ok", 5)]


def test_the_descent_looks_at_few_pairs(spark):
    """On the given fingerprints the trie visits a small share of all pairs, and what it prunes it may prune."""
    from foliant.llm.shared import written

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fps = np.unique(np.array([r.fp for r in written(M.fingerprints(docs)).select("fp").distinct().collect()], np.int64).view(np.uint64))
    seen = []
    found = [(x % (1 << 64), y % (1 << 64)) for x, y in M.trie_join(fps, 4, 0, seen)]
    every = len(fps) * (len(fps) - 1) // 2
    assert seen[0] < 0.3 * every
    near = []
    for i in range(len(fps)):
        near += [(int(fps[i]), int(fps[j])) for j in i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4)]
    assert classes(fps.tolist(), found) == classes(fps.tolist(), near)
    # With one block's bits as first levels, where nothing may differ, the five tries together look at far fewer.
    seen, links = [], []
    for turn, same in M.blocks(4):
        turned = (fps << np.uint64(turn) | fps >> np.uint64(64 - turn)) if turn else fps
        back = lambda x, k=turn: ((x >> k) | (x << (64 - k))) % (1 << 64)
        links += [(back(x % (1 << 64)), back(y % (1 << 64))) for x, y in M.trie_join(turned, 4, same, seen)]
    assert sum(seen) < 0.02 * every and classes(fps.tolist(), links) == classes(fps.tolist(), near)


def test_a_cluster_costs_no_square():
    """Members that are one group already are not paired again."""
    rng = np.random.default_rng(3)
    at = np.uint64(0x0123456789ABCDEF)
    flips = np.array([(1 << int(a)) | (1 << int(b)) | (1 << int(c)) for a, b, c in rng.integers(0, 64, (20_000, 3))], np.uint64)
    values = np.unique(at ^ flips)
    seen = []
    found = M.trie_join(values, 4, 0, seen)
    assert len(found) == len(values) - 1 and seen[0] < 0.03 * len(values) * (len(values) - 1) / 2


def test_subtrees_are_dealt_by_counts(spark, monkeypatch):
    monkeypatch.setattr(M, "TASK", 50)
    values = clustered(3000, 12)
    near = [(a, b) for a, b in combinations(values.view(np.int64).tolist(), 2) if ((a ^ b) % (1 << 64)).bit_count() <= 4]
    df = spark.createDataFrame([(v,) for v in values.view(np.int64).tolist()], "fp long")
    found = [(r.a, r.b) for r in M.links(df).collect()]
    assert classes(values.view(np.int64).tolist(), found) == classes(values.view(np.int64).tolist(), near)
    assert M.links(df.limit(0)).collect() == []
