import numpy as np
import pytest

from foliant.llm import ann


def brute(rows, queries, k):
    out = {}
    for q, x in queries:
        scored = sorted(((-sum(float(a) * float(b) for a, b in zip(x, y, strict=True)), v) for v, y in rows if v != q))
        out[q] = [(v, -s) for s, v in scored[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_on_driver_vectors(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = found(ann.search(vectors, vectors.where("vec_id % 20 = 0")))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {(q, v): s for q in want for v, s in want[q]}
    assert all(abs(s - exact[q, v]) < 1e-12 for q in got for v, s in got[q] if (q, v) in exact)


def test_codes_bound_recall_alone():
    """Without reranking beyond the 20, codes alone find most; the anisotropic loss ranks better than the plain one."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    q = rng.normal(size=(50, 64))
    true = np.argsort(-(q @ x.T), axis=1)[:, :20]
    recall = {}
    for eta in (1.0, 4.0):
        book = ann.Codebook(x[:1500], eta)
        codes = book.packed(book.encode(x))
        recall[eta] = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(true, ann.scan(book, q, codes, 20), strict=True)])
        wide = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(true, ann.scan(book, q, codes, 64), strict=True)])
        assert wide >= 0.9
    assert recall[4.0] > 0.5


def clustered(rng, n, clusters, width):
    x = rng.normal(size=(n, 64))
    if clusters:
        x = x * width + rng.normal(size=(clusters, 64))[rng.integers(0, clusters, n)]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def index_search(x, queries, index):
    """Rows found through cells, codes and exact reranking, as a search finds them."""
    cells = index.cells(x)
    codes, out = index.codes(x, cells), []
    order = index.order(queries)[:, : index.visits]
    for i, q in enumerate(queries):
        seen = []
        for c in order[i]:
            rows = np.flatnonzero(cells == c)
            if len(rows):
                seen.append(rows[ann.scan(index.book, q[None], codes[rows], index.depth(len(rows)))[0]])
        seen = np.concatenate(seen)
        out.append(seen[np.argsort(-(x[seen] @ q), kind="stable")[:20]])
    return out


@pytest.mark.parametrize("clusters,width", [(10, 0.35), (50, 0.1), (200, 0.35), (1000, 0.1), (0, 1.0)])
def test_recall_at_a_hundred_thousand_vectors(clusters, width):
    """Through cells and against all rows: tight, many and no clusters."""
    rng = np.random.default_rng(2)
    x = clustered(rng, 100_000, clusters, width)
    index = ann.Index(x[: ann.SAMPLE], len(x))
    assert len(index.centres) == 98 and (index.visits < 40 or not clusters)
    q = x[rng.choice(len(x), 100, replace=False)]
    true = np.argsort(-(q @ x.T), axis=1)[:, :20]
    recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(true, index_search(x, q, index), strict=True)])
    print(clusters, width, index.visits, index.share, recall)
    assert recall >= 0.95


def test_blocks_and_parts_and_cells(spark, monkeypatch):
    """The distributed search against brute force, with many cells, blocks and parts."""
    monkeypatch.setattr(ann, "CELL", 300)
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 150)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(5)
    x = clustered(rng, 3000, 12, 0.35)
    df = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(ann.search(df, df.where("vec_id % 20 = 0"), 20))
    assert len(got) == 150 and all(len(g) == 20 for g in got.values())
    hits = 0
    for q, some in got.items():
        want = [v for v in np.argsort(-(x @ x[q]), kind="stable").tolist() if v != q][:20]
        hits += len(set(want) & {v for v, _ in some})
    assert hits >= 0.95 * 3000


def test_repeated_rows_and_ids(spark):
    rows = [(20, [1.0, 2.0])] * 30 + [(100 + i, [1.0, 2.0]) for i in range(5)] + [(200, [1.0, 0.0]), (300, [3.0, 1.0]), (300, [0.0, 1.0]), (7, [1.0]), (40, [2.0]), (8, [4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(ann.search(df, df.where("vec_id % 20 = 0"), 20))
    assert got[20] == [(100, 5.0), (101, 5.0), (102, 5.0), (103, 5.0), (104, 5.0), (300, 5.0), (300, 2.0), (200, 1.0)]
    assert got[40] == [(8, 8.0), (7, 2.0)] and set(got) == {20, 40, 100, 200, 300}


def test_groups_of_copies(spark):
    """Many groups of 25 copies: the best vectors' copies are found, not those of what three approximate scores rank first."""
    rng = np.random.default_rng(4)
    x = 0.2 * rng.normal(size=(400, 64)) + rng.normal(size=64)
    rows = [(int(v), x[i].tolist()) for v, i in enumerate(rng.permutation(np.repeat(np.arange(400), 25)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(-1 - i, y.tolist()) for i, y in enumerate(rng.normal(size=64) + 0.2 * rng.normal(size=(40, 64)))] + rows[:5], "vec_id long, embedding array<double>")
    got = found(ann.search(df, queries, 20))
    all_x = np.array([e for _, e in rows])
    for r in queries.collect():
        score = all_x @ np.array(r.embedding)
        want = [v for v in np.lexsort((np.arange(len(rows)), -np.round(score, 9))).tolist() if v != r.vec_id][:20]
        assert [v for v, _ in got[r.vec_id]] == want


def test_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0, 0.5]), (1, [1.0, 0.0, 0.5]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, [None, 1.0, 1.0]), (7, [0.5, 0.5, 0.0]), (None, [1.0, 1.0, 1.0]), (8, [1.0]), (20, [0.0, 1.0, 0.0])]
    rows += [(100 + i, [1.0, 0.0, 0.5]) for i in range(60)]
    df = spark.createDataFrame([(*r, 3, 1.0) for r in rows], "vec_id long, embedding array<float>, rank int, score double")
    fine = [(v, x) for v, x in rows if v is not None and v not in (2, 3, 4, 5, 6, 8)]
    got = found(ann.search(df, df.where("vec_id % 20 = 0"), 20))
    assert got == brute(fine, [r for r in fine if r[0] % 20 == 0], 20)
    few = df.where("vec_id in (0, 7)")
    assert found(ann.search(few, few.where("vec_id = 0"), 20)) == {0: [(7, 0.5)]}
    assert ann.search(df.limit(0), df.limit(0)).collect() == []


def test_many_vectors_under_the_id_of_a_query(spark):
    """However many vectors an id has, they take no place among its own neighbours."""
    rng = np.random.default_rng(6)
    mine = rng.normal(size=(400, 8)) + 3
    others = rng.normal(size=(300, 8))
    rows = [(20, v.tolist()) for v in mine] + [(1000 + 20 * (i % 7 == 0) + i, v.tolist()) for i, v in enumerate(others)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.search(vectors, vectors.where("vec_id = 20"), 20).orderBy("rank").collect()
    assert len(out) == 20 and [r.rank for r in out] == list(range(1, 21))
    asked = np.array(min(v.tolist() for v in mine))
    want = sorted((float((asked * np.array(v)).sum()) for _, v in rows[400:]), reverse=True)[:20]
    assert sum(abs(a.score - b) < 1e-9 for a, b in zip(out, want, strict=True)) >= 18


def test_queries_of_another_kind_and_lengths_of_all_sizes(spark):
    """Queries without clusters on tight clusters; and vectors whose lengths differ so much that few of the nearest are in the sample."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 64))[rng.integers(0, 60, 12_000)] + rng.normal(size=(12_000, 64)) * 0.02
    x[::20] = rng.normal(size=(600, 64)) * 0.3
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.search(vectors, vectors.where("vec_id % 100 = 0"), sample=6000))
    score = x[::100] @ x.T
    score[np.arange(len(score)), np.arange(0, len(x), 100)] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, :20]
    assert np.mean([len({v for v, _ in got[q]} & set(b)) / 20 for q, b in zip(range(0, len(x), 100), best.tolist(), strict=True)]) >= 0.95

    x = rng.normal(size=(60_000, 32)) * rng.lognormal(0, 1, size=(60_000, 1))
    index = ann.Index(x[:12_000], len(x))
    place, at = np.argsort(index.order(x[::600]), axis=1), index.cells(x)
    best = np.argsort(-(x[::600] @ x.T), axis=1)[:, 1:21]
    assert np.mean(np.take_along_axis(place, at[best], 1) < index.visits) >= 0.96
