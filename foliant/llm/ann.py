"""Maximum inner product search with score-aware (anisotropic) product quantisation.

Vectors lie in cells around k-means centres. What is left of a vector without its centre is cut into pairs of dimensions with 16 centroids each, so a code
takes four bits a pair. Codebooks and codes minimise a loss in which the residual's part parallel to the vector weighs `eta` times the orthogonal part, since
that part is what changes large inner products. A search scans the codes of a cell with one table of 16 entries a pair for each query (two pairs
to a byte: 256 entries), keeps the best `rerank` of it, or a share of its vectors if that is more, and reranks these by exact inner products in double precision.

Centres and codebooks are fitted on at most `sample` vectors, those least by hashed id; every vector is indexed. There is a cell for each `CELL` vectors, up to one for 40 of the three quarters of the sample that are fitted on (375 by
default; a greater `sample` allows more). A query visits the cells with the greatest expected best score. How many cells, and the share of a cell to rerank, are what queries drawn from the sample, and `ASKED` of the queries themselves (those least by hashed id), need to find the share `FOUND` of their
true neighbours among that quarter of the sample that nothing is fitted on, the greater of both: where vectors have no clusters that is all cells, where clusters are too tight for the codes it is the size of a cluster. The first cells, the
root of their number, give each query its k-th best score so far, and from the others only what reaches it leaves a task. A cell of over `VECTOR_BLOCK` vectors is scanned in blocks, and the queries that visit a cell come in parts of `QUERY_BLOCK`, so a task holds one
block of either and no broadcast grows with the data. A vector is sent once for each part of its cell's queries, a query once for each cell that it visits.
Where the sample allows no more cells (over 384,000 vectors by default), cells hold more vectors and more queries, so that work and shuffle grow faster than the table, unless `sample` is raised
along with it. Equal vectors have equal scores and codes, so each distinct vector is scanned and reranked once and stands for the k + 1 smallest ids
that have it, which it gives only then: others can't be among the k nearest. Recall against brute force is measured in the tests.

Cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null vec_id. Vectors of each length are searched by the queries of
that length. Equal rows are one candidate, rows that share an id but not the vector are several; a query id is asked once, with its least vector, and no row with its
id is a candidate of it; fewer candidates than k give them all; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

QUERY_BLOCK = 2048
VECTOR_BLOCK = 32_768
CELL = 1024
SAMPLE = 20_000
FIT = 4_000  # of the sample, for the codebook
HELD = 4  # one in so many of the sample is not fitted on, but measured on
ASKED = 400  # queries that the search is measured on
FOUND = 0.985
RERANK = 64
ETA = 4.0


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    d = F.col("embedding")
    fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(d, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(fine)


class Codebook:
    """16 centroids for each pair of dimensions, fitted and assigned under the anisotropic loss by coordinate descent.

    What is coded is `x` less its cell's centre; the loss's direction is that of `toward`, the whole vector (`x` itself if not given)."""

    def __init__(self, x: np.ndarray, eta: float = ETA, rounds: int = 6, seed: int = 5, toward: np.ndarray | None = None) -> None:
        self.eta, self.dim = eta, x.shape[1]
        x, unit = self.padded(x), self.directions(x if toward is None else toward)
        rng = np.random.default_rng(seed)
        pairs = x.shape[1] // 2
        self.centroids = np.zeros((pairs, 16, 2))
        for m in range(pairs):  # start: spread along the two coordinates' quantiles
            part = x[:, 2 * m : 2 * m + 2]
            self.centroids[m] = part[rng.integers(0, len(part), 16)] + rng.normal(0, 1e-6, (16, 2))
        codes = self.nearest(x)
        for _ in range(rounds):
            self.update(x, unit, codes)
            codes = self.improved(x, unit, codes)

    def padded(self, x: np.ndarray) -> np.ndarray:
        width = -(-x.shape[1] // 4) * 4
        return np.pad(np.asarray(x, np.float64), ((0, 0), (0, width - x.shape[1])))

    def directions(self, x: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return self.padded(x / np.where(size > 0, size, 1))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        part = x.reshape(len(x), -1, 1, 2)
        return ((part - self.centroids[None]) ** 2).sum(-1).argmin(-1).astype(np.uint8)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return self.centroids[np.arange(codes.shape[1])[None], codes].reshape(len(codes), -1)

    def update(self, x: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> None:
        """Each pair's centroids by weighted least squares, the other pairs' share of the parallel residual held fixed."""
        y = self.decoded(codes)
        extra = self.eta - 1
        for m in range(len(self.centroids)):
            s = slice(2 * m, 2 * m + 2)
            u, part = unit[:, s], x[:, s]
            along = ((x - y) * unit).sum(1) - ((part - y[:, s]) * u).sum(1)
            weight = np.eye(2)[None] + extra * u[:, :, None] * u[:, None, :]
            right = np.einsum("nij,nj->ni", weight, part) + extra * along[:, None] * u
            for c in range(16):
                mine = codes[:, m] == c
                if mine.any():
                    self.centroids[m, c] = np.linalg.solve(weight[mine].sum(0) + 1e-9 * np.eye(2), right[mine].sum(0))
            y[:, s] = self.centroids[m][codes[:, m]]

    def encode(self, x: np.ndarray, toward: np.ndarray | None = None) -> np.ndarray:
        unit, x = self.directions(x if toward is None else toward), self.padded(x)
        return self.improved(x, unit, self.nearest(x))

    def improved(self, x: np.ndarray, unit: np.ndarray, codes: np.ndarray, sweeps: int = 2) -> np.ndarray:
        codes = codes.copy()
        along = ((x - self.decoded(codes)) * unit).sum(1)
        rows = np.arange(len(x))
        for _ in range(sweeps):
            for m in range(len(self.centroids)):
                s = slice(2 * m, 2 * m + 2)
                left = x[:, None, s] - self.centroids[m][None]  # n x 16 x 2
                parallel = (left * unit[:, None, s]).sum(-1)
                rest = along - parallel[rows, codes[:, m]]
                loss = (left**2).sum(-1) + (self.eta - 1) * (rest[:, None] + parallel) ** 2
                codes[:, m] = loss.argmin(1)
                along = rest + parallel[rows, codes[:, m]]
        return codes

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes to a byte."""
        return (codes[:, ::2] << 4) | codes[:, 1::2]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x bytes x 256 partial scores."""
        q = self.padded(queries).reshape(len(queries), -1, 1, 2)
        t = (q * self.centroids[None]).sum(-1)
        return (t[:, ::2, :, None] + t[:, 1::2, None, :]).reshape(len(queries), -1, 256).astype(np.float32)


def centres_of(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 9) -> np.ndarray:
    """k-means from centres drawn by squared distance from those before."""
    rng = np.random.default_rng(seed)
    centres = x[rng.integers(0, len(x), 1)]
    far = ((x - centres[0]) ** 2).sum(1)
    for _ in range(cells - 1):
        new = x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else 0]
        centres = np.concatenate([centres, new[None]])
        far = np.minimum(far, ((x - new) ** 2).sum(1))
    for _ in range(rounds if cells > 1 else 1):
        at = assigned(x, centres)
        n = np.bincount(at, minlength=cells)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def assigned(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([((centres**2).sum(1) - 2 * (x[i : i + 8192] @ centres.T)).argmin(1) for i in range(0, len(x), 8192)]) if len(x) else np.empty(0, np.int64)


class Index:
    """Centres, codebook, and how many cells a query visits, from a sample of the `n` vectors and one of the queries (if none, of the vectors)."""

    def __init__(self, sample: np.ndarray, n: int, k: int = 20, eta: float = ETA, asked: np.ndarray | None = None) -> None:
        x = np.asarray(sample, np.float64)
        unseen = np.arange(len(x)) % HELD == HELD - 1  # what is fitted on the others serves these as it serves rows beyond the sample
        fit = x[~unseen]
        self.centres = centres_of(fit, max(1, min(-(-n // CELL), len(fit) // 40)))
        at = assigned(fit, self.centres)
        left = fit - self.centres[at]
        square = np.bincount(at, weights=(left**2).sum(1), minlength=len(self.centres))
        # The spread along a query's direction, three standard deviations out: where a large cell's best vector may be.
        self.reach = 3 * np.sqrt(square / np.maximum(np.bincount(at, minlength=len(self.centres)), 1) / x.shape[1])
        self.book = Codebook(left[:FIT], eta, toward=fit[:FIT])
        held = np.flatnonzero(unseen) if unseen.any() else np.arange(len(x))
        few = max(1, -(-k * len(held) // n))  # as near among these as the k nearest are among all
        self.visits, self.share = self.needed(x, held, few, x[held[:: max(1, len(held) // ASKED)]])
        if asked is not None and len(asked):  # queries may be of another kind than most vectors
            self.visits, self.share = map(max, zip((self.visits, self.share), self.needed(x, held, few, np.asarray(asked, np.float64)), strict=True))

    def order(self, queries: np.ndarray) -> np.ndarray:
        """Cells of each query, the most promising one first."""
        return np.argsort(-(queries @ self.centres.T + np.linalg.norm(queries, axis=1, keepdims=True) * self.reach[None]), axis=1, kind="stable")

    def needed(self, x: np.ndarray, held: np.ndarray, k: int, asked: np.ndarray) -> tuple[int, float]:
        """(cells to visit, share of a cell to rerank) for the k nearest of `held`, rows of `x`, to each of these queries, equal vectors left out."""
        place = np.argsort(self.order(asked), axis=1)  # a cell's place in the order
        score, own = asked @ x[held].T, {v.tobytes(): j for j, v in enumerate(x[held] + 0.0)}
        for i, v in enumerate(asked + 0.0):
            if v.tobytes() in own and len(held) > 1:
                score[i, own[v.tobytes()]] = -np.inf
        k = min(k, max(1, len(held) - 1))
        best = held[np.argpartition(-score, k - 1, axis=1)[:, :k]]
        at = assigned(x, self.centres)
        rough = asked @ (self.centres[at] + self.book.decoded(self.book.encode(x - self.centres[at], toward=x))[:, : x.shape[1]]).T
        share = np.zeros(best.shape)
        for c in range(len(self.centres)):
            mine, (i, j) = np.flatnonzero(at == c), np.nonzero(at[best] == c)
            if len(i):
                ranked = np.sort(rough[:, mine], axis=1)
                for q in np.unique(i):
                    of = j[i == q]
                    share[q, of] = (len(mine) - np.searchsorted(ranked[q], rough[q, best[q, of]])) / len(mine)
        at_share = lambda v: np.sort(v.ravel())[min(v.size - 1, int(FOUND * v.size))]
        return int(at_share(np.take_along_axis(place, at[best], 1))) + 1, float(at_share(share))

    def depth(self, n: int, rerank: int = RERANK) -> int:
        """How many of a block of `n` vectors get an exact score."""
        return min(n, max(rerank, int(np.ceil(n * self.share)))) + 1

    def cells(self, x: np.ndarray) -> np.ndarray:
        return assigned(x, self.centres)

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return self.book.packed(self.book.encode(x - self.centres[cells], toward=x))


def scan(book: Codebook, queries: np.ndarray, codes: np.ndarray, keep: int, without: list[np.ndarray] | None = None) -> np.ndarray:
    """Rows of the `keep` best approximate scores of each query, ties to earlier rows; codes is rows x bytes. The rows that `without` has for a query come last."""
    keep = min(keep, len(codes))
    out = np.empty((len(queries), keep), np.int64)
    columns = np.ascontiguousarray(codes.T)
    for i in range(0, len(queries), 64):
        tables = book.tables(queries[i : i + 64])
        score = tables[:, 0].take(columns[0], axis=1)
        for m in range(1, len(columns)):
            score += tables[:, m].take(columns[m], axis=1)
        if keep == len(codes):
            out[i : i + 64] = np.arange(keep)
            continue
        for j, rows in enumerate(without[i : i + 64] if without else ()):
            score[j, rows] = -np.inf
        least = np.partition(score, len(codes) - keep, axis=1)[:, len(codes) - keep]
        for j in range(len(score)):
            over, ties = np.flatnonzero(score[j] > least[j]), np.flatnonzero(score[j] == least[j])
            out[i + j] = np.r_[over, ties[: keep - len(over)]]
    return out


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of `vectors` found for each of `queries`, its own id left out."""
    rows, asked = usable(vectors), usable(queries)
    # One row of the k + 1 smallest ids a vector; a third of all rows may hold the same.
    few = rows.withColumn("copy", F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("copy") <= k + 1)
    distinct = written(few.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "embedding", "ids", F.size("embedding").alias("n")))
    asked = written(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("n", F.size("embedding")))
    sizes = {r.n: r["count"] for r in distinct.groupBy("n").count().collect()}  # lengths of vectors, not vectors
    lengths = sorted(sizes.keys() & {r.n for r in asked.select("n").distinct().collect()})
    found = [_found(distinct.where(F.col("n") == n).drop("n"), asked.where(F.col("n") == n).drop("n"), sizes[n], k, rerank, sample) for n in lengths]
    if not found:
        return vectors.sparkSession.createDataFrame([], RESULT)
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return _best(found[0], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _found(distinct: DataFrame, asked: DataFrame, n: int, k: int, rerank: int, sample: int) -> DataFrame:
    """(query_id, vec_id, score) of the best in each cell that a query visits; all vectors have one length."""
    some = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    queries = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ASKED).select("embedding").collect()
    index = Index(np.array([r.embedding for r in some], np.float64), n, k, asked=np.array([r.embedding for r in queries], np.float64))
    kind = distinct.schema["embedding"].dataType.simpleString()

    def placed(batches):
        for b in batches:
            if len(b):
                x = np.stack(b["embedding"]).astype(np.float64)
                b["cell"] = index.cells(x).astype(np.int32)
                b["code"] = list(map(bytes, index.codes(x, b["cell"].to_numpy())))
                yield b

    def visiting(batches):
        for b in batches:
            if len(b):
                b["cells"] = list(index.order(np.stack(b["embedding"]).astype(np.float64))[:, : index.visits].astype(np.int32))
                yield b

    coded = written(distinct.mapInPandas(placed, f"vec_id long, embedding {kind}, ids array<long>, cell int, code binary"))
    visits = asked.mapInPandas(visiting, f"vec_id long, embedding {asked.schema['embedding'].dataType.simpleString()}, cells array<int>")
    visits = written(visits.select("vec_id", "embedding", F.posexplode("cells").alias("turn", "cell")))
    first = int(np.ceil(np.sqrt(index.visits)))
    near = written(_scanned(coded, visits.where(F.col("turn") < first).withColumn("least", F.lit(None).cast("double")), index, k, rerank))
    if first == index.visits:
        return near
    least = _best(near, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    return near.unionByName(_scanned(coded, visits.where(F.col("turn") >= first).join(least, "vec_id", "left"), index, k, rerank))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scanned(coded: DataFrame, visits: DataFrame, index: Index, k: int, rerank: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best in each block that a query visits, of a score of `least` or more."""
    cells = coded.groupBy("cell").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("blocks"))
    parts = visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
    shape = F.broadcast(written(cells.join(parts, "cell")))  # a row a cell
    block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks")).cast("int").alias("block")
    part = F.pmod(F.xxhash64("vec_id", F.lit(4)), F.col("parts")).cast("int").alias("part")
    vector_rows = coded.join(shape, "cell").select("cell", block, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "embedding", "ids", "code")
    query_rows = visits.join(shape, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part, "vec_id", "embedding", "least")

    def nearest(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        v = v.sort_values("vec_id", kind="stable")
        ids, copies, x = v["vec_id"].to_numpy(), v["ids"].to_list(), np.stack(v["embedding"]).astype(np.float64)
        codes = np.frombuffer(b"".join(v["code"]), np.uint8).reshape(len(v), -1)
        asked_ids, asked_x = q["vec_id"].to_numpy(), np.stack(q["embedding"]).astype(np.float64)
        least = q["least"].astype(float).fillna(-np.inf).to_numpy()
        alone: dict[int, list[int]] = {}  # vectors that one id has for itself: no candidates of its own query
        for row, held in enumerate(copies):
            if len(held) == 1:
                alone.setdefault(int(held[0]), []).append(row)
        own = [np.array(alone.get(int(x), ()), np.int64) for x in asked_ids]
        picked = scan(index.book, asked_x, codes, index.depth(len(v), rerank), own)
        out = []
        for i, few in enumerate(picked):
            few = few[~np.isin(few, own[i])] if len(own[i]) else few
            score = (x[few] * asked_x[i]).sum(1)
            best = np.lexsort((ids[few], -score))[: k + 1]
            best = best[score[best] >= least[i]]
            each = [np.asarray(copies[j]) for j in few[best]]
            score, each = np.repeat(score[best], list(map(len, each))), np.concatenate([*each, np.empty(0, np.int64)])
            score, each = score[each != asked_ids[i]], each[each != asked_ids[i]]
            best = np.lexsort((each, -score))[:k]
            out.append((np.full(len(best), asked_ids[i]), each[best], score[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    unit = ("cell", "block", "part")
    return query_rows.groupBy(*unit).cogroup(vector_rows.groupBy(*unit)).applyInPandas(nearest, "query_id long, vec_id long, score double")
