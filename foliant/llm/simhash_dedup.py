"""SimHash fingerprints and near-duplicate groups by a binary trie joined with itself.

A fingerprint has 64 bits: bit b is set if over half the XXH64 values (seed 42) of a document's four-word shingles set it.

Two fingerprints link at `budget` or fewer differing bits. Of `budget + 1` blocks of bits at least one is then equal, so there are as many tries, each with another block's bits as its first
levels (the others follow in turn). A trie is joined with itself: pairs of nodes descend together, a bit a level, and add up the bits in which they differ; a pair ends when these exceed the
budget, which is 0 within the trie's own block and `budget` below it. Leaves are buckets of up to `BUCKET` fingerprints, whose members compare the rest of their paths at once; a pair whose members
are one group already ends too, since it can only repeat a link. Half the budget is joined first, so that a cluster is one group before its far pairs come up. Pairs are visited in blocks of
arrays, so the memory for them is bounded.

How tries are spread: within its block a node can meet itself only, so the subtrees below the first `DEALT` levels are dealt to tasks, neighbours together up to about `TASK` fingerprints, by their
counts, of which there are (budget + 1) * 2 ** DEALT at most. Each task descends from its trie's root and gives a spanning forest of its links, not all pairs; `components` joins the forests.

`one_of_each` keeps one document of each group of near copies, five-word shingles with a Jaccard similarity of 0.8 or more: the trie over five-word
fingerprints gives links, which exact similarities confirm, and the pairs that a Hamming budget can't reach (a pair at 0.8 differs in about ten of 64 bits) come from `near_copies`, which
looks among texts that are not in one group yet.

Members are eight bytes each and distinct, so copies never meet in one subtree. A subtree with more than `SPLIT` members is cut by further bits into child nodes, and each child is sent with
the children within the budget, so one task holds a few children only.

Cases: null, empty and blank texts have fingerprint zero and link like any other; a text of fewer words than a shingle is one shingle;
rows that share a doc_id are each returned, and count as one node of the graph; a null doc_id gets its group's smallest id, if there
is one; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .rolling import chunks, gathered, trimmed
from .shared import components, written

DEALT = 13
TASK = 1 << 14
SPLIT = 1 << 18
PAIRS = 1 << 16
BUCKET = 8


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        spans = [line]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
        spans = [line[a:b] for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in spans), np.uint64, len(spans))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches):
        for b in chunks(batches):
            values = np.array([fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row for each row of `docs`; fp is the fingerprint as a signed 64-bit integer."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(_fingerprints(shingle, seed)), "doc_id long, fp long")


def blocks(budget: int) -> list[tuple[int, int]]:
    """(first level, how many) of budget + 1 runs of a fingerprint's bits, from its greatest bit on."""
    cut = np.linspace(0, 64, budget + 2).round().astype(int).tolist()
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


class Trie:
    """A binary trie over distinct fingerprints: sorted, so that a node is a range of them, and one level's bit parts it."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values)
        self.group = np.arange(len(self.values))
        self.zeros: dict[int, np.ndarray] = {}
        self.changes = np.zeros(len(self.values), np.int64)
        self._regroup()

    def parted(self, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
        """Where the second child of each node begins."""
        if level not in self.zeros:
            bit = (self.values >> np.uint64(63 - level)) & np.uint64(1)
            self.zeros[level] = np.concatenate([[0], np.cumsum(bit == 0)]).astype(np.int32)
        zeros = self.zeros[level]
        return low + zeros[high] - zeros[low]

    def _regroup(self) -> None:
        self.changes[1:] = np.cumsum(self.group[1:] != self.group[:-1])

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Makes linked members one group; of the links (a, b) those that were needed, a forest."""
        needed = []
        while True:
            x, y = self.group[a], self.group[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((low, high))
            first = order[np.r_[True, high[order][1:] != high[order][:-1]]]  # each group hooks on one smaller one
            needed.append((a[first], b[first]))
            parent = np.arange(len(self.values))
            parent[high[first]] = low[first]
            while (parent != parent[parent]).any():
                parent = parent[parent]
            self.group = parent[self.group]
        if not needed:
            return np.empty((0, 2), np.int64)
        self._regroup()
        return np.stack([np.concatenate(x) for x in zip(*needed, strict=True)], axis=1)

    def one_group(self, a, b, c, d) -> np.ndarray:
        whole = (self.changes[a] == self.changes[b - 1]) & (self.changes[c] == self.changes[d - 1])
        return whole & (self.group[a] == self.group[c])


def trie_join(values: np.ndarray, budget: int, same: int = 0, visited: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest over `values` (uint64): the trie joined with itself. Nothing may differ in the first `same` levels. `visited` gets the number of pairs of
    nodes that were looked at."""
    trie, links, seen = Trie(values), [], 0
    values = trie.values
    one = lambda x: np.array([x], np.int64)
    shared = 64 - int(values[0] ^ values[-1]).bit_length() if len(values) > 1 else 64  # levels above the first fork
    slot = np.arange(BUCKET)
    # Half the budget first: what it joins is no longer paired by the whole one.
    for most in sorted({budget // 2, budget}) if len(values) > 64 else [budget]:
        stack = [(shared, one(0), one(len(values)), one(0), one(len(values)), one(0))] if len(values) > 1 else []
        while stack:
            level, a, b, c, d, spent = stack.pop()
            seen += len(a)
            leaves = (b - a <= BUCKET) & (d - c <= BUCKET)
            if leaves.any():
                at = np.flatnonzero(leaves)
                if len(links):
                    at = at[~trie.one_group(a[at], b[at], c[at], d[at])]
                i, j = (np.minimum(x[at][:, None] + slot, y[at][:, None] - 1) for x, y in ((a, b), (c, d)))
                rest = values[i][:, :, None] ^ values[j][:, None, :]
                near = np.bitwise_count(rest) <= most
                if same:
                    near &= rest >> np.uint64(64 - same) == 0
                k, x, y = np.nonzero(near)
                i, j = i[k, x], j[k, y]
                if (i != j).any():
                    links.append(trie.joined(i[i != j], j[i != j]))
            open_ = ~leaves & ~trie.one_group(a, b, c, d)
            if level == 64 or not open_.any():
                continue
            a, b, c, d, spent = (x[open_] for x in (a, b, c, d, spent))
            m, n = trie.parted(a, b, level), trie.parted(c, d, level)
            pairs = [(a, m, c, n, spent), (m, b, n, d, spent)]
            if level >= same:
                other = (a != c) | (b != d)  # a node with itself has its children's pair once
                pairs += [(a, m, n, d, spent + 1), tuple(x[other] for x in (m, b, c, n, spent + 1))]
            pairs = [np.concatenate(x) for x in zip(*pairs, strict=True)]
            kept = (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & (pairs[4] <= most)
            pairs = [x[kept] for x in pairs]
            for i in range(0, len(pairs[0]), PAIRS):
                stack.append((level + 1, *(x[i : i + PAIRS] for x in pairs)))
    if visited is not None:
        visited.append(seen)
    out = values.view(np.int64)
    return [(int(out[i]), int(out[j])) for some in links for i, j in some.tolist()]


def _joined(budget: int):
    """Rows (root, turn, fp) sorted by root, to links; `turn` is how far the fingerprints were rotated to bring their trie's block to the top."""
    widths = dict(blocks(budget))

    def links(turn, fps):
        found = trie_join(fps.view(np.uint64), budget, widths[turn])
        back = lambda x: ((x := x.view(np.uint64)) >> np.uint64(turn) | x << np.uint64(64 - turn) if turn else x).view(np.int64)
        for i in range(0, len(found), 50_000):
            a, b = np.array(found[i : i + 50_000], np.int64).T.copy()
            yield pa.RecordBatch.from_pydict({"a": pa.array(back(a)), "b": pa.array(back(b))})

    def run(batches):
        name, turn, held = None, 0, []
        for batch in gathered(batches):
            if not batch.num_rows:
                continue
            roots, turns, fps = (np.asarray(batch.column(c)) for c in ("root", "turn", "fp"))
            cut = np.flatnonzero(np.r_[True, roots[1:] != roots[:-1]])
            for start, end in zip(cut.tolist(), [*cut[1:].tolist(), len(roots)]):
                if roots[start] != name:
                    if held:
                        yield from links(turn, np.concatenate(held))
                    name, turn, held = roots[start], int(turns[start]), []
                held.append(fps[start:end])
        if held:
            yield from links(turn, np.concatenate(held))

    return run


def links(nodes: DataFrame, budget: int = 4, split: int = SPLIT) -> DataFrame:
    """(a, b): for distinct fingerprints `fp`, links that connect whatever is within the budget."""
    turned = lambda k: F.shiftleft("fp", k).bitwiseOR(F.shiftrightunsigned("fp", 64 - k)) if k else F.col("fp")
    tries = F.array(*(F.struct(F.lit(k).alias("turn"), turned(k).alias("fp")) for k, _ in blocks(budget)))
    dealt = min(DEALT, *(n for _, n in blocks(budget)))
    rows = nodes.select(F.explode(tries).alias("t")).select("t.turn", "t.fp", F.shiftrightunsigned("t.fp", 64 - dealt).alias("prefix"))
    counts = sorted(map(tuple, rows.groupBy("turn", "prefix").count().collect()))  # (budget + 1) * 2 ** DEALT rows at most
    roots, root, size, last = [], -1, 0, None
    for turn, prefix, n in counts:
        if n > split:
            roots.append((turn, prefix, None))
            continue
        if turn != last or size + n > TASK:
            root, size, last = root + 1, 0, turn
        size += n
        roots.append((turn, prefix, root))
    deal = nodes.sparkSession.createDataFrame(roots, "turn int, prefix long, root long")
    rows = rows.join(F.broadcast(deal), ["turn", "prefix"])
    small = rows.where("root IS NOT NULL").select("root", "turn", "fp")
    if all(r is not None for _, _, r in roots):
        every = small
    else:
        # A heavy subtree: its members by twelve scattered bits, each part with the parts that differ by no more than the budget.
        part = F.lit(0)
        for i, bit in enumerate(range(2, 64, 5)):
            part = part.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", bit).bitwiseAND(F.lit(1)).cast("int"), i))
        near = [x for x in range(1 << 13) if x.bit_count() <= (budget + 1) // 2]
        parts = F.transform(F.array(*map(F.lit, near)), lambda x: x.bitwiseXOR(part))
        large = rows.where("root IS NULL").select("turn", "fp", "prefix", F.explode(parts).alias("part"))
        every = small.unionByName(large.select((-1 - F.abs(F.xxhash64("turn", "prefix", "part") % (1 << 62))).alias("root"), "turn", "fp"))
    return every.repartition("root").sortWithinPartitions("root").mapInArrow(trimmed(_joined(budget)), "a long, b long")


def groups(docs: DataFrame, shingle: int = 4, seed: int = 42, budget: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of `docs`: component_id is the smallest doc_id reachable by links."""
    rows = written(fingerprints(docs, shingle, seed))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tree = components(links(nodes.select("fp"), budget))
    named = nodes.join(tree, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written, so that the join deals both sides anew and AQE can split a component of many fingerprints.
    smallest = written(named.groupBy("root").agg(F.min("least").alias("component_id")))
    of = named.join(smallest, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_links(texts: DataFrame, budget: int = 4) -> DataFrame:
    """(a, b): links that connect all near copies among `texts` (node, text), where equal nodes have equal texts."""
    fps = written(fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), near_copies.WIDTH).select(F.col("doc_id").alias("node"), "fp"))
    heads = written(fps.groupBy("fp").agg(F.min("node").alias("head")))
    same = fps.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    end = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    across = links(heads.select("fp"), budget).join(end("a"), "a").join(end("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    pairs = written(same.unionByName(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return near_copies.links(texts, near_copies.confirmed(pairs, texts))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay when one document of each group of near copies does: that with the smallest id, a null id last. Documents are told
    apart by id and text, so rows that share an id, or have none, go or stay by their texts. All columns stay.

    Equal texts, told apart by 128 bits, become one row by a join on narrow keys first, so a text that a third of all rows hold costs one row from there on; each gets a number, which
    is unique, so that no two texts are one in what follows."""
    text_key = F.md5(F.concat(F.when(F.col("text").isNull(), "0").otherwise("1"), F.coalesce("text", F.lit(""))))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.unhex(text_key).alias("key"))
    first = written(rows.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first")).select("key", F.col("first.id").alias("least"), F.monotonically_increasing_id().alias("node")))
    one = written(rows.join(first.withColumnRenamed("key", "of"), (F.col("key") == F.col("of")) & F.col("id").eqNullSafe(F.col("least"))).select("row", "node"))
    tree = components(near_links(one.select("node", F.col("row.text").alias("text"))))
    group = first.join(tree.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").groupBy(F.coalesce("root", "node").alias("root"))
    kept = group.agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key", "node")).alias("first")).select(F.col("first.node").alias("node"))
    return one.join(kept, "node", "left_semi").dropDuplicates(["node"]).select("row.*")
