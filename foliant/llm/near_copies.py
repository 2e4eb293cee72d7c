"""Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Shingles have a fixed order, seldom ones first as counted on a sample. Of two sets that reach the similarity, the first n - ceil(0.8 n) + 1
shingles of either have one in common, so texts meet by these keys only. A pair that shares fewer keys than its sizes ask for can't reach 0.8
and ends there; the others are confirmed on their whole texts. A Hamming budget on fingerprints would miss some pairs at any width.

This is the exact half of `simhash_dedup.one_of_each`, which gives the links that its trie found; pairs within one of their groups are not asked again.

Links are wanted, not all pairs. The members of a key with more than `SMALL` texts meet as sketches: bit h of a text's sketch is the parity of its shingles that
fall on h, so the bits in which two sketches differ are no more than the shingles in which the sets differ, and a pair with more of them than 0.8 allows ends there: no pair is missed. Sets of over
`WHOLE` shingles are sketched by the shingles with l low zero bits, and a pair may differ by `SIGMAS` standard deviations more: of such pairs about one in 10 ** 11 is missed there.

Members of large keys meet in three rounds, of which each leaves out what the ones before have joined. In the first each text has its least large key only, which near copies mostly share, so a group of
them meets once, not once for each key; in the others every key whose members are in more than one component. The first two give a forest of each key; the last all that may be near and is in different
components still. Links are confirmed after each round. A forest takes pairs that are near beyond the sketches' doubt as they come and the others nearest first, since a pair that is refused later keeps
its key's other pairs between the same components from being asked in that round. So what a large group of near copies gives is about a tree for each key; what the last round adds are pairs of different
components that the sketches can't tell from near ones: similarities of 0.79 and more up to `WHOLE` shingles, of about 0.7 and more beyond. Members in a key's largest component are compared with those outside only; members
that are no near copies are still all compared within the task.

Cases: null, empty and blank texts are alike; a text of fewer words than a shingle is one shingle; an empty table gives no links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import byte_table, chunks, gathered, mix, prefix_hash, slice_hash, text_bytes, trimmed
from .shared import components, written

WIDTH = 5
SMALL = 32
SAMPLE = 20_000
COMMON = 1 << 17
WHOLE, BITS, SIGMAS = 1024, 4096, 7.0
SURE = 3.0
HELD = 1 << 18
PAIRS = "a long, b long, na int, nb int, key long"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(texts, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(texts)
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(word & (~np.r_[False, word[:-1]][: len(word)] | edge[:-1]))
    end = np.flatnonzero(word & (~np.r_[word[1:], False][: len(word)] | edge[1:])) + 1
    value = mix(slice_hash(prefix_hash(LOWER[data], byte_table(43)), start, end))
    cut = np.searchsorted(start, offsets)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        k = min(width, b - a)
        m = b - a - k + 1 if k else 1
        total = np.zeros(m, np.uint64)
        for i in range(k):
            total = total * np.uint64(0x9E3779B97F4A7C15) + value[a + i : a + i + m]
        out.append(np.unique(mix(total + np.uint64(k))))
    return out


def _shingles(batches):
    for b in chunks(batches):
        yield pa.RecordBatch.from_pydict({"key": np.concatenate(shingle_sets(b.column("text"))).view(np.int64)})


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, how often each was seen) of shingles that several texts of a sample share; only the order of keys depends on it."""
    step = max(1, -(-texts.count() // SAMPLE))
    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(step)) == 0).dropDuplicates(["node"]).select("text")
    seen = some.mapInArrow(trimmed(_shingles), "key long").groupBy("key").count().where("count > 2").orderBy(F.desc("count"), "key").limit(COMMON).toArrow()
    key, n = (np.asarray(seen.column(i).combine_chunks()) for i in (0, 1))
    key = key.astype(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], n[order].astype(np.int64)


def _keys(common: np.ndarray, seen: np.ndarray):
    def run(batches):
        had: set[int] = set()  # equal rows meet in one task
        for b in chunks(batches):
            nodes = b.column("node").to_pylist()
            b = b.filter(pa.array([not (n in had or had.add(n)) for n in nodes], pa.bool_()))
            if not b.num_rows:
                continue
            out, sizes = [], []
            for s in shingle_sets(b.column("text")):
                rank = np.zeros(len(s), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    rank = np.where(common[at] == s, seen[at], 0)
                out.append(s[np.lexsort((s, rank))[: len(s) - (4 * len(s) + 4) // 5 + 1]])
                sizes.append(len(s))
            times = np.array([len(x) for x in out], np.int64)
            nodes = np.asarray(b.column("node"))
            keys = np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_pydict({"key": keys, "node": np.repeat(nodes, times), "n": np.repeat(np.array(sizes, np.int32), times)})

    return trimmed(run)


def _runs(batches, columns):
    """Whole runs of equal keys as arrays, of batches sorted by key."""
    held = None
    for b in gathered(batches):
        if not b.num_rows:
            continue
        part = [np.asarray(b.column(c)) for c in columns]
        if held is not None:
            part = [np.concatenate(x) for x in zip(held, part, strict=True)]
        last = int(np.searchsorted(part[0], part[0][-1]))
        held = [x[last:] for x in part]
        if last:
            yield [x[:last] for x in part]
    if held is not None:
        yield held


def _batch(node, n, i, j, key=None):
    a, b = node[i], node[j]
    turn = a > b
    na, nb = np.where(turn, n[j], n[i]), np.where(turn, n[i], n[j])
    key = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), pa.array(na, pa.int32()), pa.array(nb, pa.int32()), key], ["a", "b", "na", "nb", "key"])


def _small_pairs(batches):
    """Pairs of small runs, with a null key; (node, null, key) for each member of a large one."""
    for key, node, n in _runs(batches, ("key", "node", "n")):
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node, n = key[new], node[new], n[new]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        large = np.repeat(size > SMALL, size)
        for d in range(1, SMALL):
            i = np.flatnonzero((key[d:] == key[:-d]) & ~large[d:])
            if not len(i):
                break
            i = i[5 * n[i] >= 4 * n[i + d]]
            if len(i):
                yield _batch(node, n, i, i + d)
        if large.any():
            m = int(large.sum())
            yield pa.RecordBatch.from_arrays([pa.array(node[large]), pa.nulls(m, pa.int64()), pa.array(n[large], pa.int32()), pa.nulls(m, pa.int32()), pa.array(key[large])], ["a", "b", "na", "nb", "key"])


def level(n: int) -> int:
    """How many low bits of a shingle are zero, for about `WHOLE` of n shingles at most to be sketched."""
    return max(0, int(np.ceil(np.log2(max(1, n) / WHOLE))))


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the set at its own level and at the next, which sets of like size may have."""
    at, out = level(len(shingles)), []
    for x in (at, at + 1):
        some = shingles[(shingles & np.uint64((1 << x) - 1)) == 0] >> np.uint64(40)
        out.append(np.packbits((np.bincount((some % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(bool)).tobytes())
    return b"".join(out)


def _sketches(batches):
    for b in chunks(batches):
        sets = shingle_sets(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([level(len(x)) for x in sets], pa.int32()), pa.array([sketch(x) for x in sets], pa.binary())], ["node", "level", "sketch"])


def _reachable(n, levels, own, above, i: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the members j, not smaller than i: those that may be near it, and by how many deviations the shingles in which they seem to differ are fewer than 0.8 allows."""
    higher = levels[j] > levels[i]
    mine = np.where(higher[:, None], above[i][None], own[i][None])
    apart = np.bitwise_count(mine ^ own[j]).sum(axis=1, dtype=np.int64)
    most = (n[i] + n[j].astype(np.int64)) // 9  # shingles in which sets at 0.8 differ
    share = most / np.exp2(levels[j])
    fine = apart <= np.where(levels[j] == 0, most, share + SIGMAS * np.sqrt(share) + 3)
    j, apart, share = j[fine], apart[fine], share[fine]
    differ = np.log1p(-2 * apart / BITS) * (-BITS / 2)  # so many shingles leave that many odd bits
    # All shingles are sketched at level 0, so only those that fall on one bit make a deviation there.
    deviation = np.where(levels[j] == 0, 0.5 + share * np.sqrt(2 / BITS), np.sqrt(share + 1))
    return j, np.where(apart == 0, np.inf, (share - differ) / deviation)


def _spanning(i, j, slack, label):
    """Of the pairs (i, j) those that join the components, nearest first."""
    parent, taken = {x: x for x in np.unique(label).tolist()}, []

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    order = np.argsort(-slack, kind="stable")
    for at, x, y in zip(order.tolist(), label[i[order]].tolist(), label[j[order]].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            taken.append(at)
            if len(taken) == len(parent) - 1:
                break
    return i[taken], j[taken], slack[taken]


def _met(size, deep, own, above, label, forest: bool):
    """Of the members of one key, smaller ones first: pairs (i, j) in different components that may be near; with `forest` only as many as join them."""
    kinds, count = np.unique(label, return_counts=True)
    outside = np.flatnonzero(label != kinds[count.argmax()])  # members of the largest component meet nobody else
    out, left = np.zeros(len(size), bool), len(kinds)
    out[outside] = True
    doubted, held = [], 0
    for i in range(len(size) - 1):
        if forest and left == 1:
            return
        stop = i + 1 + int(np.searchsorted(4 * size[i + 1 :].astype(np.int64), 5 * int(size[i]), "right"))
        j = np.arange(i + 1, stop) if out[i] else outside[np.searchsorted(outside, i, "right") : np.searchsorted(outside, stop)]
        j = j[label[j] != label[i]]
        if not len(j):
            continue
        j, slack = _reachable(size, deep, own, above, i, j)
        if forest and len(j):
            order = np.argsort(-slack, kind="stable")
            first = order[np.sort(np.unique(label[j[order]], return_index=True)[1])]  # of each component the nearest
            j, slack = j[first], slack[first]
            sure = slack >= SURE
            if not sure.all():
                doubted.append((np.full(int((~sure).sum()), i), j[~sure], slack[~sure]))
                held += len(doubted[-1][0])
            j = j[sure]
            label[np.isin(label, label[j])] = label[i]
            left -= len(j)
            if held > HELD:
                doubted = [_spanning(*map(np.concatenate, zip(*doubted, strict=True)), label)]
                held = len(doubted[0][0])
        if len(j):
            yield np.full(len(j), i), j
    if doubted:
        yield _spanning(*map(np.concatenate, zip(*doubted, strict=True)), label)[:2]


def _large_pairs(forest: bool):
    """Pairs of the members of each key, of batches sorted by key and size."""

    def run(batches):
        for key, node, n, root, levels, sketches in _runs(batches, ("key", "a", "na", "root", "level", "sketch")):
            bits = np.frombuffer(b"".join(sketches.tolist()), np.uint64).reshape(len(node), 2, -1)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for s, e in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
                label = np.unique(root[s:e], return_inverse=True)[1]
                if len(label) and label.max() > 0:
                    for i, j in _met(n[s:e], levels[s:e], bits[s:e, 0], bits[s:e, 1], label, forest):
                        yield _batch(node, n, i + s, j + s)

    return trimmed(run)


def _confirmed(batches):
    for b in chunks(batches, "x"):
        x, y = shingle_sets(b.column("x")), shingle_sets(b.column("y"))
        # inter / (|x| + |y| - inter) >= 4 / 5
        near = pa.array([9 * len(np.intersect1d(p, q, assume_unique=True)) >= 4 * (len(p) + len(q)) for p, q in zip(x, y, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(near), b.column("b").filter(near)], ["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of `pairs` that reach the similarity by their whole texts."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = written(texts.join(asked, "node", "left_semi").dropDuplicates(["node"]))
    both = pairs.select("a", "b").join(some.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(some.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return written(both.mapInArrow(trimmed(_confirmed), "a long, b long"))


def _apart(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """Those of `pairs` whose ends are not in one component."""
    root = lambda c: tree.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    both = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return both.where(F.col("root_a").isNull() | F.col("root_b").isNull() | (F.col("root_a") != F.col("root_b"))).drop("root_a", "root_b")


def links(texts: DataFrame, sure: DataFrame) -> DataFrame:
    """(a, b): `sure`, which are links already, and more that connect whatever is near, of `texts` (node, text) where equal nodes have equal texts."""
    keys = texts.mapInArrow(_keys(*common_shingles(texts)), "key long, node long, n int")
    found = written(keys.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(_small_pairs, PAIRS))
    # Common shingles are c of the keys, and beyond the keys of one side no more than it has left.
    rest = F.greatest(F.ceil(F.col("na") * 4 / 5), F.ceil(F.col("nb") * 4 / 5)) - 1
    pairs = found.where("b IS NOT NULL").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.count("*").alias("c"))
    reach = pairs.where(F.col("c") + rest >= F.ceil((F.col("na") + F.col("nb")) * 4 / 9))
    near = sure.unionByName(confirmed(written(_apart(reach, components(sure))), texts))
    members = found.where("b IS NULL").select("key", "a", "na")
    if members.isEmpty():
        return near
    asked = written(texts.join(members.select(F.col("a").alias("node")).distinct(), "node", "left_semi").mapInArrow(trimmed(_sketches), "node long, level int, sketch binary").dropDuplicates(["node"]))
    members = written(members)
    least = members.groupBy("a").agg(F.min("key").alias("key"), F.first("na").alias("na"))
    sketches = asked.select(F.col("node").alias("a"), "level", "sketch")
    for some, forest in ((least, True), (members, True), (members, False)):
        placed = some.join(components(near), F.col("a") == F.col("node"), "left").select("key", "a", "na", F.coalesce("root", "a").alias("root"))
        if some is members:
            mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
            placed = placed.join(mixed, "key", "left_semi")
        met = placed.join(sketches, "a").select("key", "a", "na", "root", "level", "sketch")
        more = met.repartition("key").sortWithinPartitions("key", "na", "a").mapInArrow(_large_pairs(forest), PAIRS).select("a", "b").distinct()
        near = near.unionByName(confirmed(written(more), texts))
    return near
