"""Token counts that follow edits, by a stored segment tree of pre-tokens for each document.

A document is a row of leaves of `LEAF` to twice as many pre-tokens; a binary tree over them holds each subtree's characters and tokens. `build` encodes
the texts once and gives the trees as a table (doc_id, text, count, chars, tokens): pre-tokens of each leaf, and the sums as heaps, root first. `apply` reads
such a table, with edits, and gives the changed trees back for the next batch of edits; nothing but what edits touch is encoded again.

An edit (start, removed, text) goes down the tree by characters to the leaves it touches. These are split into pre-tokens again, with context to the
left, since a pre-token may depend on what follows it, and to the right, until a new boundary falls on an old leaf's: from there on the
splitter sees what it saw before, so the rest stands. Only the re-split pre-tokens are encoded; sums change along the paths to the root.

Cases: a null or empty text has no tokens and can be inserted into; positions and lengths beyond the text are cut to it, null ones count
as 0 and a null inserted text as empty; edits apply in the order given, each to the text as the last one left it; no edits leave the count; a text that
holds a special token's own string is encoded anew as a whole; rows that share a doc_id are each counted; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import chunks, trimmed
from .tokens import END, Encoder, encoder, vocabulary_path

LEAF = 32
EDITS = "array<struct<start:int,removed:int,text:string>>"
TREES = "doc_id long, text string, count array<int>, chars array<int>, tokens array<int>"


def _heap(leaves: list[int], size: int) -> list[int]:
    """Sums of a binary tree over `size` leaves: node i has the children 2i and 2i + 1."""
    heap = [0] * size + leaves + [0] * (size - len(leaves))
    for i in range(size - 1, 0, -1):
        heap[i] = heap[2 * i] + heap[2 * i + 1]
    return heap


class Tree:
    def __init__(self, text: str, coder: Encoder) -> None:
        self.coder, self.encoded = coder, 0
        self.build(text)

    @classmethod
    def stored(cls, text: str, count: list[int], chars: list[int], tokens: list[int], coder: Encoder) -> Tree:
        """A tree as `row` gave it; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.coder, tree.encoded, tree.special, tree.size = coder, 0, END in text, len(count)
        tree.count, tree.chars, tree.tokens = count, chars, tokens
        ends = accumulate(chars[tree.size :])
        at, tree.text = 0, []
        for end in ends:
            tree.text.append(text[at:end])
            at = end
        return tree

    def row(self) -> tuple[str, list[int], list[int], list[int]]:
        return self.all(), self.count, self.chars, self.tokens

    def pretokens(self, text: str) -> tuple[list[str], list[int]]:
        words, ids = self.coder.words(text)
        return words, [len(x) >> 2 for x in ids]

    def leaves(self, words: list[str], sizes: list[int]) -> list[tuple[str, int, int]]:
        """(text, tokens, pre-tokens) of each leaf; the last takes what is left over."""
        n = max(1, len(words) // LEAF)
        return [("".join(words[a:b]), sum(sizes[a:b]), b - a) for a, b in zip(range(0, n * LEAF, LEAF), [*range(LEAF, n * LEAF, LEAF), len(words)], strict=True)]

    def build(self, text: str) -> None:
        words, sizes = self.pretokens(text)
        self.special = END in text
        self.encoded += len(words)
        self.plant(self.leaves(words, sizes))

    def plant(self, leaves: list[tuple[str, int, int]]) -> None:
        """A tree over these leaves with room for as many again."""
        self.size = 1 << (2 * len(leaves) - 1).bit_length()
        more = self.size - len(leaves)
        self.text, self.count = [t for t, _, _ in leaves] + [""] * more, [n for _, _, n in leaves] + [0] * more
        self.chars, self.tokens = _heap([len(t) for t, _, _ in leaves], self.size), _heap([k for _, k, _ in leaves], self.size)

    def find(self, at: int) -> tuple[int, int]:
        """Leaf with character `at`, and the characters before that leaf."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at - before >= self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def put(self, leaf: int, text: str, tokens: int, n: int) -> None:
        self.text[leaf], self.count[leaf] = text, n
        i = leaf + self.size
        chars, tokens = len(text) - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += chars
            self.tokens[i] += tokens
            i >>= 1

    def all(self) -> str:
        return "".join(self.text)

    def edit(self, start: int | None, removed: int | None, text: str | None) -> None:
        length = self.chars[1]
        start = min(max(0, start or 0), length)
        removed, text = min(max(0, removed or 0), length - start), text or ""
        if not length or self.special:
            whole = self.all()
            return self.build(whole[:start] + text + whole[start + removed :])
        first, before = self.find(max(0, start - 1))
        last, _ = self.find(max(start, start + removed - 1))
        last = min(last, self.size - 1)
        seen = 0
        while first and seen < 4:  # whole pre-tokens to the left that do not touch the edit
            first -= 1
            before -= len(self.text[first])
            seen += self.count[first]
        stop = last + 1
        while True:
            ahead, more = stop, 0
            while ahead < self.size and more < 4:
                more += self.count[ahead]
                ahead += 1
            old = "".join(self.text[first:stop])
            context = "".join(self.text[stop:ahead])
            new = old[: start - before] + text + old[start - before + removed :]
            if END in new + context:
                return self.build("".join([*self.text[:first], new, *self.text[stop:]]))
            words, sizes = self.pretokens(new + context)
            kept = len(words)
            if not context:
                break
            kept, end = 0, 0  # pre-tokens of the new text, if a boundary ends it
            while end < len(new):
                end += len(words[kept])
                kept += 1
            if end == len(new):
                break
            stop += 1
        self.encoded += len(words)
        leaves = self.leaves(words[:kept], sizes[:kept]) if kept else []
        room = stop - first
        if len(leaves) > room:
            if len(leaves) - room > 8:
                return self.rebuild(first, stop, leaves)
            tail = leaves[room - 1 :]
            leaves = [*leaves[: room - 1], ("".join(t for t, _, _ in tail), sum(k for _, k, _ in tail), sum(n for _, _, n in tail))]
        for i in range(room):
            self.put(first + i, *(leaves[i] if i < len(leaves) else ("", 0, 0)))

    def rebuild(self, first: int, stop: int, leaves) -> None:
        """A wider tree with the same leaves, for an edit that adds many; nothing is encoded again."""
        old = [(self.text[i], self.tokens[self.size + i], self.count[i]) for i in range(self.size)]
        self.plant([r for r in [*old[:first], *leaves, *old[stop:]] if r[2]])

    @property
    def total(self) -> int:
        return self.tokens[1]


def _columns(trees: list[Tree]) -> list[pa.Array]:
    """text, count, chars and tokens of a chunk of trees."""
    rows = [t.row() for t in trees]
    lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, some)]), pa.int32()), pa.array([x for one in some for x in one], pa.int32())) for some in ([r[i] for r in rows] for i in (1, 2, 3))]
    return [pa.array([r[0] for r in rows], pa.string()), *lists]


def _built(path: str):
    def run(batches):
        coder = encoder(path)
        for b in chunks(batches):
            trees = [Tree(t or "", coder) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_columns(trees)], ["doc_id", "text", "count", "chars", "tokens"])

    return trimmed(run)


def _ints(column: pa.Array) -> list[list[int]]:
    values, ends = column.flatten().tolist(), np.cumsum(np.asarray(pa.compute.list_value_length(column))).tolist()
    return [values[a:b] for a, b in zip([0, *ends], ends, strict=False)]


STATS = ["n_tokens", "n_tokens_after", "n_chars_after", "n_pretokens", "n_pretokens_again"]


def _applied(path: str, keep: bool):
    def run(batches):
        coder = encoder(path)
        for b in chunks(batches):
            out, trees = [[] for _ in STATS], []
            for text, count, chars, tokens, edits in zip(b.column("text").to_pylist(), *(_ints(b.column(c)) for c in ("count", "chars", "tokens")), b.column("edits").to_pylist(), strict=True):
                tree = Tree.stored(text, count, chars, tokens, coder)
                before, n = tree.total, sum(count)
                for e in edits or ():
                    if e:
                        tree.edit(e["start"], e["removed"], e["text"])
                for k, v in zip(out, (before, tree.total, tree.chars[1], n, tree.encoded), strict=True):
                    k.append(v)
                trees.append(tree)
            kept = _columns(trees) if keep else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *kept, *(pa.array(v, pa.int64()) for v in out)], ["doc_id", *["text", "count", "chars", "tokens"][: len(kept)], *STATS])

    return trimmed(run)


def build(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The tree of each row (doc_id, text), as `TREES`; the only step that encodes whole texts. Meant to be written as a table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_built(path or vocabulary_path()), TREES)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """`trees` with their rows of (doc_id, seq, start, removed, text) as one sorted array; a document's edits are applied together."""
    one = F.struct("seq", F.struct(F.col("start").cast("int").alias("start"), F.col("removed").cast("int").alias("removed"), "text").alias("e"))
    lists = edits.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["e"]).alias("edits"))
    return trees.select("doc_id", "text", "count", "chars", "tokens").join(lists, "doc_id", "left")


def apply(trees: DataFrame, keep: bool = True, path: str | None = None) -> DataFrame:
    """Of each stored tree with its `edits`: tokens before and after, characters after, pre-tokens in the tree before and those encoded again; with `keep`
    also the changed tree, for the next batch of edits."""
    rows = trees.select("doc_id", "text", "count", "chars", "tokens", F.col("edits").cast(EDITS).alias("edits"))
    stats = ", ".join(f"{c} long" for c in STATS)
    return rows.mapInArrow(_applied(path or vocabulary_path(), keep), f"{TREES}, {stats}" if keep else f"doc_id long, {stats}")
