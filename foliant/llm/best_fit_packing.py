"""Packing of tokenised documents: Martello-Toth reduction, then best fit.

Documents longer than a sequence are cut into full pieces after a shorter first one; nothing else is cut. How full sequences can get depends
on lengths only, so the instance is a histogram of `capacity` counts at most, however large the corpus, and is solved on the driver:

1. Reduction. Largest length first, sets that dominate every alternative are fixed for good: a piece that nothing fits beside; a piece and the
   one that fills the rest exactly; the largest one beside it if only one more can fit; that one too if two more can fit but no two sum to
   more. Each rule fixes as many equal sets at once as the counts allow.
2. Best fit, largest first, of the rest: each piece goes where least room is left. Equal sequences are one class with a count.

Each piece then finds its place by its rank among pieces of its length. Ranks come from counts by (length, salt), so no length's pieces meet
in one task, even if a third of all pieces are of one length.

Cases: a null or empty text is its end token alone; rows that share a doc_id are packed each; a null doc_id stays null; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rolling import chunks
from .shared import written
from .tokens import encoder, vocabulary_path

END_ID = 0


def _pieces(path: str, capacity: int):
    def run(batches):
        encode = encoder(path).ids
        end = np.array([END_ID], "<u4").tobytes()
        for b in chunks(batches):
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = encode(text or "") + end
                n = len(raw) // 4
                at, piece, size = 0, 0, n % capacity or capacity
                while at < n:
                    for k, v in zip(out, (doc, piece, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])), strict=True):
                        out[k].append(v)
                    at, piece, size = at + size, piece + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()], list(out))

    return run


def pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the pieces of each row of `docs`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces(path or vocabulary_path(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _best_pair(left: np.ndarray, room: int) -> tuple[int, int]:
    """Two lengths still there whose sum is the greatest that `room` holds."""
    best = (0, 0)
    for x in np.flatnonzero(left).tolist():
        for y in range(min(room - x, x), 0, -1):
            if left[y] - (x == y) > 0:
                best = max(best, (x, y), key=sum)
                break
    return best


def reduce_instance(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Sets fixed by dominance, as (lengths, how many), and the counts that are left."""
    left, fixed = counts.copy(), []

    def fix(lengths: tuple[int, ...]) -> None:
        need = np.bincount(lengths, minlength=len(left))
        times = int((left // np.maximum(need, 1))[need > 0].min())
        left[:] -= need * times
        fixed.append((lengths, times))

    for size in range(capacity, 0, -1):
        while left[size]:
            room = capacity - size
            left[size] -= 1
            there = np.flatnonzero(left)
            fits = there[there <= room]
            widest = int(fits[-1]) if len(fits) else 0
            smallest = np.repeat(fits[:3], np.minimum(left[fits[:3]], 3))[:3]
            most = int((np.cumsum(smallest) <= room).sum())
            chosen = None
            if most == 0:
                chosen = (size,)
            elif most == 1 or widest == room:
                chosen = (size, widest)
            elif most == 2:
                pair = _best_pair(left, room)
                chosen = (size, widest) if widest >= sum(pair) else None
            left[size] += 1
            if chosen is None:
                break
            fix(chosen)
    return fixed, left


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many) by best fit, largest first. After one piece of a length the same sequence has less room left and so
    is the best fit for the next one, until it is too full."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    open_rooms = np.zeros(capacity + 1, bool)

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if n:
            rooms.setdefault(room, []).append((lengths, n))
            open_rooms[room] = True

    for size in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[size])
        while n:
            wide = np.flatnonzero(open_rooms[size:])
            if len(wide):
                room = size + int(wide[0])
                lengths, there = rooms[room].pop()
                open_rooms[room] = bool(rooms[room])
            else:
                room, lengths, there = capacity, (), n
            each = room // size
            full = min(there, n // each)
            put(room - each * size, lengths + (size,) * each, full)
            n -= full * each
            if there > full and n:  # fewer than `each` are left
                put(room - n * size, lengths + (size,) * n, 1)
                put(room, lengths, there - full - 1 if lengths else 0)
                n = 0
            elif lengths:
                put(room, lengths, there - full)
    return [x for group in rooms.values() for x in group]


def solve(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _slots(plan, capacity: int):
    """By length, sorted by first rank: (first rank, first sequence, offset) arrays. A slot serves as many ranks as its class has sequences."""
    taken, first, out = np.zeros(capacity + 1, np.int64), 0, {}
    for lengths, n in plan:
        at = 0
        for size in lengths:
            out.setdefault(size, []).append((int(taken[size]), first, at))
            taken[size] += n
            at += size
        first += n
    return {size: np.array(rows, np.int64).T for size, rows in out.items()}


def _placed(slots):
    def run(batches):
        for b in batches:
            length, rank = (np.asarray(b.column(c)) for c in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length).tolist():
                i = np.flatnonzero(length == size)
                begin, first, at = slots[size]
                k = np.searchsorted(begin, rank[i], "right") - 1
                sequence[i], offset[i] = first[k] + rank[i] - begin[k], at[k]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Each piece with its sequence_id and its offset there."""
    rows = written(pieces(docs, capacity, path))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():  # `capacity` rows at most
        counts[length] = n
    slots = _slots(solve(counts, capacity), capacity)
    salts = max(16, min(4096, int(counts.sum()) // 20_000))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    below = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("at", F.row_number().over(within)).join(starts, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("at") - 1).alias("rank"))
    return ranked.mapInArrow(_placed(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
