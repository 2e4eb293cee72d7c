"""Exact removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

A string of `length` bytes repeats if it starts at two places, in one document or two. Suffixes are kept at *anchors* only: each window
of `length` bytes owns the anchor with the least fingerprint of `anchor` bytes inside it, so equal windows own equal anchors at equal
distances, and about 2 in `length - anchor` positions are kept. Suffix arrays are ordered by the fingerprint of the suffix's leading bytes:
only equality of prefixes of one fixed length is asked of neighbours, which any order that puts equal prefixes side by side answers.

`Family` is the index: a stored run of entries for each level. A new batch gets its own suffix array, which is merge-scanned with the runs of all levels:
entries with equal prefixes come to stand side by side, and where one of them is new, all of them are reported as matches, with whether the
whole stretch agrees. What a document loses comes from these matches alone. In the same pass the levels of the new one's rank become
one run of the next rank, so each entry moves a logarithmic number of times. The pass streams over sorted rows and holds one key's rows, of
which no more than `HOLD` are waited for. `covered` deals a table into `BATCHES` batches; a family with a folder serves later ones.

What an anchor tells: its prefix is unique, and nothing that it owns repeats; or the whole stretch it owns has a twin, and all of it
repeats; or the prefix is shared and the stretch is not. The last, about one in thirty, is asked again by stretches of `STEP` windows, and
what is still undecided by single windows. Fingerprints of a decision have 128 bits: 64 of the shared prefix, 64 of the stretch.

Cases: null and empty texts are kept whole with nothing removed; texts shorter than `length` repeat nothing; rows that share a doc_id are
told apart by their text, and fully repeated rows count as two occurrences, with one list of stretches for all of them; an empty table gives an
empty result; columns other than doc_id and text are ignored; a null doc_id stays null; texts of any length are cut in segments of `SEGMENT` bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rolling import byte_table, chunks, gathered, mix, prefix_hash, slice_hash, sliding_min, text_bytes, trimmed
from .shared import given_id, scratch, with_key, written

STEP = 16
FLUSH = 300_000
SEGMENT = 1 << 20
HOLD = 1 << 17
BATCHES = 4
LOW = np.uint64((1 << 31) - 1)
COLUMNS = ("key", "whole", "n", "doc")
ENTRY_DDL = "key long, whole long, n long, doc long"
SCAN_DDL = f"{ENTRY_DDL}, several boolean, rank int"
MATCH = -1  # the rank of a scan's matches; others are levels


def _collapsed(x: list[np.ndarray]) -> list[np.ndarray]:
    """Columns (key, whole, n, doc), more allowed, sorted, with one entry for each (key, whole): their number and the least of the others."""
    order = np.lexsort((x[1], x[0]))
    x = [c[order] for c in x]
    if len(x[0]) < 2:
        return x
    first = np.flatnonzero(np.r_[True, (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])])
    return [x[0][first], x[1][first], np.add.reduceat(x[2], first), *(np.minimum.reduceat(c, first) for c in x[3:])]


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v.view(np.int64) if isinstance(v, np.ndarray) and v.dtype == np.uint64 else v) for k, v in columns.items()})


def _slices(columns: dict, most: int = 50_000):
    for i in range(0, len(next(iter(columns.values()))), most):
        yield _batch({k: v[i : i + most] for k, v in columns.items()})


def _merge_scan(merged: list[int], rank: int):
    """One task of a scan: rows (key, whole, n, doc, rank), sorted by key and whole, of all levels and of the new batch, whose rank is MATCH.

    Gives the matches, and the entries of the new batch and of the ranks in `merged` as one run of rank `rank` (none if that is MATCH). A key of more than
    `HOLD` rows is given as they come: that a match is told again does no harm, that one is missed would.
    """

    def told(x, hot):
        """`x`: rows of whole keys (or of one hot key)."""
        new = x[4] == MATCH
        if rank != MATCH:
            moved = new | np.isin(x[4], merged)
            if moved.any():
                run = _collapsed([c[moved] for c in x[:4]])
                yield from _slices(dict(zip(COLUMNS, run, strict=True)) | {"several": np.zeros(len(run[0]), bool), "rank": np.full(len(run[0]), rank, np.int32)})
        key, whole, n, doc, old = _collapsed([*x[:4], (~new).astype(np.int64)])  # `old` is 0 if any was new
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        kinds = np.diff(np.r_[first, len(key)])
        shared = ((np.add.reduceat(n, first) > 1) & (np.minimum.reduceat(old, first) == 0)) | hot
        pick, several = np.repeat(shared, kinds), np.repeat((kinds > 1) | hot, kinds)
        if pick.any():
            yield from _slices(dict(zip(COLUMNS, (c[pick] for c in (key, whole, n, doc)), strict=True)) | {"several": several[pick], "rank": np.full(int(pick.sum()), MATCH, np.int32)})

    def run(batches):
        held, hot = None, False  # rows of the last key, which may go on; whether some of its rows are told already
        for b in gathered(batches):
            if not b.num_rows:
                continue
            x = [np.asarray(b.column(c)) for c in (*COLUMNS, "rank")]
            if held is not None:
                x = [np.concatenate(c) for c in zip(held, x, strict=True)]
            cut = int(np.searchsorted(x[0], x[0][-1]))
            if cut and hot:
                of_hot = int(np.searchsorted(x[0], x[0][0], "right"))
                yield from told([c[:of_hot] for c in x], True)
                x, cut, hot = [c[of_hot:] for c in x], cut - of_hot, False
            if cut:
                yield from told([c[:cut] for c in x], False)
            held = [c[cut:] for c in x]
            if hot or len(held[0]) > HOLD:
                last = int(np.searchsorted(held[1], held[1][-1]))
                if last:
                    yield from told([c[:last] for c in held], True)
                    hot = True
                held = _by_rank([c[last:] for c in held])
        if held is not None:
            yield from told(held, hot)

    return run


def _by_rank(x):
    """Rows of one key and stretch as one row a rank."""
    ranks, at = np.unique(x[4], return_inverse=True)
    doc = np.full(len(ranks), np.iinfo(np.int64).max)
    np.minimum.at(doc, at, x[3])
    return [x[0][: len(ranks)], x[1][: len(ranks)], np.bincount(at, weights=x[2]).astype(np.int64), doc, ranks]


class Family:
    """Stored levels of a sparse suffix array: (rank, folder of its run), no two of a rank. With `folder` the list is kept there for later sessions."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder, self.levels = spark, folder, []
        if folder:
            try:
                self.levels = [tuple(r) for r in spark.read.schema("rank int, path string").json(f"{folder}/levels").collect()]  # one row a level
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise

    def run(self, rank: int, path: str) -> DataFrame:
        return self.spark.read.schema(SCAN_DDL).parquet(path).where(F.col("rank") == rank).select(*COLUMNS, "rank")

    def add(self, entries: DataFrame, store: bool = True) -> DataFrame:
        """Scans a batch of entries against all levels, takes it in if `store`, and gives the matches (key, whole, n, doc, several) that it has
        part in: the entries of both sides."""
        rows, taken = entries.withColumn("rank", F.lit(MATCH)), dict(self.levels)
        for level in self.levels:
            rows = rows.unionByName(self.run(*level))
        rank = next(r for r in range(len(taken) + 1) if r not in taken)
        path = scratch(self.spark, self.folder)
        scan = _merge_scan(list(range(rank)), rank if store else MATCH)
        rows.repartition("key").sortWithinPartitions("key", "whole").mapInArrow(scan, SCAN_DDL).write.parquet(path)
        if store:
            self.levels = [(r, p) for r, p in self.levels if r > rank] + [(rank, path)]
        if store and self.folder:
            self.spark.createDataFrame(self.levels, "rank int, path string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/levels")
        return self.spark.read.schema(SCAN_DDL).parquet(path).where(F.col("rank") == MATCH).drop("rank")


class Stretches:
    """Stretches of windows of one chunk of texts: start `low` to `high` and anchor of each, and what their fingerprints are."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> None:
        self.length, self.anchor, self.offsets = length, anchor, offsets
        self.first, self.second = (prefix_hash(data, byte_table(s)) for s in (11, 12))
        self.size = len(data)

    def all(self):
        """(low, high, anchor) of each anchor's own windows."""
        length, k = self.length, self.anchor
        n = self.size - k + 1
        windows = self.size - length + 1
        if windows <= 0:
            return (np.empty(0, np.int64),) * 3
        at = np.arange(n)
        rank = mix(slice_hash(self.first, at, at + k))
        least = sliding_min((rank >> np.uint64(31) << np.uint64(31)) | at.astype(np.uint64), length - k + 1)
        end = np.repeat(self.offsets[1:], np.diff(self.offsets))[:windows]
        p = np.flatnonzero(np.arange(windows) + length <= end)
        if not len(p):
            return (np.empty(0, np.int64),) * 3
        a = (least[p] & LOW).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
        return p[cut], p[np.r_[cut[1:], len(p)] - 1], a[cut]

    def steps(self, low, high, a):
        """The same windows by their distance from the anchor, STEP at a time."""
        n = (a - low) // STEP - (a - high) // STEP + 1
        i = np.repeat(np.arange(len(low)), n)
        j = ((a - high) // STEP)[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        return np.maximum(low[i], a[i] - STEP * j - STEP + 1), np.minimum(high[i], a[i] - STEP * j), a[i]

    def singles(self, low, high, a):
        n = high - low + 1
        p = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return p, p, np.repeat(a, n)

    def fingerprints(self, grain: int, low, high, a):
        """(key, whole): of what all windows of the stretch share, and of the stretch itself."""
        length = self.length
        if grain == 0:
            start, end, seal, begin, stop = a, a + self.anchor, 0, low, high + length
        elif grain == 1:
            j = (a - low) // STEP
            start, end, seal = a - STEP * j, a - STEP * j - STEP + 1 + length, j.astype(np.uint64)
            doc = np.searchsorted(self.offsets, low, "right") - 1
            begin, stop = np.maximum(start - STEP + 1, self.offsets[doc]), np.minimum(start + length, self.offsets[doc + 1])
        else:
            start, end, seal, begin, stop = low, low + length, 0, low, low + length
        return mix(slice_hash(self.first, start, end) + np.uint64(0x9E3779B97F4A7C15) * seal), mix(slice_hash(self.second, begin, stop))


def _segments(texts, columns, length):
    """(bytes, offsets, first row, first byte, stretches' rows or None, stretches) of a chunk: the whole of it, or a segment of its only text."""
    data, offsets = text_bytes(texts)
    rows, given = None, ()
    if columns is not None:
        rows = np.repeat(np.arange(len(texts)), np.asarray(pc.fill_null(pc.list_value_length(columns), 0)))
        flat = columns.flatten()
        given = tuple(np.asarray(flat.field(i)) for i in ("low", "high", "a"))
    if len(texts) > 1 or len(data) <= 2 * SEGMENT:
        yield data, offsets, 0, rows, given
        return
    for at in range(0, len(data), SEGMENT):
        low = max(0, at - STEP) if given else at
        part = data[low : at + SEGMENT + (2 * length + STEP if given else length - 1)]
        mine = (given[0] >= at) & (given[0] < at + SEGMENT) if given else None
        yield part, np.array([0, len(part)]), low, rows[mine] if given else None, tuple(x[mine] - low for x in given)


def _cut(texts, columns, length, anchor, grain):
    """Of one chunk: stretches with their document's row, and their fingerprints. `columns` holds, for finer grains, what to cut."""
    for data, offsets, base, rows, given in _segments(texts, columns, length):
        s = Stretches(data, offsets, length, anchor)
        if grain == 0:
            low, high, a = s.all()
        else:
            low, high, a = (x + offsets[rows] for x in given)
            low, high, a = (s.steps if grain == 1 else s.singles)(low, high, a)
        row = np.searchsorted(offsets, low, "right") - 1
        key, whole = s.fingerprints(grain, low, high, a)
        start = offsets[row] - base
        yield row, low - start, high - start, a - start, key, whole


def _entries(length: int, anchor: int, grain: int):
    def run(batches):
        held, size = [], 0
        for b in chunks(batches):
            for row, *_, key, whole in _cut(b.column("text"), b.column("open") if grain else None, length, anchor, grain):
                held.append((key.view(np.int64), whole.view(np.int64), np.ones(len(key), np.int64), np.asarray(b.column("doc_id"))[row]))
                size += len(key)
                if size > FLUSH:
                    yield from _slices(dict(zip(COLUMNS, _collapsed([np.concatenate(c) for c in zip(*held, strict=True)]), strict=True)))
                    held, size = [], 0
        if size:
            yield from _slices(dict(zip(COLUMNS, _collapsed([np.concatenate(c) for c in zip(*held, strict=True)]), strict=True)))

    return trimmed(run)


def _places(length: int, anchor: int, grain: int):
    def run(batches):
        for b in chunks(batches):
            for row, low, high, a, key, whole in _cut(b.column("text"), b.column("open") if grain else None, length, anchor, grain):
                ids, hashes = (np.asarray(b.column(c))[row] for c in ("doc_id", "text_hash"))
                yield from _slices({"doc_id": ids, "text_hash": hashes, "low": low.astype(np.int32), "high": high.astype(np.int32), "a": a.astype(np.int32), "key": key, "whole": whole})

    return trimmed(run)


def entries(docs: DataFrame, length: int = 400, anchor: int | None = None) -> DataFrame:
    """The entries (key, whole, n, doc) of a batch of documents, for `Family.add`."""
    return with_key(docs).mapInArrow(_entries(length, anchor or _anchor(length), 0), ENTRY_DDL)


def _anchor(length: int) -> int:
    return max(1, length * 8 // 25)


def _found(docs: DataFrame, length: int, anchor: int, grain: int, batches: int = 1) -> DataFrame:
    """(doc_id, text_hash, sure, open): by document, stretches that repeat and stretches to be cut finer."""
    family, matches = Family(docs.sparkSession), None
    deal = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(17)), F.lit(batches))
    for i in range(batches):
        batch = docs if batches == 1 else docs.where(deal == i)
        told = family.add(batch.mapInArrow(_entries(length, anchor, grain), ENTRY_DDL), store=i < batches - 1)
        matches = told if matches is None else matches.unionByName(told)
    # A match that a later scan tells again counts the later entries too, so the greatest count is the full one.
    # Written, so that the join below deals both sides anew and AQE can split the places of a passage that a third of all rows hold.
    shared = written(matches.groupBy("key", "whole").agg((F.max("n") > 1).alias("twin"), F.max("several").alias("several"), F.min("doc").alias("keeper")))
    places = docs.mapInArrow(_places(length, anchor, grain), "doc_id long, text_hash long, low int, high int, a int, key long, whole long")
    hits = places.join(shared, ["key", "whole"])
    stretch = F.struct(*(F.col(c).cast("long").alias(c) for c in ("low", "high", "a")))
    again = ~F.col("twin") | (F.col("several") & (F.col("keeper") == F.col("doc_id")))
    # Sets, as equal rows have equal stretches.
    return hits.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.when(F.col("twin"), F.struct(F.col("low").cast("long").alias("low"), (F.col("high") + length).cast("long").alias("end")))).alias("sure"),
        F.collect_set(F.when(again, stretch)).alias("open"),
    )


def covered(docs: DataFrame, length: int = 400, anchor: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text_hash, text, carry, sure): each row of `docs` with lists of byte stretches that repeated strings cover, which may overlap. The
    columns named in `carry` come along in a struct of that name; a null id is still `NO_ID`."""
    anchor = anchor or _anchor(length)
    found = _found(with_key(docs), length, anchor, 0, BATCHES)
    keys = ["doc_id", "text_hash"]
    more = F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))
    state = with_key(docs, more.alias("carry")).join(found, keys, "left")
    state = written(state.select(*keys, "text", "carry", "sure", F.when(F.size("open") > 0, F.col("open")).alias("open")))
    done = state.where("open IS NULL").select(*keys, "text", "carry", F.array("sure").alias("sure"))
    left = state.where("open IS NOT NULL")
    narrow = left.select(*keys, "text", "open")
    mid = written(_found(narrow, length, anchor, 1).withColumnRenamed("sure", "mid"))
    narrow = narrow.select(*keys, "text").dropDuplicates(keys).join(mid.where(F.size("open") > 0).select(*keys, "open"), keys)
    last = _found(narrow, length, anchor, 2).select(*keys, F.col("sure").alias("last"))
    finished = left.drop("open").join(mid.drop("open"), keys, "left").join(last, keys, "left").select(*keys, "text", "carry", F.array("sure", "mid", "last").alias("sure"))
    return done.unionByName(finished)


def repeats(docs: DataFrame, length: int = 400, anchor: int | None = None) -> DataFrame:
    """(doc_id, text_hash, text, spans): each row of `docs` with the maximal byte runs [start, end) that repeated strings cover."""
    found = covered(docs, length, anchor).select("doc_id", "text_hash", "text", "sure")
    return found.mapInArrow(_spans, "doc_id long, text_hash long, text string, spans array<struct<start:long,end:long>>").select(given_id(), "text_hash", "text", "spans")


def union_of(lists) -> list[tuple[int, int]]:
    """Sorted disjoint runs that cover the same bytes; runs that touch become one."""
    out: list[list[int]] = []
    for low, end in sorted({(s["low"], s["end"]) for some in lists or () if some for s in some}):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([low, end])
    return [(s, e) for s, e in out]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(batches):
    for b in batches:
        spans = [[{"start": s, "end": e} for s, e in union_of(x)] for x in b.column("sure").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), b.column("text"), pa.array(spans, _SPANS)], ["doc_id", "text_hash", "text", "spans"])


def _texts_and_spans(batch):
    """Of each row the text's bytes, not copied, and its maximal runs."""
    data, offsets = text_bytes(batch.column("text"))
    whole, cuts = memoryview(data), offsets.tolist()
    for i, sure in enumerate(batch.column("sure").to_pylist()):
        yield whole[cuts[i] : cuts[i + 1]], union_of(sure)


def _digest(batches):
    for b in chunks(batches):
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for raw, spans in _texts_and_spans(b):
            kept, at = hashlib.sha256(), 0
            for start, end in spans:
                kept.update(raw[at:start])
                at = end
            kept.update(raw[at:])
            for k, v in zip(out, (len(raw), sum(e - s for s, e in spans), len(spans), kept.hexdigest()), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items())], ["doc_id", *out])


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the rows of `covered`."""
    return found.select("doc_id", "text", "sure").mapInArrow(trimmed(_digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumn("doc_id", given_id())


def _kept(batches):
    for b in chunks(batches):
        out, cut = [], []
        for raw, spans in _texts_and_spans(b):
            parts, at = [], 0
            for start, end in spans:
                while start < len(raw) and raw[start] & 0xC0 == 0x80:  # a character cut in two stays
                    start += 1
                while end < len(raw) and end > start and raw[end] & 0xC0 == 0x80:
                    end -= 1
                parts.append(raw[at:start])
                at = max(start, end)
            out.append(b"".join([*parts, raw[at:]]).decode())
            cut.append(bool(spans))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("carry"), pa.array(cut, pa.bool_()), pa.array(out, pa.string())], ["doc_id", "carry", "cut", "kept"])


def kept_texts(found: DataFrame) -> DataFrame:
    """(doc_id, carry, cut, kept) of the rows of `covered`: the text without its repeated runs, and if it had any; a character that a run's
    end would cut stays whole."""
    kind = found.schema["carry"].dataType.simpleString()
    return found.select("doc_id", "text", "sure", "carry").mapInArrow(trimmed(_kept), f"doc_id long, carry {kind}, cut boolean, kept string").withColumn("doc_id", given_id())
