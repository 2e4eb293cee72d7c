"""Benchmark decontamination by templates: numbers, names and units become typed placeholders, and windows of templates are joined.

A text is cut into words. A number becomes <num>, a unit <unit>, a capitalised word that does not start a sentence <name>; other words keep their
lower-case form; so do words in capitals. Windows of `window` template words (a shorter benchmark item: the whole of it) are hashed and joined with the benchmark's.
A word that opens a sentence may be a name or not, so its windows have further forms on both sides: all openings as <name>, and the window's first
word read the other way. The plain words are a form too, so neither case nor line breaks hide a passage. `3.5` and `1,200` are read both as one
number and in parts.
A window's slots are then compared: each benchmark value must stand for one value of the document and the other way round, whatever the values
are, so that a re-parameterised question is caught and a chance agreement of templates is not. Windows that are mostly placeholders count
only if their values agree as they are; equal names are no placeholders there. A changed opening needs `LITERALS` literal words beside it.
The same must hold over the whole match, that is all windows of a document and an item that lie equally far apart in both: where a value stands for two, however
far from each other, only windows whose values agree as they are count.

Documents meet a bitmap of the benchmark's window hashes first, of a fixed 2 MB whatever the benchmark's size; only windows that may match leave the
map task, and the join itself is on full 64-bit hashes, so no side needs to be small.

Cases: null and empty texts match nothing; benchmark items with no words are left out; texts that share a doc_id, or have none, are matched each by itself, and what is found is
given under their id, once for all of them, as it is for repeated rows; empty tables give an empty result; extra columns are ignored; an item that says the same window twice counts it once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import byte_table, chunks, mix, prefix_hash, slice_hash, text_bytes, trimmed

WINDOW = 13
BITMAP_BITS = 24
LITERALS = 4
# Unit words.
UNITS = """mm cm m km inch inches ft feet yard yards mile miles mg g kg lb lbs oz ounce ounces ton tons ml l litre litres liter liters
s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years kmh mph
percent dollar dollars euro euros cent cents pound pounds degree degrees celsius fahrenheit watt watts kw kwh volt volts hz khz mhz ghz kb mb gb tb""".split()

LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?:\n"]] = True
NUM, NAME, UNIT = (np.uint64(x) for x in (1, 2, 3))


def _word_hash(prefix, start, end):
    return mix(slice_hash(prefix, start, end)) | np.uint64(8)


def _unit_hashes() -> np.ndarray:
    data, offsets = text_bytes(pa.array(UNITS))
    return np.sort(_word_hash(prefix_hash(data, byte_table(41)), offsets[:-1], offsets[1:]))


def _lower(texts, offsets: np.ndarray) -> np.ndarray:
    """The bytes in lower case, each at its place: a character whose lower-case form is longer or shorter stays."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    low = pc.utf8_lower(texts)
    data, at = text_bytes(low)
    if not np.array_equal(at, offsets):
        rows = zip(texts.to_pylist(), low.to_pylist(), (np.diff(at) != np.diff(offsets)).tolist(), strict=True)
        kept = ["".join(c.lower() if len(c.lower().encode()) == len(c.encode()) else c for c in t) if moved else x for t, x, moved in rows]
        data, _ = text_bytes(pa.array(kept, pa.string()))
    return data


def template(texts, whole: bool = False):
    """(row, kind or word hash, value hash, start, end, bytes, capitalised, opens a sentence) of each word of a chunk of texts; if `whole`,
    digits joined by a point or a comma are one word, and None if there are none."""
    data, offsets = text_bytes(texts)
    letter = LETTER[data]
    if whole:
        joined = np.zeros(len(data), bool)
        if len(data) > 2:
            joined[1:-1] = DIGIT[data[:-2]] & DIGIT[data[2:]] & ((data[1:-1] == 46) | (data[1:-1] == 44))
            cut = offsets[(offsets > 0) & (offsets < len(data))]
            joined[cut] = joined[cut - 1] = False
        if not joined.any():
            return None
        letter |= joined
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.r_[False, letter[:-1]], np.r_[letter[1:], False]
    start = np.flatnonzero(letter & (~before | edge[:-1]))
    end = np.flatnonzero(letter & (~after | edge[1:])) + 1
    prefix = prefix_hash(_lower(texts, offsets), byte_table(41))
    value = _word_hash(prefix, start, end)
    row = np.searchsorted(offsets, start, "right") - 1
    token = value.copy()
    digits = np.cumsum(np.r_[0, (data >= 48) & (data <= 57)])
    number = digits[end] > digits[start]
    stops = np.cumsum(np.r_[0, ENDS[data]])
    first = np.ones(len(start), bool)
    if len(start) > 1:
        first[1:] = (row[1:] != row[:-1]) | (stops[start[1:]] > stops[end[:-1]])
    capital = (data[start] >= 65) & (data[start] <= 90) & (end - start > 1)
    capital &= (data[np.minimum(start + 1, len(data) - 1)] >= 97) if len(data) else False  # a text in capitals has no names
    token[capital & ~first] = NAME
    units = _unit_hashes()
    at = np.minimum(np.searchsorted(units, value), len(units) - 1)
    token[units[at] == value] = UNIT
    token[number] = NUM
    return row, token, value, start, end, data, capital, first


STEP = 0x9E3779B97F4A7C15


def _window_sums(row: np.ndarray, token: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, unmixed hash) of each run of `width` words of one text."""
    n = len(token) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):  # the window is short: one pass for each of its words
        total = total * np.uint64(STEP) + token[i : i + n]
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    return at, total[at] + np.uint64(width)


def _forms(row, token, value, capital, first, width: int):
    """(number of the window, its first word, hash, tokens, tokens that replace its first one or None) of each form of each window, form by form."""
    at, sums = _window_sums(row, token, width)
    every = np.arange(len(at))
    yield every, at, mix(sums), token, None
    if not len(at):
        return

    def within(flag):
        count = np.cumsum(np.r_[0, flag])
        return count[at + width] - count[at]

    opening = capital & first & (token >= 8)
    openings, lead = within(opening), opening[at]
    top = np.uint64(pow(STEP, width - 1, 1 << 64))
    swap = (NAME - value[at]) * top
    if lead.any():
        yield every[lead], at[lead], mix((sums + swap)[lead]), token, np.where(opening, NAME, token)
    if openings.any():
        named = np.where(opening, NAME, token)
        _, all_named = _window_sums(row, named, width)
        more = openings > lead  # else it is the form before
        yield every[more], at[more], mix(all_named[more]), named, None
        more &= lead
        yield every[more], at[more], mix((all_named - swap)[more]), named, value
    plain = within(token < 8) > 0
    if plain.any():
        yield every[plain], at[plain], mix(_window_sums(row, value, width)[1][plain]), value, None


def _slots(token, lead, opens, start, end, data, at: int, width: int) -> list[dict]:
    out = []
    for i in range(at, at + width):
        kind = lead[i] if lead is not None and i == at else token[i]
        if kind < 8:
            out.append({"kind": int(kind), "value": bytes(data[start[i] : end[i]]).decode(errors="replace"), "opens": bool(opens[i])})
    return out


_OUT = "width int, window long, slots array<struct<kind:int,value:string,opens:boolean>>, at int, cut int"
_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("value", pa.string()), ("opens", pa.bool_())]))


def _rows(ids, name, width, hashes, slots, at, cut, **more):
    """`at`: the window's first word in its text; `cut`: 1 if digits joined by a point or comma are one word there."""
    longs = {k: pa.array(np.asarray(v, np.uint64).view(np.int64)) for k, v in {"window": hashes, **more}.items()}
    return pa.RecordBatch.from_pydict({name: pa.array(ids, pa.int64()), "width": pa.array(width, pa.int32()), "window": longs.pop("window"), "slots": pa.array(slots, _TYPE), "at": pa.array(at, pa.int32()), "cut": pa.array(cut, pa.int32()), **longs})


def _item_windows(window: int):
    def run(batches):
        for b in chunks(batches):
            ids, out = b.column("item_id").to_pylist(), tuple([] for _ in range(7))
            for cut in (0, 1):
                words = template(b.column("text"), bool(cut))
                if words is None:
                    continue
                row, token, value, start, end, data, capital, first = words
                for r in np.unique(row).tolist():
                    i = slice(*np.searchsorted(row, [r, r + 1]).tolist())
                    width = min(window, i.stop - i.start)
                    opens = capital[i] & first[i]
                    base = None
                    for which, at, h, form, lead in _forms(row[i], token[i], value[i], capital[i], first[i], width):
                        base = h if base is None else base
                        for n, a, x in zip(which.tolist(), at.tolist(), h.tolist(), strict=True):
                            for k, v in zip(out, (ids[r], width, x, _slots(form, lead, opens, start[i], end[i], data, a, width), a, cut, int(base[n])), strict=True):
                                k.append(v)
            yield _rows(out[0], "item_id", *out[1:6], base=out[6])

    return run


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, width, window, slots, at, cut, base) of the benchmark: a row for each form of a window; base is the window's first form."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(_item_windows(window), f"item_id long, {_OUT}, base long").dropDuplicates(["item_id", "width", "window", "slots", "at", "cut", "base"])


def _bits(batches):
    """One task: the cells of the bitmap that its windows set."""
    for b in batches:
        yield pa.RecordBatch.from_pydict({"width": b.column("width"), "cell": np.asarray(b.column("window")).view(np.uint64).astype(np.uint64) >> np.uint64(64 - BITMAP_BITS)})


def _doc_windows(widths: list[int], cells: bytes):
    def run(batches):
        bitmap = np.unpackbits(np.frombuffer(cells, np.uint8)).astype(bool)
        for b in chunks(batches):
            ids, texts = b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist()
            for cut in (0, 1):
                words = template(b.column("text"), bool(cut))
                if words is None:
                    continue
                row, token, value, start, end, data, capital, first = words
                opens, begins = capital & first, np.searchsorted(row, np.arange(b.num_rows))
                for width in widths:
                    for _, at, h, form, lead in _forms(row, token, value, capital, first, width):
                        hit = np.flatnonzero(bitmap[h >> np.uint64(64 - BITMAP_BITS)])
                        for i in range(0, len(hit), 5000):
                            some = hit[i : i + 5000]
                            places = at[some]
                            found = _rows([ids[r] for r in row[places].tolist()], "doc_id", [width] * len(some), h[some], [_slots(form, lead, opens, start, end, data, a, width) for a in places.tolist()], places - begins[row[places]], [cut] * len(some))
                            yield found.append_column("text_hash", pa.array([texts[r] for r in row[places].tolist()], pa.binary()))

    return run


def doc_windows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, width, window, slots, at, cut, text_hash) of windows that may be in `known`; doc_id and text_hash, 128 bits, tell texts apart."""
    cells = np.zeros(1 << BITMAP_BITS, bool)
    set_cells = known.select("width", F.shiftrightunsigned("window", 64 - BITMAP_BITS).alias("cell")).distinct()
    widths = sorted(r[0] for r in set_cells.select("width").distinct().collect())  # at most `window` of them
    # At most 2**BITMAP_BITS cells reach the driver, packed by 4096 so that rows stay few.
    packed = set_cells.select("cell").distinct().groupBy(F.shiftright("cell", 12).alias("page")).agg(F.collect_list((F.col("cell").bitwiseAND(F.lit(4095))).cast("int")).alias("cells"))
    for page, some in packed.toLocalIterator():
        cells[(page << 12) + np.array(some)] = True
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_hash"))
    return rows.mapInArrow(trimmed(_doc_windows(widths, np.packbits(cells).tobytes())), f"doc_id long, {_OUT}, text_hash binary")


def _consistent(mine, theirs):
    """Each value on one side stands for one value on the other; with as many kinds of pairs as values on either side."""
    mine, theirs = (F.transform(x, lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), s["value"])) for x in (mine, theirs))
    n = F.size(F.array_distinct(F.arrays_zip(mine.alias("m"), theirs.alias("t"))))
    return (F.size(mine) == F.size(theirs)) & (n == F.size(F.array_distinct(mine))) & (n == F.size(F.array_distinct(theirs)))


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, item_id, width, base, equal) for each window of a benchmark item that a text has, `equal` where its values agree as they are."""
    known = item_windows(benchmark, window)
    asked = known.select("item_id", "width", "window", "base", F.col("slots").alias("theirs"), F.col("at").alias("item_at"), F.col("cut").alias("item_cut"))
    hits = doc_windows(docs, known).join(asked, ["width", "window"])
    same = F.zip_with("slots", "theirs", lambda m, t: (m["kind"] == t["kind"]) & (m["value"] == t["value"]))
    equal = (F.size("slots") == F.size("theirs")) & F.forall(same, lambda x: x)
    weight = F.size(F.filter(F.zip_with("slots", "theirs", lambda m, t: (m["kind"] == int(NAME)) & (m["value"] == t["value"])), lambda x: ~x))
    turned = F.exists(F.zip_with("slots", "theirs", lambda m, t: m["opens"] & (m["value"] != t["value"])), lambda x: x)
    full = (weight * 2 <= F.col("width")) & (~turned | (F.col("width") - F.size("slots") >= LITERALS))
    hits = hits.where(equal | (full & _consistent(F.col("slots"), F.col("theirs"))))
    # A match: all windows of a document and an item at one distance. It has as many pairs of values as the item has slots, at most.
    plain = lambda x: F.struct(x["kind"], x["value"])
    pairs = F.zip_with("slots", "theirs", lambda m, t: F.struct(plain(m).alias("m"), plain(t).alias("t")))
    match = hits.groupBy("doc_id", "text_hash", "item_id", "width", "cut", "item_cut", (F.col("at") - F.col("item_at")).alias("apart")).agg(
        F.collect_set(F.struct("base", equal.alias("equal"))).alias("windows"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )
    n = F.size("pairs")
    sound = (n == F.size(F.array_distinct(F.col("pairs.m")))) & (n == F.size(F.array_distinct(F.col("pairs.t"))))
    counted = match.select("doc_id", "text_hash", "item_id", "width", F.explode(F.filter("windows", lambda w: sound | w["equal"])).alias("w"))
    return counted.groupBy("doc_id", "text_hash", "item_id", "width", "w.base").agg(F.max("w.equal").alias("equal"))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, n_windows, n_reworded) for each pair of a document and a benchmark item with a common window; n_reworded counts
    the windows whose slots are consistent but nowhere equal. Texts that share an id, or have none, are matched each, and a window that several of them have counts once."""
    windows = matched(docs, benchmark, window).groupBy("doc_id", "item_id", "width", "base").agg(F.max("equal").alias("equal"))
    return windows.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows"), F.sum(F.when(F.col("equal"), 0).otherwise(1)).alias("n_reworded"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` without a window of the benchmark: rows that share an id, or have none, each by its own text. All columns stay."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    leaks = matched(docs.select(F.lit(0).alias("doc_id"), "text"), benchmark, window).select(F.col("text_hash").alias("leak")).distinct()
    return rows.join(leaks, F.col("key") == F.col("leak"), "left_anti").select("row.*")
