"""Fill-in-the-middle: a document is cut at two of its unit boundaries and its parts change places.

By bit-parallelism on big integers: `bytes.translate` turns a text's bytes into a mask of one class of bytes, an integer with one bit a byte; shifted boolean operations on masks
mark where units begin; `bit_count` says how many units there are; and the cut after k units is the place of the k-th mark, found by halving the mask and
descending into the half that holds it. Each step is linear in the text and runs in C, so a text of any length takes no loop over its units.

Units are lines (with their line ends), words (a word with the blanks behind it; blanks at the start are a unit) or code points. Draws come from the SHA-256 of the
seed and the doc_id alone: the same document is cut alike in any partitioning, and again after an executor is lost. There is no shuffle.

Forms: `psm` puts the suffix before the middle, `spm` the suffix first of all; `plain` texts stay as they are: the empty, those that hold a mark already, and those that
the rate leaves out.

Cases: a null text is empty; a null doc_id is an empty string in the draw; rows that share an id draw alike, each on its own text; repeated rows give repeated rows; very
long texts are cut whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
UNITS = ("line", "word", "char")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _table(inside: Callable[[int], bool]) -> bytes:
    """For `translate`: the digit 1 for bytes of a class, 0 for others."""
    return bytes(49 if inside(b) else 48 for b in range(256))


NEWLINE = _table(lambda b: b == 10)
BLANK = _table(lambda b: b == 32 or 9 <= b <= 13)
LEAD = _table(lambda b: b & 0xC0 != 0x80)


def mask(data: bytes, table: bytes) -> int:
    """Bit i is set if byte i is of the class."""
    return int(data[::-1].translate(table) or b"0", 2)


def starts(data: bytes, unit: str) -> int:
    """Bit i is set where a unit starts at byte i."""
    if not data:
        return 0
    if unit == "char":
        return mask(data, LEAD)
    if unit == "line":
        return ((mask(data, NEWLINE) << 1) | 1) & ((1 << len(data)) - 1)
    blank = mask(data, BLANK)
    return (blank << 1 & ~blank | 1) & ((1 << len(data)) - 1)


def select(bits: int, k: int, size: int) -> int:
    """The place of the k-th set bit (from 0) of the lowest `size`."""
    at = 0
    while size > 1:
        half = size >> 1
        low = bits & ((1 << half) - 1)
        if k < (n := low.bit_count()):
            bits, size = low, half
        else:
            bits, k, at, size = bits >> half, k - n, at + half, size - half
    return at


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transformed(doc_id: int | None, text: str | None, seed: int, unit: str, rate: int, spm: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    text = text or ""
    data = text.encode()
    marks = starts(data, unit)
    n = marks.bit_count()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    place = lambda k: select(marks, k, len(data)) if k < n else len(data)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i = place(a)
    j = i if a == b else place(b)
    prefix, middle, suffix = data[:i].decode(), data[i:j].decode(), data[j:].decode()
    p, s, m = MARKS
    form, output = ("spm", f"{s}{suffix}{p}{prefix}{m}{middle}") if h4 % 100 < spm else ("psm", f"{p}{prefix}{s}{suffix}{m}{middle}")
    return n, form, len(prefix), len(middle), output


def _run(seed: int, unit: str, rate: int, spm: int, most: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            rows, size = [], 0
            for i, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):  # one text at a time
                doc_id = i.as_py()
                rows.append((doc_id, *transformed(doc_id, text.as_py(), seed, unit, rate, spm)))
                size += len(rows[-1][-1])
                if size > most:
                    yield pack(rows)
                    rows, size = [], 0
            if rows:
                yield pack(rows)

    return run


def transform(docs: DataFrame, seed: int = 7, unit: str = "line", rate: int = 100, spm: int = 50) -> DataFrame:
    """(doc_id, n units, form, prefix_chars, middle_chars, output) of each row; of a hundred documents `rate` are rearranged, and of a hundred of these `spm` suffix first."""
    if unit not in UNITS or not 0 <= rate <= 100 or not 0 <= spm <= 100:
        raise ValueError(f"unit is one of {UNITS}, rate and spm are percentages")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run(seed, unit, rate, spm), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that `output` was made from. Marks stand in no text that was rearranged, so the three parts are told apart."""
    parts = F.split(output, "|".join(MARKS))
    prefix, suffix = F.when(form == "psm", F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2))), F.when(form == "psm", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))


def digests(found: DataFrame) -> DataFrame:
    """`transform`'s rows with SHA-256 digests of the output and of the text rebuilt from it in place of the texts."""
    digest = lambda c: F.sha2(c, 256)
    out = found.withColumn("restored_sha256", digest(restored(F.col("output"), F.col("form")))).withColumn("output_sha256", digest(F.col("output")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
