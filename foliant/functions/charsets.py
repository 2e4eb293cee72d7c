"""The charset that a page's bytes are in.

In this order: a byte-order mark; UTF-16 by its zero bytes; a declared charset (of the response, else of a `meta` tag among the first bytes) if the bytes are valid in it; UTF-8 if they are
valid; and of GB18030, Big5 and Windows-1252 the one in which the bytes are valid and their characters most plausible. A character's plausibility comes from where its code stands: the first
level of a Chinese charset holds its frequent characters, the second the seldom ones, and what lies outside both is hardly used; a western letter is plausible next to letters of its
word, and not in a row of several; a Chinese character is next to others or apart, and seldom the only one at a western letter.
"""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SNIFFED = 2048
# Byte-order marks, names that mean a wider charset, and charsets that a declaration says by default.
MARKS = [(codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
WIDER = {"gb2312": "gb18030", "gbk": "gb18030", "gb18030": "gb18030", "x-gbk": "gb18030", "big5": "big5hkscs", "big5-hkscs": "big5hkscs", "iso-8859-1": "cp1252", "latin-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252", "windows-1252": "cp1252"}
UNSURE = {"cp1252"}

_META = re.compile(rb"""<meta[^>]{0,200}?charset\s*=\s*["']?\s*([A-Za-z0-9_:.\-]{2,40})""", re.I)
_GB = re.compile(rb"((?<=[A-Za-z])[\xb0-\xd7][\xa1-\xfe](?![\x80-\xff])|(?<![\x80-\xff])[\xb0-\xd7][\xa1-\xfe](?=[A-Za-z]))|((?<=[A-Za-z])\xa8[\xa1-\xba]|\xa8[\xa1-\xba](?=[A-Za-z]))|([\xb0-\xd7][\xa1-\xfe])|([\xa1-\xa3][\xa1-\xfe])|(\xa8[\xa1-\xbf])|([\xd8-\xf7][\xa1-\xfe])|([\x81-\xfe][\x30-\x39][\x81-\xfe][\x30-\x39])|([\x81-\xfe][\x40-\x7e\x80-\xfe])")
_GB_WORTH = (0.4, 1.0, 1.0, 1.0, 1.0, 0.3, 0.2, 0.05)
_BIG5 = re.compile(rb"((?<=[A-Za-z])[\xa4-\xc6][\x40-\x7e\xa1-\xfe](?![\x80-\xff])|(?<![\x80-\xff])[\xa4-\xc6][\x40-\x7e\xa1-\xfe](?=[A-Za-z]))|([\xa4-\xc6][\x40-\x7e\xa1-\xfe])|([\xa1-\xa3][\x40-\x7e\xa1-\xfe])|([\xc9-\xf9][\x40-\x7e\xa1-\xfe])|([\x87-\xfe][\x40-\x7e\xa1-\xfe])")
_BIG5_WORTH = (0.5, 1.0, 1.0, 0.3, 0.05)
_WEST = re.compile(r"((?<![^\x00-\x7f])[À-Ü]?[ß-öø-ÿ]{2,}(?![^\x00-\x7f]))|([^\x00-\x7f]{3,})|([^\x00-\x7f]*[À-ÖØ-öø-ÿŒœŠšŽžŸ][^\x00-\x7f]*)|([«»–—‘’“”„…•€©®°·¿¡\xa0]+)|([^\x00-\x7f]+)")
_WEST_WORTH = (0.7, 0.1, 0.95, 0.8, 0.1)


def _mean(pattern: re.Pattern, worth: tuple[float, ...], text) -> float:
    """The mean plausibility of the characters that are not ASCII."""
    total, n = 0.0, 0
    for m in pattern.finditer(text):
        total, n = total + worth[m.lastindex - 1], n + 1
    return total / n if n else 0.0


def _valid(raw: bytes, name: str) -> bool:
    try:
        raw.decode(name)
    except (UnicodeDecodeError, LookupError, ValueError):
        return False
    return True


def _named(label: str | bytes | None) -> str | None:
    if not label:
        return None
    name = (label.decode("ascii", "replace") if isinstance(label, bytes) else label).strip().lower()
    name = WIDER.get(name, name)
    try:
        return name if codecs.lookup(name)._is_text_encoding else None
    except LookupError:
        return None


def detect(raw: bytes, declared: str | None = None) -> str:
    """The name of a charset that Python knows; bytes that are valid in none are taken for UTF-8."""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return name
    head = raw[:SNIFFED]
    if len(head) > 3:
        even, odd = head[::2].count(0), head[1::2].count(0)
        if max(even, odd) > 0.3 * (len(head) // 2) and min(even, odd) < 0.05 * len(head):
            return "utf-16-le" if odd > even else "utf-16-be"
    meta = _META.search(head)
    said = [n for n in (_named(declared), _named(meta.group(1)) if meta else None) if n]
    for name in said:
        if name not in UNSURE and _valid(raw, name):
            return name
    if _valid(raw, "utf-8"):
        return "utf-8"
    ways = [("gb18030", lambda: _mean(_GB, _GB_WORTH, raw)), ("big5hkscs", lambda: _mean(_BIG5, _BIG5_WORTH, raw)), ("cp1252", lambda: _mean(_WEST, _WEST_WORTH, raw.decode("cp1252")))]
    found = [(worth() + 0.1 * (name in said), name) for name, worth in ways if _valid(raw, name)]
    return max(found, key=lambda x: x[0])[1] if found else "utf-8"


def decoded(body: Column, declared: Column) -> Column:
    """struct(charset, text) of a page's bytes; `declared` is the charset that came with it, or null. Bytes that fit nothing become replacement characters; null gives nulls."""

    @F.pandas_udf("charset string, text string")
    def decode(raws: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, name in zip(raws, names, strict=True):
            charset = None if raw is None else detect(bytes(raw), name)
            rows.append((charset, None if raw is None else bytes(raw).decode(charset, errors="replace")))
        return pd.DataFrame(rows, columns=["charset", "text"])

    return decode(body, declared)
