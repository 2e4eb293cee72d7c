"""Text rules as Column expressions, with Python's notion of white space, digits and case."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .fixed import java

WS = r"(?U)[\s\x1c-\x1f]+"
_DIGITS = [(chr(c), str(unicodedata.digit(chr(c)))) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
_FOLDED = [(chr(c), chr(c).casefold()) for c in range(128, sys.maxunicode + 1) if chr(c).casefold() != chr(c).lower() and chr(c).isalnum()]


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, WS, " "))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def line_list(c: Column) -> Column:
    """The squeezed lines that are not empty."""
    lines = F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n")
    return F.filter(F.transform(lines, squeeze), lambda x: x != "")


def clean_lines(c: Column) -> Column:
    return F.array_join(line_list(c), "\n")


def match_key(c: Column) -> Column:
    """Letters and digits only, case-folded. Below U+0149 just `ß` and `µ` fold to something else than their lower case, and short classes tell which
    texts have one; a text with any character from there on is translated, and the characters that fold to several are looked for first."""
    kept = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))  # some scripts fold to capitals, so that lower case comes first
    near = F.replace(F.replace(kept, F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("μ"))
    single = [(a, b) for a, b in _FOLDED if len(b) == 1]
    far = F.translate(near, "".join(a for a, _ in single), "".join(b for _, b in single))
    rare = [(a, b) for a, b in _FOLDED if len(b) > 1 and a != "ß"]
    whole = far
    for a, b in rare:
        whole = F.replace(whole, F.lit(a), F.lit(b))
    far = F.when(c.rlike("[" + "".join(a for a, _ in rare) + "]"), whole).otherwise(far)
    return F.when(~c.rlike("[µßŉ-\U0010ffff]"), kept).when(~c.rlike("[ŉ-\U0010ffff]"), near).otherwise(far)


def segments(c: Column) -> Column:
    return F.filter(F.split(squeeze(c), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def search_keyword(c: Column) -> Column:
    """struct(keyword, filtered): the first longest word run if there are several, else the squeezed query as it is."""
    found = segments(c)
    longest = F.aggregate(found, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    several = F.size(found) > 1
    return F.struct(F.when(several, longest).otherwise(squeeze(c)).alias("keyword"), several.alias("filtered"))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, "".join(a for a, _ in _DIGITS), "".join(b for _, b in _DIGITS))


def _group(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def chapter_number(title: Column, fallback: Column | int = 0) -> Column:
    """The first number that reads as a chapter's; Chinese numerals don't count."""
    text, pattern = ascii_digits(title), java(fixed.CHAPTER_NUMBER, True)
    found = F.coalesce(_group(text, pattern, 1), _group(text, pattern, 2))
    return F.coalesce(found.cast("int"), F.lit(fallback) if isinstance(fallback, int) else fallback)


def leading_number(title: Column) -> Column:
    return _group(ascii_digits(title), java(fixed.LEADING_NUMBER), 1).cast("int")


def is_chapter_title(title: Column) -> Column:
    return title.rlike(java(fixed.CHAPTER_SIGNAL, True)) | title.rlike(java(fixed.GENERIC_TEXT_SIGNAL))


def is_extra_title(title: Column) -> Column:
    return ~strip(title).rlike(fixed.EXTRA_TITLE_VETO) & strip(title).rlike(fixed.EXTRA_TITLE)


def is_verification_page(html: Column) -> Column:
    sample = F.lower(F.left(html, F.lit(20000)))
    found = F.lit(False)
    for marker in fixed.VERIFICATION_MARKERS:
        found = found | F.contains(sample, F.lit(marker))
    return found


def file_name(title: Column) -> Column:
    safe = F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', "_")
    return F.coalesce(F.nullif(F.left(F.btrim(safe, F.lit(" .")), F.lit(120)), F.lit("")), F.lit(fixed.DEFAULT_TITLE))


def block(title: Column, content: Column) -> Column:
    return strip(F.concat(title, F.lit("\n\n"), content))


def cache_key(url: Column) -> Column:
    return F.left(F.sha2(url, 256), F.lit(20))


def six_digits(number: Column) -> Column:
    return F.format_string("%06d", number)


def numbered(number: Column, unit: str = "章") -> Column:
    return F.concat(F.lit("第"), number.cast("string"), F.lit(unit))


def book_title(text: Column) -> Column:
    """A title text without site and chapter suffixes, at most 120 characters; null if under two are left."""
    text = F.when(F.length(text) >= 2, text)
    text = strip(F.regexp_replace(text, java(fixed.TITLE_SITE_SUFFIX), ""))
    text = strip(F.regexp_replace(text, java(fixed.TITLE_CHAPTER_SUFFIX), ""))
    return F.left(F.when(F.length(text) >= 2, text), F.lit(120))
