"""Chapter clean-up by dialect: notices, labels and repeated titles go, headings become titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.urls import let
from . import dialects


def sanitize(chapters: DataFrame) -> DataFrame:
    """`chapters` (adapter, book_title, number, title, content) with title and content cleaned as their dialect says; the first chapter is the one numbered 1. Applying it
    twice gives the same. A dialect without a rule leaves chapters as they are."""
    book, number = F.col("book_title"), F.col("number")

    def cleaned(clean_title, lines):
        chapter = dialects.Chapter(F.col("title"), clean_title, lines, number, book, number == 1)
        as_it_is = F.struct(F.col("title").alias("title"), F.col("content").alias("content"))
        return dialects.hook(F.col("adapter"), lambda d: d.clean(chapter), as_it_is)

    bound = let(text.clean_lines(F.col("title")), lambda t: let(text.line_list(F.col("content")), lambda lines: cleaned(t, lines)))
    return chapters.withColumn("_clean", bound).withColumn("title", F.col("_clean.title")).withColumn("content", F.col("_clean.content")).drop("_clean")
