"""Real chapters from parts by their headings, and books from chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.fixed import java
from . import dialects


SPAN = 256


def sessions(lines: DataFrame, keys: list[str], first_titles: DataFrame, order: list[str], span: int = SPAN) -> DataFrame:
    """(*keys, number, title, content) from `lines` (*keys, *order, is_heading, line): each heading starts a chapter. Lines before the first heading
    belong to a chapter titled `first_title` (from `first_titles`); where that is null they go to the first headed chapter, and without any heading
    there is no chapter at all.

    Headings are counted within ranges of `span` values of the first column of `order`, a whole number, and moved on by the sums of the ranges before, so that a book of any
    length is many tasks; a chapter's number follows from the count."""
    block = F.floor(F.col(order[0]) / span)
    dealt = lines.withColumn("_block", block)
    sums = dealt.groupBy(*keys, "_block").agg(F.sum(F.col("is_heading").cast("long")).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    run = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = dealt.withColumn("_own", F.sum(F.col("is_heading").cast("long")).over(run)).join(starts, [*keys, "_block"])
    numbered = counted.withColumn("sid", F.col("_start") + F.col("_own")).join(first_titles, keys)
    numbered = numbered.withColumn("sid", F.when((F.col("sid") == 0) & F.col("first_title").isNull(), 1).otherwise(F.col("sid")))
    line = F.struct(*order, "line")
    grouped = numbered.groupBy(*keys, "sid").agg(
        F.max(F.when(F.col("is_heading"), F.col("line"))).alias("heading"),
        F.array_sort(F.collect_list(F.when(~F.col("is_heading"), line))).alias("body"),
    )
    # The first title has a chapter even if no line stands before the first heading; it is number 1 then.
    opening = first_titles.where("first_title IS NOT NULL").select(*keys, F.lit(True).alias("opens"), "first_title")
    first = opening.select(*keys, F.lit(0).cast("long").alias("sid"), "first_title")
    every = grouped.join(first, [*keys, "sid"], "full").withColumn("title", F.coalesce("heading", "first_title")).where("title IS NOT NULL").drop("first_title")
    content = F.array_join(F.transform(F.coalesce("body", F.array().cast(grouped.schema["body"].dataType)), lambda x: x["line"]), "\n")
    number = F.col("sid") + F.when(F.col("opens"), 1).otherwise(0)
    return every.join(opening.drop("first_title"), keys, "left").select(*keys, number.cast("int").alias("number"), "title", content.alias("content"))


def chapter_lines(chapters: DataFrame, keys: list[str], heading: Column | None = None) -> DataFrame:
    """(*keys, number, line_pos, is_heading, line) of the chapters' clean lines."""
    rows = chapters.select(*keys, "number", F.posexplode(text.line_list(F.col("content"))).alias("line_pos", "line"))
    return rows.withColumn("is_heading", F.col("line").rlike(java(fixed.CHAPTER_HEADING)) if heading is None else heading)


def assemble(chapters: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters of a book (*keys, adapter, number, title, content) in their final form: put together as their dialect says, or as they are."""
    own = {d.name: rows for d in dialects.known() if (rows := d.assemble(chapters.where(F.col("adapter") == d.name), keys)) is not None}
    out = (chapters.where(~F.col("adapter").isin(*own)) if own else chapters).select(*keys, "number", "title", "content")
    for rows in own.values():
        out = out.unionByName(rows)
    return out


def joined(chapters: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, n_chapters, text): a book's blocks in order, an empty line between two, a line end at the last."""
    block = F.struct("number", text.block(F.col("title"), F.col("content")).alias("b"))
    rows = chapters.groupBy(*keys).agg(F.count("*").alias("n_chapters"), F.array_sort(F.collect_list(block)).alias("blocks"))
    return rows.select(*keys, "n_chapters", F.concat(F.array_join(F.transform("blocks", lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("text"))
