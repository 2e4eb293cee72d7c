"""A chapter cache kept up to date by a stream of catalogs and chapters.

Each micro-batch may bring catalog revisions, each a book's whole list of links, and chapters. Where a revision stands other URLs under the numbers, the chapters that are cached already
follow their URLs, as `cache.realign` has it; what its list no longer has goes. New chapters go on top. Both tables are `Snapshots`: a batch is one version of each, marked with its number, so a batch that comes again
after a failure changes nothing, and one that failed between the tables is finished when it comes again. Readers see whole versions throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cache
from ..session import written
from ..sources.snapshots import Snapshots

BATCH_SCHEMA = "kind string, seq long, book string, number int, url string, text string"


def _rows(frame: DataFrame, value: str) -> DataFrame:
    return frame.select(F.lit("").alias("site"), F.col("book").alias("cache_key"), "number", F.col(value).alias("text"))


def _of(table: Snapshots, value: str, version: int | None = None) -> DataFrame:
    return table.read(version).select(F.col("cache_key").alias("book"), "number", F.col("text").alias(value))


def upkeep_sink(spark, path: str, compact_after: int = 20) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for rows (kind, seq, book, number, url, text): kind `link` is a line of a catalog revision, numbered by seq, of which a batch's greatest for a book counts; kind `chapter` is a
    chapter's text, of which the one with the greatest seq counts."""
    links, kept = Snapshots(spark, f"{path.rstrip('/')}/links"), Snapshots(spark, f"{path.rstrip('/')}/chapters")

    def write(batch: DataFrame, batch_id: int) -> None:
        if links.batch() >= batch_id:
            return
        batch = written(batch)
        newest = Window.partitionBy("book").orderBy(F.desc("seq"))
        new = batch.where("kind = 'link'").withColumn("_k", F.rank().over(newest)).where("_k = 1").select("book", "number", "url").dropDuplicates(["book", "number"])
        if kept.batch() < batch_id:
            kept.write(_rows(_chapters(batch, new, _of(links, "url"), _of(kept, "text")), "text"), batch_id)
        old = _of(links, "url").join(new.select("book").distinct(), "book", "left_semi")
        links.write(_rows(_replaced(old, new, "url"), "url"), batch_id)
        for table in (links, kept):
            table.compact(compact_after)

    return write


def _replaced(old: DataFrame, new: DataFrame, value: str) -> DataFrame:
    """`new`, and the numbers that only `old` has without a value, which deletes them."""
    gone = old.join(new.select("book", "number"), ["book", "number"], "left_anti").select("book", "number", F.lit(None).cast("string").alias(value))
    return new.select("book", "number", value).unionByName(gone)


def _chapters(batch: DataFrame, new: DataFrame, links: DataFrame, have: DataFrame) -> DataFrame:
    """What changes in the cache: books with a revision as they are after it, and the batch's chapters on top."""
    revised = new.select("book").distinct()
    before = written(have.join(revised, "book", "left_semi"))
    moved = written(cache.realign(links.join(revised, "book", "left_semi"), new, before, ["book"]).select("book", "number", "text"))
    # What the revision's list no longer has goes, in unchanged books too.
    listed = moved.join(new.select("book", "number"), ["book", "number"], "left_semi")
    last = Window.partitionBy("book", "number").orderBy(F.desc("seq"), F.desc("text"))
    came = batch.where("kind = 'chapter'").withColumn("_k", F.row_number().over(last)).where("_k = 1").select("book", "number", "text")
    return came.unionByName(_replaced(before, listed, "text").join(came.select("book", "number"), ["book", "number"], "left_anti"))


def state(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(book, number, url) and (book, number, text) as the last whole batch left them."""
    return tuple(_of(Snapshots(spark, f"{path.rstrip('/')}/{name}"), value) for name, value in (("links", "url"), ("chapters", "text")))
