"""One run over captured pages: discovery, cache, chapters, early stop, collation and report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import assemble, cache, chapters, report
from ..session import written
from . import books

BOOK = ["book"]


@dataclass(frozen=True)
class Options:
    """What a run is asked for; anything that makes no sense raises ValueError."""

    url: str | None = None
    query: str | None = None
    pick: int | None = None
    delay: float = 1.0
    timeout: float = 20.0
    retries: int = 3
    max_pages: int = chapters.MAX_PAGES
    first: int | None = None
    most_failures: int = 5
    refresh: bool = False

    def __post_init__(self) -> None:
        if (self.url is None) == (self.query is None):
            raise ValueError("either a url or a query is needed, not both")
        if self.pick is not None and self.query is None:
            raise ValueError("pick needs a query")
        if self.query is not None and not self.query.strip():
            raise ValueError("a search needs a word")
        if self.delay < 0 or self.timeout <= 0:
            raise ValueError("delay must not be negative, timeout must be positive")
        for name in ("pick", "retries", "max_pages", "first", "most_failures"):
            value = getattr(self, name)
            if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
                raise ValueError(f"{name} must be a positive whole number")


def run(pages: DataFrame, inputs: DataFrame, kept: DataFrame | None = None, old: DataFrame | None = None, most_failures: int = 5, first: int | None = None, refresh: bool = False, max_pages: int = chapters.MAX_PAGES, interrupted: bool = False) -> dict[str, DataFrame]:
    """Tables of a run for input addresses (book): `plans`, `links`, `cache` (book, number, text) as it is afterwards, `chapters` and `report`.

    `kept` is the cache before the run and `old` the links (book, number, url) that it was made for; if a catalog changed since, cached chapters follow their URLs. A book
    stops at its first blocked page or the `most_failures`-th error in a row; what would have come later is failed, however its pages were captured."""
    one, nodes = books.page_nodes(pages)
    plans, found = map(written, books.discover(one, nodes, inputs))
    empty = found.select("book", "number", F.lit(None).cast("string").alias("text")).limit(0)
    have = empty if kept is None else kept.select("book", "number", "text")
    if kept is not None and old is not None:
        have = cache.realign(old, found, have, BOOK).select("book", "number", "text")
    have = written(have)
    chosen = found if first is None else found.where(F.col("number") <= first)
    todo = cache.worklist(found, have, BOOK, refresh, first)
    done = written(books.fetch_chapters(one, nodes, plans, todo, max_pages))
    state = F.when(F.col("status").isNull(), "cache").when(F.col("status").isin("ok", "blocked"), F.col("status")).otherwise("error")
    attempts = chosen.select("book", "number").join(done.select("book", "number", "status"), [*BOOK, "number"], "left").select("book", F.col("number").alias("idx"), state.alias("st"))
    failed = written(report.breaker(attempts, BOOK, most_failures, refresh).withColumnRenamed("idx", "number"))
    block = F.concat(text.block(F.col("title"), F.col("content")), F.lit("\n"))
    new = done.where("status = 'ok'").join(failed, [*BOOK, "number"], "left_anti").select("book", "number", block.alias("text"))
    after = written(have.join(new, [*BOOK, "number"], "left_anti").unionByName(new))
    got = written(cache.collate(chosen, after, BOOK, failed, interrupted))
    whole = assemble.assemble(got.where("cached_title IS NOT NULL").select("book", "adapter", "number", F.col("cached_title").alias("title"), "content"), BOOK)
    skipped = cache.first_chapters(found, BOOK, first) if first is not None else found.select("book").distinct().withColumn("n_skipped", F.lit(0))
    return {"plans": plans, "links": found, "cache": after, "chapters": whole, "report": report.run_report(got, whole, skipped, BOOK, interrupted)}
