"""Chapters from captured pages: content, titles, continuation pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..session import written
from . import dialects

MIN_OWN, MIN_GENERIC, MIN_LEFT_OWN, MIN_LEFT_GENERIC = 10, 80, 10, 20
MAX_PAGES = 50


def content_groups() -> dict[str, list[str]]:
    return {f"content:{d.name}": [*d.content, *fixed.GENERIC_CONTENT_SELECTORS] for d in dialects.known()} | {"chapter_title": [", ".join(fixed.CHAPTER_TITLE_SELECTORS)]}


def block_score(size, n_links, priority):
    """How good a block is, of numbers or of columns."""
    return size - 25 * n_links - 1000 * priority


def content_scores() -> dict:
    """For `dom.select`: which block of a page is its content. Blocks that are too short for their selector don't count."""

    def of(n_own: int):
        return lambda rank, size, n_links: block_score(size, n_links, rank) if size >= (MIN_OWN if rank < n_own else MIN_GENERIC) else None

    return {f"content:{d.name}": of(len(d.content)) for d in dialects.known()}


def best_block(candidates: DataFrame, keys: list[str], length: str, n_links: str, priority: str, order: str) -> DataFrame:
    """The row with the greatest `block_score`; ties go to the smaller priority, then to the earlier row."""
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), priority, order)
    scored = candidates.withColumn("score", block_score(F.col(length), F.col(n_links), F.col(priority)))
    return scored.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def contents(nodes: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, title, content, status) of each page: `ok`, or `extract_error` where no block is found or too little of it is left. The title is the
    first heading's in document order, null if there is none; `nodes` has the groups of `content_groups`, with `content_scores`."""
    sizes = F.create_map(*(x for d in dialects.known() for x in (F.lit(d.name), F.lit(len(d.content)))))
    best = nodes.where(F.col("grp") == F.concat(F.lit("content:"), F.col("adapter")))
    best = best.select(*keys, text.clean_lines(F.col("bare")).alias("content"), (F.col("rank") < sizes[F.col("adapter")]).alias("own"))
    titles = nodes.where("grp = 'chapter_title'").groupBy(*keys).agg(F.min_by(text.clean_lines(F.col("spaced")), "node_id").alias("title"))
    out = pages.select(*keys, "adapter").join(best, keys, "left").join(titles, keys, "left")
    fine = F.length("content") >= F.when(F.col("own"), MIN_LEFT_OWN).otherwise(MIN_LEFT_GENERIC)
    better = dialects.hook(F.col("adapter"), lambda d: d.page_title(F.col("content")), F.lit(None).cast("string"))
    status = F.when(F.coalesce(fine, F.lit(False)), "ok").otherwise("extract_error")
    return out.select(*keys, F.coalesce(better, "title").alias("title"), F.when(status == "ok", F.col("content")).alias("content"), status.alias("status"))


def follow(starts: DataFrame, edges: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """(key, step, url, status) along next links: starts (key, url), edges (url, next_url), URLs normalised. status is `loop` on a step back to a
    page that the chain has been to, `too_many_pages` on the last allowed page if a next one exists, `missing` on a page not captured, else `ok`.

    By doubling: where each page leads in 2**i steps is worked out from 2**(i-1) steps, and all steps known of a chain move on by as many at once, so 50 pages take six
    rounds of equi-joins on narrow rows. Pages without a next one leave the jumps after one round."""
    known = written(edges.groupBy("url").agg(F.max("next_url").alias("next_url")))
    jump = known.where("next_url IS NOT NULL").select("url", F.col("next_url").alias("to"))
    rows, reach = written(starts.select("key", F.lit(1).alias("step"), "url")), 1
    while reach < max_pages:
        ahead = written(rows.where(F.col("step") <= max_pages - reach).join(jump, "url").select("key", (F.col("step") + reach).alias("step"), F.col("to").alias("url")))
        rows, reach = rows.unionByName(ahead), 2 * reach
        if reach >= max_pages or ahead.isEmpty():
            break
        jump = written(jump.join(jump.select(F.col("url").alias("to"), F.col("to").alias("far")), "to").select("url", F.col("far").alias("to")))
    again = rows.withColumn("_seen", F.row_number().over(Window.partitionBy("key", "url").orderBy("step")) > 1)
    end = F.min(F.when(F.col("_seen"), F.col("step"))).over(Window.partitionBy("key"))
    chain = again.withColumn("_end", end).where(F.col("_end").isNull() | (F.col("step") <= F.col("_end")))
    chain = chain.join(known.withColumn("captured", F.lit(True)), "url", "left")
    status = F.when(F.col("_seen"), "loop").when(F.col("captured").isNull(), "missing").when((F.col("step") == max_pages) & F.col("next_url").isNotNull(), "too_many_pages").otherwise("ok")
    return chain.select("key", "step", "url", status.alias("status"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One chapter of its pages: contents in order, and the link's title unless it does not start with `第`; then each page's in turn until one does.
    `parts`: *keys, number, link_title, step, title, content."""
    rows = parts.groupBy(*keys, "number").agg(F.array_sort(F.collect_list(F.struct("step", "title", "content"))).alias("p"), F.first("link_title").alias("link_title"))
    starts = lambda t: F.coalesce(F.startswith(F.regexp_replace(t, r"(?U)^[\s\x1c-\x1f]+", ""), F.lit("第")), F.lit(False))
    title = F.aggregate("p", F.col("link_title"), lambda acc, x: F.when(starts(acc), acc).otherwise(F.coalesce(x["title"], text.numbered(F.col("number")))))
    title = F.coalesce(F.nullif(title, F.lit("")), text.numbered(F.col("number")))
    return rows.select(*keys, "number", title.alias("title"), F.array_join(F.transform("p", lambda x: x["content"]), "\n\n").alias("content"))


def start_urls(links: DataFrame) -> DataFrame:
    """`links` with the address that a chapter's first page has."""
    return links.withColumn("start_url", dialects.canonical_chapter(F.col("url"), F.col("adapter")))
