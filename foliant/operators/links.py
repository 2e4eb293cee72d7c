"""Links of captured pages: resolution, catalogs, orientation, titles, and the neighbours of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text, urls
from ..functions.fixed import java
from ..session import written
from . import dialects, dom

LAST = 1_000_000


def dedupe(links: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """The first link to each URL by `pos` within `keys`."""
    first = Window.partitionBy(*keys, "url").orderBy(pos)
    return links.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def orient(links: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Adds `number` 1..n: by `pos`, or against it if at least three numbers are known and the median of their steps that aren't 0 is negative.
    A blank title becomes that of its number."""
    by = Window.partitionBy(*keys)
    known = links.withColumn("_num", text.chapter_number(F.col("title"))).withColumn("_known", F.col("_num") > 0)
    last = F.last(F.when(F.col("_known"), F.col("_num")), ignorenulls=True).over(by.orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    step = known.withColumn("_step", F.when(F.col("_known"), F.col("_num") - last))
    facts = step.groupBy(*keys).agg(F.count(F.when(F.col("_known"), 1)).alias("_n"), F.median(F.when(F.col("_step") != 0, F.col("_step"))).alias("_median"))
    back = (F.col("_n") >= 3) & (F.coalesce("_median", F.lit(0.0)) < 0)
    facts = facts.select(*keys, back.alias("_back"))
    order = by.orderBy(F.when(F.col("_back"), -F.col(pos)).otherwise(F.col(pos)))
    out = step.join(facts, keys).withColumn("number", F.row_number().over(order))
    return out.withColumn("title", F.when(F.col("title") == "", text.numbered(F.col("number"))).otherwise(F.col("title"))).drop("_num", "_known", "_step", "_back")


def is_chapter_link(title: Column, url: Column) -> Column:
    path = F.lower(urls.part(url, "path"))
    shaped = path.rlike(java(fixed.CHAPTER_PATH)) | path.rlike(java(fixed.DEEP_NUMBER_PATH))
    return ~title.isin(fixed.NAVIGATION) & (text.is_chapter_title(title) | shaped)


def catalog_groups() -> dict[str, list[str]]:
    return {f"catalog:{d.name}": list(d.catalog) for d in dialects.known()} | {"links": ["a[href]"]}


def catalog_links(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, adapter, number, title, url) of each page's catalog: from the dialect's first selector with two or more distinct chapter links, else
    from all links if there are two; `nodes` has the groups of `catalog_groups` and the columns url and adapter of their page."""
    own = F.col("grp") == F.concat(F.lit("catalog:"), F.col("adapter"))
    found = nodes.where(own | (F.col("grp") == "links")).select(
        *keys, "adapter", F.col("url").alias("page_url"), F.when(own, F.col("rank")).otherwise(LAST).alias("sel"), F.col("node_id").alias("pos"), text.clean_lines(F.col("spaced")).alias("title"), "link"
    )
    found = found.where(F.col("link").isNotNull() & urls.same_origin(F.col("link"), F.col("page_url")) & (F.length("title") <= 120))
    # Narrow rows that several steps read: written once, so that pages are parsed once.
    found = written(found.where(is_chapter_link(F.col("title"), F.col("link"))).select(*keys, "adapter", "sel", "pos", "title", F.col("link").alias("url")))
    unique = dedupe(found, [*keys, "sel"])
    sizes = unique.groupBy(*keys, "sel").count().where("count >= 2").groupBy(*keys).agg(F.min("sel").alias("sel"))
    chosen = written(orient(unique.join(sizes, [*keys, "sel"]), keys).select(*keys, "adapter", "number", "title", "url"))
    own = {d.name: rows for d in dialects.known() if (rows := d.chapter_list(chosen.where(F.col("adapter") == d.name), keys)) is not None}
    out = chosen.where(~F.col("adapter").isin(*own)) if own else chosen
    for rows in own.values():
        out = out.unionByName(rows)
    return out


def book_titles(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, title): the first usable title of the cascade; of each selector only its first node counts. `nodes`: group `title`."""
    first = Window.partitionBy(*keys, "rank").orderBy("node_id")
    own = nodes.where("grp = 'title'").withColumn("_k", F.row_number().over(first)).where("_k = 1")
    raw = text.clean_lines(F.when(F.col("tag") == "meta", F.coalesce("content", F.lit(""))).otherwise(F.col("spaced")))
    found = own.withColumn("title", text.book_title(raw)).where("title IS NOT NULL")
    return found.groupBy(*keys).agg(F.min_by("title", "rank").alias("title"))


def with_title(pages: DataFrame, titles: DataFrame, keys: list[str]) -> DataFrame:
    """`pages` with `title`, from the URL's last path segment where no title was found."""
    tail = F.nullif(F.element_at(F.split(F.regexp_replace(urls.part(F.col("url"), "path"), "/+$", ""), "/"), -1), F.lit(""))
    out = pages.join(titles.withColumnRenamed("title", "_title"), keys, "left")
    return out.withColumn("title", dialects.site_title(F.coalesce("_title", tail, F.lit(fixed.DEFAULT_TITLE)), F.col("adapter"))).drop("_title")


def neighbours(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, catalog_link, next_link) of each page with links: the first link to a table of contents, and the page that continues it."""
    own = nodes.where("grp = 'links'").select(*keys, "adapter", "node_id", F.col("url").alias("_page_url"), text.clean_lines(F.col("spaced")).alias("label"), "link")
    own = own.where(F.col("link").isNotNull() & urls.same_origin(F.col("link"), F.col("_page_url")))
    ahead = (F.length("label") <= 12) & dialects.marked(fixed.NEXT_MARKERS, F.col("label"))
    path, target = urls.part(F.col("_page_url"), "path"), urls.part(F.col("link"), "path")
    page_number = F.coalesce(F.nullif(F.regexp_extract(path, fixed.PAGE_STEM, 2), F.lit("")).cast("int"), F.lit(1))
    stem = F.regexp_extract(path, fixed.PAGE_STEM, 1)
    own_tail = F.when(path.rlike(fixed.PAGE_STEM) & F.startswith(F.lower(target), F.lower(stem)), F.substring(target, F.length(stem) + 1, F.length(target)))
    n = F.nullif(F.regexp_extract(own_tail, fixed.PAGE_TAIL, 1), F.lit("")).cast("int")
    facts = own.groupBy(*keys).agg(
        F.min_by("link", F.when(dialects.catalog_label(F.col("label"), F.col("adapter")), F.col("node_id"))).alias("catalog_link"),
        F.min_by("link", F.when(ahead, F.col("node_id"))).alias("_linked"),
        F.min(F.when(n > page_number, F.struct(n.alias("n"), F.col("link")))).alias("_next"),
        F.first("adapter").alias("_adapter"),
        F.first("_page_url").alias("_page"),
    )
    own_next = dialects.hook(F.col("_adapter"), lambda d: d.next_page(F.col("_linked"), F.col("_next.link"), F.col("_page")), F.col("_linked"))
    return facts.select(*keys, "catalog_link", own_next.alias("next_link"))
