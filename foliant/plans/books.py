"""From captured pages to books: discovery, chapters along their pages, clean-up, assembly. All books at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text, urls
from ..operators import assemble, chapters, dialects, dom, links
from ..operators.sanitize import sanitize
from ..session import written


def page_nodes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages (url, adapter, blocked), selected nodes) of captured pages (url, html), one for each normalised URL: the one captured last, if there is a
    column `captured`; of equal ones that with the greater hash. Captures are parsed before one of each URL is chosen, so HTML is never shuffled."""
    captured = F.col("captured") if "captured" in pages.columns else F.lit(0)
    every = dialects.dispatch(pages.select(urls.normalize(F.col("url")).alias("url"), captured.alias("captured"), F.xxhash64("html").alias("version"), "html"))
    every = every.withColumn("url", dialects.normalize(F.col("url"), F.col("adapter")))
    last = every.groupBy("url", "adapter").agg(F.max(F.struct("captured", "version", text.is_verification_page(F.coalesce("html", F.lit(""))).alias("blocked"))).alias("last"))
    last = written(last.select("url", "adapter", "last.captured", "last.version", "last.blocked"))
    groups = links.catalog_groups() | chapters.content_groups() | {"title": fixed.TITLE_SELECTORS}
    nodes = dom.select(every, groups, best=chapters.content_scores())
    own = (F.col("captured").eqNullSafe(F.col("_captured"))) & (F.col("version") == F.col("_version")) & (F.col("url") == F.col("_url"))
    chosen = last.select(F.col("url").alias("_url"), F.col("captured").alias("_captured"), F.col("version").alias("_version"))
    # Equal captures of a page give equal nodes.
    nodes = nodes.join(chosen, own, "left_semi").dropDuplicates(["url", "grp", "rank", "node_id", "scope"]).drop("captured", "version")
    return last.select("url", "adapter", "blocked"), written(nodes)


def discover(pages: DataFrame, nodes: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans (book, adapter, catalog_url, title, status) and links (book, adapter, number, title, url) for input addresses (book). A page whose address
    has a chapter's shape is never read as a catalog; its catalog link is followed, else the guessed address, one hop only. status: ok, no_catalog (no
    way to one), empty_catalog (the page has none), or missing (not captured)."""
    keyed = pages.select("url", "adapter")
    start = inputs.select("book", urls.normalize(F.col("book")).alias("url")).join(keyed, "url", "left")
    guess = dialects.guess_catalog(F.col("url"), F.col("adapter"))
    start = start.withColumn("guess", guess).withColumn("chapter", F.coalesce(urls.normalize(F.col("guess")) != F.col("url"), F.lit(False)))
    lists = written(links.catalog_links(nodes.withColumn("page", F.col("url")), ["page"]))
    has = lists.select(F.col("page").alias("url")).distinct().withColumn("has", F.lit(True))
    near = links.neighbours(nodes.withColumn("page_key", F.col("url")), ["page_key"])
    start = start.join(has, "url", "left").join(near.select(F.col("page_key").alias("url"), "catalog_link"), "url", "left")
    own = ~F.col("chapter") & F.coalesce("has", F.lit(False))
    other = F.coalesce("catalog_link", "guess")
    target = F.when(own, F.col("url")).when(urls.normalize(other) != F.col("url"), urls.normalize(other))
    plans = start.select("book", target.alias("catalog_url"), F.col("adapter").isNull().alias("lost"))
    plans = plans.join(keyed.withColumnRenamed("url", "catalog_url"), "catalog_url", "left").join(has.withColumnRenamed("url", "catalog_url"), "catalog_url", "left")
    status = F.when(F.col("lost"), "missing").when(F.col("catalog_url").isNull(), "no_catalog").when(F.col("adapter").isNull(), "missing").when(F.col("has").isNull(), "empty_catalog").otherwise("ok")
    titles = links.with_title(pages.select("url", "adapter"), links.book_titles(nodes, ["url"]), ["url"]).select(F.col("url").alias("catalog_url"), "title")
    plans = plans.withColumn("status", status).join(titles, "catalog_url", "left").select("book", "adapter", "catalog_url", "title", "status")
    found = plans.where("status = 'ok'").select("book", F.col("catalog_url").alias("page")).join(lists, "page").select("book", "adapter", "number", "title", "url")
    return plans, found


def fetch_chapters(pages: DataFrame, nodes: DataFrame, plans: DataFrame, found: DataFrame, max_pages: int = chapters.MAX_PAGES) -> DataFrame:
    """(book, adapter, number, title, content, status) of links along their captured pages, cleaned. status is ok or the first thing that went wrong; `blocked` is a page
    that asks for verification."""
    todo = chapters.start_urls(found).withColumn("key", F.concat_ws("\x1f", "book", F.col("number").cast("string")))
    near = links.neighbours(nodes.withColumn("page_key", F.col("url")), ["page_key"])
    edges = pages.select("url").join(near.select(F.col("page_key").alias("url"), F.col("next_link").alias("next_url")), "url", "left")
    chain = written(chapters.follow(todo.select("key", F.col("start_url").alias("url")), written(edges), max_pages))
    body = written(chapters.contents(nodes, pages, ["url"]))
    parts = chain.withColumnRenamed("status", "step_status").join(body, "url", "left").join(pages.select("url", "blocked"), "url", "left")
    state = F.when(F.col("blocked"), "blocked").when(F.col("step_status") != "ok", F.col("step_status")).otherwise(F.col("status"))
    parts = parts.withColumn("state", state).join(todo.select("key", "book", F.col("number"), F.col("title").alias("link_title")), "key")
    wrong = parts.where("state <> 'ok'").groupBy("book", "number").agg(F.min_by("state", "step").alias("wrong"))
    whole = chapters.merged(parts.where("state = 'ok'").select("book", "number", "link_title", "step", "title", "content"), ["book"])
    every = found.select("book", "adapter", "number").join(wrong, ["book", "number"], "left").join(whole, ["book", "number"], "left")
    every = every.join(plans.select("book", F.col("title").alias("book_title")), "book").withColumn("status", F.coalesce("wrong", F.lit("ok")))
    return sanitize(every).select("book", "adapter", "number", F.when(F.col("status") == "ok", F.col("title")).alias("title"), F.when(F.col("status") == "ok", F.col("content")).alias("content"), "status")


def books(pages: DataFrame, inputs: DataFrame, max_pages: int = chapters.MAX_PAGES) -> DataFrame:
    """(book, catalog_url, title, file_name, n_chapters, failed, text) of each input address with a plan."""
    one, nodes = page_nodes(pages)
    plans, found = map(written, discover(one, nodes, inputs))
    done = written(fetch_chapters(one, nodes, plans, found, max_pages))
    failed = done.groupBy("book").agg(F.array_sort(F.collect_set(F.when(F.col("status") != "ok", F.col("number")))).alias("failed"))
    whole = assemble.joined(assemble.assemble(done.where("status = 'ok'"), ["book"]), ["book"])
    return plans.where("status = 'ok'").join(failed, "book", "left").join(whole, "book", "left").select("book", "catalog_url", "title", F.concat(text.file_name(F.col("title")), F.lit(".txt")).alias("file_name"), F.coalesce("n_chapters", F.lit(0)).alias("n_chapters"), "failed", "text")
