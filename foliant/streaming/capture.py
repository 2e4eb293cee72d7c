"""Streams of captured pages: links as they arrive, and a chapter cache kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import dialects, dom, links

PAGE_SCHEMA = "url string, html string, captured timestamp"


def first_captures(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each URL once; state older than `late` behind the newest capture is dropped."""
    clean = pages.withColumn("url", urls.normalize(F.col("url")))
    return clean.withWatermark("captured", late).dropDuplicatesWithinWatermark(["url"])


def link_stream(pages: DataFrame) -> DataFrame:
    """(page, url, title) of the same-origin links of each page; no state, any output mode."""
    nodes = dom.select(pages.select("url", "html"), {"links": ["a[href]"]})
    rows = nodes.select(F.col("url").alias("page"), F.col("link").alias("url"), text.clean_lines(F.col("spaced")).alias("title"))
    return rows.where(F.col("url").isNotNull() & urls.same_origin(F.col("url"), F.col("page")))


def catalog_sink(path: str):
    """A foreachBatch function that writes each batch's catalogs under its batch id, so that a batch done twice is there once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        pages = dialects.dispatch(batch.select("url", "html"))
        nodes = dom.select(pages, links.catalog_groups())
        links.catalog_links(nodes.withColumn("page", F.col("url")), ["page"]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def failure_counts(attempts: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Attempts (site, status, ts) by site and time window: how many, and how many failed."""
    return attempts.withWatermark("ts", late).groupBy(F.window("ts", width), "site").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") != "ok", 1)).alias("n_failed"))
