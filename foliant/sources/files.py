"""Captured pages, chapter caches, plans and finished books as files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import assemble
from . import datasource

PLAN_SCHEMA = "title string, catalog_url string, chapters array<struct<number:int,title:string,url:string>>, _corrupt_record string"


def decoded(body: Column, charset: Column) -> Column:
    """Bytes of a page as text: by the charset named for it, else UTF-8; bytes that don't fit become replacement characters."""

    @F.pandas_udf("string")
    def decode(raw: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else bytes(b).decode(n or "utf-8", errors="replace") for b, n in zip(raw, name, strict=True)])

    return decode(body, charset)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of captured pages in Parquet; the latest capture of a URL by `page_id` where that column is there."""
    pages = spark.read.parquet(path)
    if "page_id" not in pages.columns:
        return pages.select("url", "html")
    return pages.groupBy("url").agg(F.max_by("html", "page_id").alias("html"))


def read_html_files(spark: SparkSession, path: str, charset: str = "utf-8") -> DataFrame:
    """(path, html) of a folder of HTML files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decoded(F.col("content"), F.lit(charset)).alias("html"))


def read_cache(spark: SparkSession, root: str) -> DataFrame:
    """(site, cache_key, number, text) of a cache laid out as site/key/chapters/000001.txt; files with other names are left out."""
    files = spark.read.text(f"{root}/*/*/chapters/*.txt", wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    part = lambda i: F.regexp_extract("p", r"([^/]+)/([^/]+)/chapters/(\d+)\.txt$", i)
    return files.where(part(3) != "").select(part(1).alias("site"), part(2).alias("cache_key"), part(3).cast("int").alias("number"), F.col("value").alias("text"))


def write_cache(chapters: DataFrame, path: str) -> None:
    """Chapters (site, cache_key, number, title, content) as cache rows, a folder for each book. Each book's folder is replaced by itself, so a reader may see some books as they
    were and others as they are; `snapshots.Snapshots` gives whole versions."""
    rows = chapters.select("site", "cache_key", "number", F.concat(text.block(F.col("title"), F.col("content")), F.lit("\n")).alias("text"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site", "cache_key").parquet(path)


def read_cache_table(spark: SparkSession, path: str) -> DataFrame:
    """(site, cache_key, number, text) of a cache that `write_cache` wrote."""
    return spark.read.schema("number int, text string, site string, cache_key string").parquet(path).select("site", "cache_key", "number", "text")


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """(catalog_url, title, number, chapter_title, url) of `book.json` files; a file that can't be read gives one row of nulls with `corrupt`."""
    plans = spark.read.schema(PLAN_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = plans.select("catalog_url", "title", F.explode_outer("chapters").alias("c"), F.col("_corrupt_record").isNotNull().alias("corrupt"))
    return rows.select("catalog_url", "title", "c.number", F.col("c.title").alias("chapter_title"), "c.url", "corrupt")


def write_plans(plans: DataFrame, links: DataFrame, path: str) -> None:
    """Plans (catalog_url, title) with their links (catalog_url, number, title, url) as JSON lines."""
    lists = links.groupBy("catalog_url").agg(F.array_sort(F.collect_list(F.struct("number", "title", "url"))).alias("chapters"))
    plans.join(lists, "catalog_url", "left").select("title", "catalog_url", "chapters").write.mode("overwrite").json(path)


def write_books(chapters: DataFrame, keys: list[str], path: str) -> None:
    """A folder for each book with its text in one file."""
    books = assemble.joined(chapters, keys).select(*keys, F.regexp_replace("text", r"\n\z", "").alias("value"))
    books.repartition(*keys).write.mode("overwrite").partitionBy(*keys).text(path)


def cache_columns(plans: DataFrame) -> DataFrame:
    """Adds the key and the site that a plan's cache has."""
    return plans.withColumn("cache_key", text.cache_key(F.col("catalog_url"))).withColumn("site", urls.site_name(F.col("catalog_url"), F.lit("generic")))


def write_cache_files(chapters: DataFrame, path: str) -> None:
    """Chapters (site, cache_key, number, title, content) as site/key/chapters/000001.txt, each file whole or not there; of rows that repeat a chapter the greatest text counts."""
    chapters.sparkSession.dataSource.register(datasource.TextFiles)
    name = F.concat_ws("/", "site", "cache_key", F.lit("chapters"), F.concat(text.six_digits(F.col("number")), F.lit(".txt")))
    one = chapters.groupBy(name.alias("file")).agg(F.max(text.block(F.col("title"), F.col("content"))).alias("text"))
    one.select("file", F.lit(0).cast("long").alias("place"), "text").write.format("foliant_text_files").option("path", path).mode("append").save()


def read_cache_files(spark: SparkSession, path: str, sites: list[str] | None = None, keys: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """(site, cache_key, number, text) of such files, of these sites, keys and numbers only, if given: no other folder or file is opened."""
    spark.dataSource.register(datasource.CacheFiles)
    some = {"sites": sites, "keys": keys, "first": first, "last": last}
    return spark.read.format("foliant_cache").option("path", path).options(**{k: json.dumps(v) for k, v in some.items() if v is not None}).load()


def write_book_files(chapters: DataFrame, titles: DataFrame, keys: list[str], path: str) -> None:
    """Each book's chapters (*keys, number, title, content) in one file that is named for its title (*keys, book_title): blocks with an empty line between, a line end at the last. Books that
    share a name are told apart by a number in the order of their keys. A book is written chapter by chapter, and is there as a whole or not at all."""
    chapters.sparkSession.dataSource.register(datasource.TextFiles)
    named = titles.select(*keys, text.file_name(F.col("book_title")).alias("name"))
    turn = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(*keys))
    names = named.withColumn("turn", turn).select(*keys, F.concat("name", F.when(F.col("turn") > 1, F.format_string(" (%d)", "turn")).otherwise(""), F.lit(".txt")).alias("file"))
    rows = chapters.join(names, keys).select("file", F.col("number").cast("long").alias("place"), text.block(F.col("title"), F.col("content")).alias("text"))
    rows.repartition("file").sortWithinPartitions("file", "place").write.format("foliant_text_files").option("path", path).mode("append").save()
