"""Queries against their SQL on tables with rows that the given ones lack."""

import oracle
from pyspark.sql import functions as F

from foliant.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def differs(spark, folder, name, **tables) -> str:
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return oracle.compare(spark, QUERIES[name], SQL[name], str(folder))


PAGES = "page_id long, url string, html string"


def page(title, body):
    return f"<html><head><title>{title}</title></head><body><article><h1>{title}</h1><p>{body}</p></article></body></html>"


OPEN_REFERENCES = [(i, f"https://a.example.com/{i}", page(f"Haan by&amp;&amp{end}", f"words of the page &quot;{end} &copy; &amp")) for i, end in enumerate(("", " x", "&am", "&", "&amp;", "&lt", "&#39", "&#39;"))]


def test_page_titles_open_references(spark, tmp_path):
    assert differs(spark, tmp_path, "page_titles", pages=(OPEN_REFERENCES, PAGES)) == ""


def test_page_content_open_references(spark, tmp_path):
    assert differs(spark, tmp_path, "page_content", pages=(OPEN_REFERENCES, PAGES)) == ""


def test_cache_realign_repeated_urls(spark, tmp_path):
    rows = [(i, f"https://{host}.org/{i % 4}", "x") for host in ("ab", "abc") for i in range(9)]
    assert differs(spark, tmp_path, "cache_realign", pages=([(n, u, h) for n, (_, u, h) in enumerate(rows)], PAGES)) == ""


PART = "p_partkey long, p_name string"


def test_search_listing_without_results(spark, tmp_path):
    assert differs(spark, tmp_path, "search_listing", part=([(i, "large ring") for i in range(5)], PART)) == ""


def test_search_flow_over_several_pages(spark, tmp_path):
    rows = [(i, "red bolt" if i % 7 == 0 else "large ring") for i in range(0, 1900, 3)]
    assert differs(spark, tmp_path, "search_flow", part=(rows, PART)) == ""
    assert catalogue._responses(spark, str(tmp_path)).agg(F.max(F.length("html"))).first()[0] < 30_000
