"""Captured pages to books, files, and streams."""

import pytest
from pyspark.sql import functions as F

from foliant.plans import books, run
from foliant.sources import files
from foliant.streaming import capture

BOOK = "示例小说"
SITE = "https://www.trxs.cc/tongren"


def chapter(n, body, following=None, extra=""):
    link = f'<a href="{following}">下一页</a>' if following else ""
    return f'<html><head><title>{BOOK} 第{n}章</title></head><body><h1>{BOOK} 第{n}章</h1>{extra}<div class="read_chapterDetail"><p>{body}</p>{link}</div></body></html>'


def captured():
    catalog = f"<h1>{BOOK}</h1><div id='list'><dl>" + "".join(f"<dd><a href='/tongren/1/{n}.html'>第{n}章</a></dd>" for n in (1, 2, 3)) + "</dl></div>"
    return [
        (f"{SITE}/1.html", catalog),
        (f"{SITE}/1/1.html", chapter(1, "第一页的正文内容，足够长。", "1_2.html", '<a href="/tongren/1.html">目录</a><a href="/tongren/9/1.html">第9章 推荐</a><a href="/tongren/9/2.html">第10章</a>')),
        (f"{SITE}/1/1_2.html", chapter(1, "第二页的正文内容，足够长。")),
        (f"{SITE}/1/2.html#top", chapter(2, "另一章的正文内容，足够长。")),
        (f"{SITE}/1/3.html", "<html><body>失败</body></html>"),
        ("http://nowhere.com/x", "<p>none</p>"),
    ]


def test_books_from_a_catalog_and_from_a_chapter(spark):
    pages = spark.createDataFrame(captured(), "url string, html string")
    inputs = spark.createDataFrame([(f"{SITE}/1.html",), (f"{SITE}/1/1.html",), ("http://nowhere.com/x",), ("http://lost.com/",)], "book string")
    out = {r.book: r for r in books.books(pages, inputs).collect()}
    assert set(out) == {f"{SITE}/1.html", f"{SITE}/1/1.html"}
    for r in out.values():
        assert (r.catalog_url, r.title, r.file_name, r.n_chapters, r.failed) == (f"{SITE}/1.html", BOOK, f"{BOOK}.txt", 2, [3])
        assert r.text == "第1章\n\n第一页的正文内容，足够长。\n第二页的正文内容，足够长。\n\n第2章\n\n另一章的正文内容，足够长。\n"


def test_files(spark, tmp_path):
    chapters = spark.createDataFrame([("s", "k", 1, "第1章", "a\nb"), ("s", "k", 2, "第2章", ""), ("t", "q", 1, "x", "y")], "site string, cache_key string, number int, title string, content string")
    files.write_cache(chapters, str(tmp_path / "cache"))
    assert {(r.site, r.number): r.text for r in spark.read.parquet(str(tmp_path / "cache")).collect()} == {("s", 1): "第1章\n\na\nb\n", ("s", 2): "第2章\n", ("t", 1): "x\n\ny\n"}
    assert sorted(tuple(r) for r in files.read_cache_table(spark, str(tmp_path / "cache")).collect())[0] == ("s", "k", 1, "第1章\n\na\nb\n")
    files.write_plans(spark.createDataFrame([("c", "t"), ("d", "u")], "catalog_url string, title string"), spark.createDataFrame([("c", 2, "b", "y"), ("c", 1, "a", "x")], "catalog_url string, number int, title string, url string"), str(tmp_path / "plans"))
    assert [(r.catalog_url, r.number, r.url) for r in files.read_plans(spark, str(tmp_path / "plans")).where("number IS NOT NULL").orderBy("number").collect()] == [("c", 1, "x"), ("c", 2, "y")]
    files.write_books(chapters, ["site"], str(tmp_path / "books"))
    texts = {r.site: r.value for r in spark.read.text(str(tmp_path / "books"), wholetext=True).collect()}
    assert texts == {"s": "第1章\n\na\nb\n\n第2章\n", "t": "x\n\ny\n"}
    folder = tmp_path / "old" / "s" / "k" / "chapters"
    folder.mkdir(parents=True)
    (folder / "000012.txt").write_text("第12章\n\nz\n", encoding="utf-8")
    (folder / "note.txt").write_text("no", encoding="utf-8")
    assert [tuple(r) for r in files.read_cache(spark, str(tmp_path / "old")).collect()] == [("s", "k", 12, "第12章\n\nz\n")]
    (tmp_path / "plan.json").write_text('{"title": "t", "catalog_url": "c", "chapters": [{"number": 1, "title": "a", "url": "u"}]}')
    assert files.read_plans(spark, str(tmp_path / "plan.json")).first().url == "u"
    (tmp_path / "bad.json").write_text('{"title": ')
    assert files.read_plans(spark, str(tmp_path / "bad.json")).first().corrupt
    raw = spark.createDataFrame([("中文".encode("gb18030"), "gb18030"), ("é".encode(), None), (b"\xff", "utf-8"), (None, None)], "b binary, c string")
    assert [r[0] for r in raw.select(files.decoded(F.col("b"), F.col("c"))).collect()] == ["中文", "é", "�", None]


def test_streams(spark, tmp_path):
    page = '<a href="/a">第1章</a><a href="/b">第2章</a><a href="http://q.com/">x</a>'
    rows = spark.createDataFrame([("http://o.com/#1", page, "2024-01-01 00:00:00"), ("http://o.com/#2", page, "2024-01-01 00:01:00")], "url string, html string, captured string")
    rows.select("url", "html", F.to_timestamp("captured").alias("captured")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(capture.PAGE_SCHEMA).parquet(str(tmp_path / "in"))
    q = capture.link_stream(capture.first_captures(stream)).writeStream.format("memory").queryName("found_links").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.page, r.url, r.title) for r in spark.table("found_links").collect()} == {("http://o.com/", "http://o.com/a", "第1章"), ("http://o.com/", "http://o.com/b", "第2章")}
    q = stream.writeStream.foreachBatch(capture.catalog_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_captures_chosen_by_time(spark):
    old, new = captured(), [(f"{SITE}/1/2.html", chapter(2, "新的一章的正文内容，足够长。"))]
    pages = spark.createDataFrame([(u, h, 1) for u, h in old] + [(u, h, 2) for u, h in new] * 2, "url string, html string, captured int")
    inputs = spark.createDataFrame([(f"{SITE}/1.html",)], "book string")
    assert "新的一章" in books.books(pages, inputs).first().text


def tables(spark, pages, **more):
    inputs = spark.createDataFrame([(f"{SITE}/1.html",)], "book string")
    out = run.run(spark.createDataFrame(pages, "url string, html string"), inputs, **more)
    r = out["report"].first()
    return out, (r.total_chapters, r.failed_chapters, r.skipped_chapters, r.interrupted, r.exit_code)


def test_runs(spark):
    out, report = tables(spark, captured())
    assert report == (2, [3], 0, False, 2)
    have = {r.number: r.text for r in out["cache"].collect()}
    assert set(have) == {1, 2} and have[1].startswith("第1章\n\n第一页")
    # the next run reads the cache and the page that is there now
    later = [p for p in captured() if not p[0].endswith(("/1.html", "/1_2.html", "/2.html#top", "/3.html")) or p[0] == f"{SITE}/1.html"] + [(f"{SITE}/1/3.html", chapter(3, "终于抓到的正文内容，足够长。"))]
    assert tables(spark, later, kept=out["cache"])[1] == (3, [], 0, False, 0)
    assert tables(spark, later, kept=out["cache"], refresh=True)[1] == (3, [1, 2], 0, False, 2)
    assert tables(spark, captured(), first=2)[1] == (2, [], 1, False, 0)
    assert tables(spark, captured(), interrupted=True)[1] == (2, [3], 0, True, 2)


def test_runs_stop_early(spark):
    pages = captured()
    blocked = [(u, "<title>Just a moment...</title>" if u.endswith("/1/1.html") else h) for u, h in pages]
    assert tables(spark, blocked)[1] == (0, [1, 2, 3], 0, False, 1)
    gone = [p for p in pages if not p[0].endswith("/1/1.html")]
    assert tables(spark, gone, most_failures=1)[1] == (0, [1, 2, 3], 0, False, 1)
    assert tables(spark, gone, most_failures=2)[1] == (1, [1, 3], 0, False, 2)


def test_a_cache_follows_a_changed_catalog(spark):
    out, _ = tables(spark, captured())
    swapped = [(u, h.replace("/1/1.html'>第1章", "/1/X.html'>第1章").replace("/1/2.html'>第2章", "/1/1.html'>第2章").replace("/1/X.html", "/1/2.html") if u == f"{SITE}/1.html" else h) for u, h in captured()]
    again, report = tables(spark, swapped, kept=out["cache"], old=out["links"])
    assert report == (2, [3], 0, False, 2)
    assert {r.number: r.text[:3] for r in again["cache"].collect()} == {2: "第1章", 1: "第2章"}


def test_options():
    assert run.Options(url="http://x").delay == 1.0 and run.Options(query="a b", pick=2).pick == 2
    for bad in ({}, {"url": "u", "query": "q"}, {"url": "u", "pick": 1}, {"query": " "}, {"url": "u", "delay": -1}, {"url": "u", "timeout": 0}, {"url": "u", "first": 0}, {"url": "u", "retries": 1.5}, {"query": "q", "pick": 0}):
        with pytest.raises(ValueError):
            run.Options(**bad)
