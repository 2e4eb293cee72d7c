"""Sites that are added from outside the library."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import urls
from foliant.operators import dialects, search
from foliant.plans import books

BODY = "这是足够长的正文内容。"


class Fourth(dialects.Dialect):
    name, hosts = "fourth", ("fourth.example",)
    catalog, content = ("ol.toc a",), ("section.words",)
    search_form, response_encoding = "https://fourth.example/find", "utf-8"
    hits = dialects.Hits("p.hit", ("a[href]",), ("b",), ("i",))

    def matches(self, authority):
        return F.startswith(authority, F.lit("mirror-"))

    def normalize(self, url):
        return F.regexp_replace(url, "^http:", "https:")

    def site_title(self, title):
        return F.regexp_replace(title, " - fourth$", "")

    def catalog_label(self, label):
        return label == "up"

    def chapter_list(self, links, keys):
        return links.where("title NOT LIKE '%AD%'")

    def guess_path(self, parts):
        return F.nullif(F.regexp_extract(parts["path"], "^(/[^/]+/)[0-9]+$", 1), F.lit(""))

    def page_title(self, content):
        return F.nullif(F.regexp_extract(content, "(?m)^T: (.*)$", 1), F.lit(""))

    def clean(self, chapter):
        return F.struct(F.upper(chapter.clean_title).alias("title"), F.array_join(F.filter(chapter.lines, lambda x: ~F.startswith(x, F.lit("T: "))), "\n").alias("content"))

    def assemble(self, chapters, keys):
        return chapters.select(*keys, "number", F.concat(F.col("number").cast("string"), F.lit("/"), "title").alias("title"), "content")

    def next_page(self, linked, numbered, page):
        return F.when(F.contains(linked, F.lit("part=")), linked)

    def chapter_path(self, path):
        return F.regexp_replace(path, "/m$", "")


ROOT = "https://fourth.example"
PAGES = [
    (f"http://fourth.example/b/", "<title>Book - fourth</title><ol class=toc>" + "".join(f"<li><a href='/b/{i}/m'>第{i}章{' AD' * (i == 2)}</a></li>" for i in (1, 2, 3)) + "</ol>"),
    (f"{ROOT}/b/1", f"<section class=words><p>T: first</p>{BODY}<a href='/b/1?part=2'>下一页</a><a href='/b/'>up</a><a href='/x'>目录</a></section>"),
    (f"{ROOT}/b/1?part=2", f"<section class=words>{BODY}<a href='/b/3'>下一页</a></section>"),
    (f"{ROOT}/b/3", f"<section class=words><p>T: third</p>{BODY}</section>"),
]


def flow(spark, starts):
    pages, inputs = spark.createDataFrame(PAGES, "url string, html string"), spark.createDataFrame([(s,) for s in starts], "book string")
    return {r.book: r for r in books.books(pages, inputs).collect()}


def test_a_fourth_site_flows_through_the_plans(spark):
    starts = [f"{ROOT}/b/", f"{ROOT}/b/1"]
    with dialects.registered(Fourth()):
        out = flow(spark, starts)
    assert set(out) == set(starts)
    for r in out.values():
        assert (r.title, r.n_chapters, r.failed, r.catalog_url) == ("Book", 2, [], f"{ROOT}/b/")
        assert r.text == f"1/第1章\n\n{BODY}\n{BODY}\n\n2/第3章\n\n{BODY}\n" or r.text == f"1/第1章\n\n{BODY}\n{BODY}\n\n3/第3章\n\n{BODY}\n"
    assert [d.name for d in dialects.sites()] == ["trxs_cc", "23txxt", "bixiange"]
    with_none = flow(spark, starts)  # the generic rules know neither its list nor its chapters
    assert all(r.n_chapters == 0 for r in with_none.values())


def test_each_hook_of_a_fourth_site(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    four = F.lit("fourth")
    with dialects.registered(Fourth()):
        assert [one(dialects.adapter_of(F.lit(u))) for u in ("http://www.fourth.example/x", "http://mirror-2.net/", "http://x.trxs.cc/", "http://o.com/")] == ["fourth", "fourth", "trxs_cc", "generic"]
        assert one(dialects.normalize(F.lit("http://fourth.example/a#b"), four)) == "https://fourth.example/a"
        assert one(dialects.guess_catalog(F.lit(f"{ROOT}/b/12"), four)) == f"{ROOT}/b/" and one(dialects.guess_catalog(F.lit(f"{ROOT}/b/x"), four)) is None
        assert one(dialects.canonical_chapter(F.lit(f"{ROOT}/b/1/m"), four)) == f"{ROOT}/b/1"
        assert [r["adapter"] for r in dialects.search_requests("a b")] == ["trxs_cc", "bixiange", "fourth"]
        assert dialects.search_requests("a b")[2]["data"] == b"keyboard=a+b&show=title&classid=0" and dialects.search_requests("a")[2]["site_ord"] == 3
        pages = spark.createDataFrame([(3, "fourth", f"{ROOT}/find", "<p class=hit><a href='/b/'><b>Book</b></a><i>by me</i></p><p class=hit><a href='http://o.com/'><b>x</b></a></p>")], "site_ord int, adapter string, url string, html string")
        assert [tuple(r) for r in search.hits(pages).select("title", "url", "snippet").collect()] == [("Book", f"{ROOT}/b/", "by me")]
    assert one(dialects.adapter_of(F.lit("http://mirror-2.net/"))) == "generic"
    assert one(urls.normalize(F.lit("http://a/b#c"))) == "http://a/b"


def test_names_are_registered_once():
    with dialects.registered(Fourth()):
        with pytest.raises(ValueError):
            dialects.register(Fourth())
    with pytest.raises(ValueError):
        dialects.register(dialects.Dialect())


def test_only_dialects_with_an_answer_become_branches(spark):
    text = spark.range(1).select(dialects.site_title(F.lit("x"), F.col("id").cast("string")).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert "trxs_cc" in text and "bixiange" in text and "23txxt" not in text
