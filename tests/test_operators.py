"""Site cases: parsing, ordering, clean-up, assembly, caches, reports."""

import random
import statistics
from urllib.parse import parse_qs

import pytest
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.operators import assemble, cache, chapters, dialects, dom, links, ranks, report, search
from foliant.operators.sanitize import sanitize


def nodes_of(spark, url, html, groups):
    return dom.select(dialects.dispatch(spark.createDataFrame([(url, html)], "url string, html string")), groups)


def catalog(spark, url, html):
    nodes = nodes_of(spark, url, html, links.catalog_groups()).withColumn("page", F.col("url"))
    return [(r.number, r.title, r.url) for r in sorted(links.catalog_links(nodes, ["page"]).collect(), key=lambda r: r.number)]


TXXT = "http://www.23txxt.com/bqg/111084/"


def test_numbered_catalog(spark):
    titles = [("850", "850.最后"), ("8", "8.第八章"), ("8-note", "8点更"), ("2", "2.第二章"), ("42988487", "开始阅读"), ("242", "242通用语MAX"), ("extra", "番外·后记"), ("999999", "请假条"), ("999998", "月票番外说明")]
    html = '<div id="list">' + "".join(f'<a href="/bqg/111084/{a}.html">{t}</a>' for a, t in titles) + "</div>"
    assert [t for _, t, _ in catalog(spark, TXXT, html)] == ["开始阅读", "2.第二章", "8.第八章", "242通用语MAX", "850.最后", "番外·后记"]


def test_catalogs(spark):
    html = '<div class="desc"><h1>示例小说(1-3)</h1></div><div class="catalog">' + "".join(f'<a href="/xhqh/12345/index/{i}.html">第{i}节</a>' for i in (1, 2, 3)) + "</div>"
    url = "https://www.bixiange.top/xhqh/12345/"
    assert [n for n, _, _ in catalog(spark, url, html)] == [1, 2, 3]
    nodes = nodes_of(spark, url, html, {"title": fixed.TITLE_SELECTORS})
    pages = dialects.dispatch(spark.createDataFrame([(url, html)], "url string, html string"))
    assert links.with_title(pages, links.book_titles(nodes, ["url"]), ["url"]).first().title == "示例小说"
    down = "".join(f'<a href="/b/x/{i}.html">第{i}章</a><a href="/b/x/{i}.html">again</a>' for i in (5, 4, 3, 2))
    assert [t for _, t, _ in catalog(spark, "http://o.com/b/", down)] == ["第2章", "第3章", "第4章", "第5章"]
    assert catalog(spark, "http://o.com/b/", '<a href="/1.html">第1章</a><a href="http://q.com/2">第2章</a><a href="/m">目录</a>') == []


def test_site_title_suffix(spark):
    url = "https://www.trxs.cc/tongren/11699.html"
    for html, want in (("<title>示例小说(示例作者)_同人小说网</title>", "示例小说"), ("<p>x</p>", "11699.html"), ("<title>x</title><h1>书名 第3章 再会</h1>", "书名")):
        pages = dialects.dispatch(spark.createDataFrame([(url, html)], "url string, html string"))
        titles = links.book_titles(dom.select(pages, {"title": fixed.TITLE_SELECTORS}), ["url"])
        assert links.with_title(pages, titles, ["url"]).first().title == want


@pytest.mark.parametrize(
    "url,html,want",
    [
        (TXXT + "44601734.html", '<a href="/bqg/111084/44601734_3.html">3</a><a href="/bqg/111084/44601734_2.html">2</a>', TXXT + "44601734_2.html"),
        (TXXT + "44601734_2.html", '<a href="/bqg/111084/44601735.html">下一页</a>', None),
        (TXXT + "44601734_2.html", '<a href="44601734_3.html">下一页</a>', TXXT + "44601734_3.html"),
        ("https://www.trxs.cc/tongren/1/147.html", '<a href="147_2.html">下一页</a><a href="x.html">继续阅读</a>', "https://www.trxs.cc/tongren/1/147_2.html"),
        ("https://www.trxs.cc/tongren/1/147.html", '<a href="147_2.html">下一页，请点击这里继续阅读全文</a>', None),
    ],
)
def test_next_page(spark, url, html, want):
    nodes = nodes_of(spark, url, html, {"links": ["a[href]"]}).withColumn("page", F.col("url"))
    assert links.neighbours(nodes, ["page"]).first().next_link == want


def test_content_choice(spark):
    long, url = "正文内容" * 30, "http://o.com/1"
    cases = [
        (f"<div class='content'><p>{long}</p><script>x</script><a href='/n'>下一页</a><noscript>n</noscript></div><h2>标题</h2>", ("标题", long, "ok")),
        ("<div class='content'>太短</div>", (None, None, "extract_error")),
        (f"<div id='textbox'>{'<a href=q>l</a>' * 50}</div><div id='mytext'>{long}</div>", (None, long, "ok")),
        ("<div class='content'>0123456789 <a href='x'>正文</a></div>", (None, "0123456789", "ok")),
        (f"<div class='content'>{'a' * 20}<div class='showtxt'>{'b' * 3000}</div></div>", (None, "a" * 20 + "\n" + "b" * 3000, "ok")),
    ]
    for html, want in cases:
        pages = dialects.dispatch(spark.createDataFrame([(url, html)], "url string, html string"))
        r = chapters.contents(dom.select(pages, chapters.content_groups(), best=chapters.content_scores()), pages, ["url"]).first()
        assert (r.title, r.content, r.status) == want


def test_tolerant_trees():
    tree = dom.Tree("<p>a<b>c<p>d</b>e</i><br/>f<img src=x>g<!-- h --><script>i</script>&amp;<div ID=q CLASS='x y' class='z w'>j")
    texts = {n.tag: list(n.strings()) for n in tree.nodes}
    assert texts["b"] == ["c", "d"] and list(tree.root.strings()) == ["a", "c", "d", "e", "f", "g", "&", "j"]
    div = tree.nodes[-1]
    assert dom.matches(div, "p #q.w") and dom.matches(div, "b, [class*='z w']") and not dom.matches(div, ".x") and not dom.matches(div, "b div") and dom.matches(div, "[id='q']")


def test_selectors():
    node = dom.Tree("<ul id='l'><li class='a b' title='x, y'>z</li></ul>").nodes[-1]
    for good in ("[title='x, y']", 'ul > li'.replace(" >", ""), "ul li.a.b", "#l [title]", "p, li[class*='a b']", 'li[title="x, y"]', "li[class*=b]", "b ,li"):
        assert dom.matches(node, good), good
    for bad in ("li[", "ul > li", "", "li,", "[title='x]", "li:first"):
        with pytest.raises(ValueError, match="selector"):
            dom.compiled(bad)


def test_numbers_by_ranges(spark):
    rows = [(k, p, t) for k in (None, "a", "b") for p in (*range(-7, 30, 3), 500, 500, 9000) for t in (1, 2)]
    df = spark.createDataFrame(rows, "k string, p int, t int")
    got = sorted(((r.k or "", r.n, r.p, r.t) for r in ranks.numbered(df, ["k"], ["p", "t"], "n", 8).collect()))
    assert got == sorted((k or "", n, p, t) for k in (None, "a", "b") for n, (_, p, t) in enumerate(sorted(r for r in rows if r[0] == k), 1))
    assert [r.n for r in ranks.numbered(df, [], ["p", "t"], "n", 8).orderBy("n").collect()] == list(range(1, len(rows) + 1))


def test_a_stop_far_behind(spark):
    df = spark.createDataFrame([("b", 1, "error"), ("b", 2_000_000_000, "blocked"), ("b", 2_000_000_001, "ok"), ("c", 2_000_000_000, "ok")], "book string, idx long, st string")
    assert sorted(tuple(r) for r in report.breaker(df, ["book"], 2).collect()) == [("b", 1), ("b", 2_000_000_000), ("b", 2_000_000_001)]


def test_hosts_by_suffix(spark):
    urls_ = ["https://www.trxs.cc/x", "http://TRXS.cc", "http://xtrxs.cc/", "http://a.b.bixiange.me:80/", "http://bixiange.me/", "x", None]
    df = dialects.dispatch(spark.createDataFrame([(u,) for u in urls_], "url string"))
    assert [r.adapter for r in df.collect()] == ["trxs_cc", "trxs_cc", "generic", "generic", "bixiange", "generic", "generic"]
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def cleaned(spark, adapter, book, number, title, content):
    df = spark.createDataFrame([(adapter, book, number, title, content)], "adapter string, book_title string, number int, title string, content string")
    once = sanitize(df)
    twice = sanitize(once)
    assert tuple(once.first()) == tuple(twice.first())
    return once.first().title, once.first().content


def test_clean_up(spark):
    book = "示例小说"
    raw = f"{book} 第1章\n作者：示例作者\n简介：示例简介\n正文卷\n第1章 示例章节标题\n真正正文。"
    assert cleaned(spark, "trxs_cc", book, 1, f"{book} 第1章", raw) == ("第1章 示例章节标题", "真正正文。")
    assert cleaned(spark, "trxs_cc", book, 3, book, "正文段落") == ("第3章", "正文段落")
    pages = "1.示例章节 (第1/2页)\n第一页正文。\n（本章未完，请点击下一页继续阅读）\n1.示例章节 (第2/2页)\n第二页正文。"
    assert cleaned(spark, "23txxt", "示例作品", 1, "示例作品", pages) == ("1.示例章节", "第一页正文。\n第二页正文。")
    assert cleaned(spark, "23txxt", "x", 4, "二三书库", "a") == ("第4章", "a")
    assert cleaned(spark, "bixiange", book, 2, "第2节", "第2节\n正文第一段。\n?9提供最快\n正文第二段。") == ("第2节", "正文第一段。\n正文第二段。")
    assert cleaned(spark, "bixiange", book, 1, f"{book} 第1节", f"{book}\n作者：示例作者\n第一章 示例章节\n第一段正文。") == ("第一章 示例章节", "第一段正文。")
    assert cleaned(spark, "bixiange", book, 2, "第2节", "第一段。\n第二章 继续\n第二段。") == ("第2节", "第一段。\n第二章 继续\n第二段。")
    assert cleaned(spark, "generic", book, 2, " t ", " a\n\nb ") == (" t ", " a\n\nb ")


def test_assembly(spark):
    rows = [("b", "bixiange", 1, "第一章 起", "第一段。"), ("b", "bixiange", 2, "第2节", "续。\n第二章 承\n第二段。"), ("b", "bixiange", 3, "第3节", "再续。\n第三章 转"), ("c", "bixiange", 1, "第1节", "前文。\n第一章 x\n正文。"), ("d", "bixiange", 1, "第1节", "没有标题"), ("e", "generic", 1, "t", "c")]
    df = spark.createDataFrame(rows, "book string, adapter string, number int, title string, content string")
    got = sorted(tuple(r) for r in assemble.assemble(df, ["book"]).collect())
    assert got == [("b", 1, "第一章 起", "第一段。\n续。"), ("b", 2, "第二章 承", "第二段。\n再续。"), ("b", 3, "第三章 转", ""), ("c", 1, "第一章 x", "前文。\n正文。"), ("e", 1, "t", "c")]
    text = {r.book: r.text for r in assemble.joined(assemble.assemble(df, ["book"]), ["book"]).collect()}
    assert text["b"] == "第一章 起\n\n第一段。\n续。\n\n第二章 承\n\n第二段。\n再续。\n\n第三章 转\n"


def test_assembly_against_a_loop(spark):
    rng, rows, want = random.Random(5), [], []
    for b in range(60):
        first = None if rng.random() < 0.4 else "T"
        title, lines, out = first, [], []
        for c in range(rng.randrange(1, 4)):
            for p in range(rng.randrange(5)):
                head, line = rng.random() < 0.3, f"{'H' if rng.random() < 2 else ''}{c}.{p}"
                rows.append((b, c, p, head, line, first))
                if head:
                    if title:
                        out.append((title, "\n".join(lines)))
                        lines = []
                    title = line
                else:
                    lines.append(line)
        if title:
            out.append((title, "\n".join(lines)))
        want += [(b, i, *x) for i, x in enumerate(out, 1)]
        rows.append((b, None, None, None, None, first))
    df = spark.createDataFrame(rows, "book int, number int, line_pos int, is_heading boolean, line string, first_title string")
    titles = df.where("number IS NULL").select("book", "first_title")
    got = assemble.sessions(df.where("number IS NOT NULL").drop("first_title"), ["book"], titles, ["number", "line_pos"])
    assert sorted(tuple(r) for r in got.collect()) == want


def test_search(spark):
    trxs = '<div class="bk"><h3><a href="/tongren/11699.html">示例小说</a></h3><div class="booknews">作者：示例作者</div><p>简介。</p></div><div class="bk"><h3><a href="https://example.com/book">不支持的站点</a></h3></div><div class="bk"><h3> </h3><a href="/tongren/12098.html"></a></div><div class="books"><div class="bk"><a href="/tongren/12098.html"><div class="infos"><h3>示例小说 (1-10)</h3><div class="booknews">作者：示例作者 <label class="date">2026-01-01</label></div><p>摘要。</p></div></a></div></div>'
    bix = '<div class="list"><ul><li><div class="cover"><a href="/xhqh/12345"><img alt="示例小说"></a></div><div class="info"><div class="title"><strong><a href="/xhqh/12345">示例小说</a></strong></div><div class="descript"><a href="/xhqh/12345">这是测试简介。</a></div></div></li></ul></div>'
    pages = spark.createDataFrame([(0, "trxs_cc", "https://www.trxs.cc/e/search/index.php", trxs), (2, "bixiange", "https://www.bixiange.top/e/search/result/", bix), (1, "23txxt", "http://www.23txxt.com/s", bix)], "site_ord int, adapter string, url string, html string")
    found = search.hits(pages)
    rows = {(r.site_ord, r.rn): (r.title, r.url, r.snippet) for r in found.collect()}
    assert rows == {
        (0, 1): ("示例小说", "https://www.trxs.cc/tongren/11699.html", "作者：示例作者"),
        (0, 2): ("示例小说 (1-10)", "https://www.trxs.cc/tongren/12098.html", "作者：示例作者 2026-01-01"),
        (2, 1): ("示例小说", "https://www.bixiange.top/xhqh/12345", "这是测试简介。"),
    }
    merged = search.interleave(search.results(found), 10).orderBy("place").collect()
    assert [(r.place, r.site) for r in merged] == [(1, "trxs.cc"), (2, "bixiange.top"), (3, "trxs.cc")]
    assert search.hits(pages, 1).count() == 2
    with pytest.raises(ValueError):
        search.hits(pages, 0)
    assert search.title_filter(found, "示例小说，(1-10)").count() == 1 and search.title_filter(found, "示例").count() == 0


def test_search_requests():
    trxs, bix = dialects.search_requests("示例  小说")
    assert (trxs["adapter"], bix["adapter"], trxs["site_ord"], bix["site_ord"]) == ("trxs_cc", "bixiange", 0, 2)
    for r, coding in ((trxs, "gb2312"), (bix, "gb18030")):
        form = parse_qs(r["data"].decode("ascii"), encoding="gb2312")
        assert (r["method"], r["response_encoding"], form) == ("POST", coding, {"keyboard": ["示例 小说"], "show": ["title"], "classid": ["0"]})
    assert "keyboard=%CA%BE" in dialects.search_url("示例")
    with pytest.raises(UnicodeEncodeError):
        dialects.search_requests("😀")
    with pytest.raises(ValueError):
        dialects.search_requests(" \n")


def test_a_search_with_a_blocked_site(spark):
    card = "<div class='bk'><h3><a href='/tongren/%d.html'>示例小说%s</a></h3><p>%s</p></div>"
    good = card % (1, "续篇 (1-10)", "摘要") + card % (2, "", "") + card % (3, "，续篇", "")
    responses = spark.createDataFrame([(0, good), (2, "<title>Just a moment...</title>")], "site_ord int, html string")
    asked = search.requests(spark, "示例小说，续篇")
    assert [(r.site_ord, r.adapter, r.filtered) for r in asked.orderBy("site_ord").collect()] == [(0, "trxs_cc", True), (2, "bixiange", True)]
    came = search.outcomes(asked, responses)
    assert {r.adapter: r.status for r in came.collect()} == {"trxs_cc": "ok", "bixiange": "blocked"}
    found = search.found_on_sites(came, "示例小说，续篇")
    assert [(r.place, r.title, r.site) for r in found.orderBy("place").collect()] == [(1, "示例小说续篇 (1-10)", "trxs.cc"), (2, "示例小说，续篇", "trxs.cc")]
    assert search.pick(found, 2).first().url == "https://www.trxs.cc/tongren/3.html"
    for wrong in (0, 3):
        with pytest.raises(LookupError, match="1 to 2"):
            search.pick(found, wrong)
    entries = [r.entry for r in search.listing(found).orderBy("place").collect()]
    assert entries == ["站内搜索结果（已查询并限定在 trxs.cc）", "[1] 示例小说续篇 (1-10)\n    站点：trxs.cc\n    链接：https://www.trxs.cc/tongren/1.html\n    摘要：摘要", "[2] 示例小说，续篇\n    站点：trxs.cc\n    链接：https://www.trxs.cc/tongren/3.html"]
    plain = search.found_on_sites(search.outcomes(search.requests(spark, "示例小说"), responses.where("site_ord = 0")), "示例小说")
    assert plain.count() == 3
    for query, limit in ((" ", 10), ("x", 0), ("x", 101)):
        with pytest.raises(ValueError):
            search.requests(spark, query, limit)


def merge_loop(lists, limit):
    out, seen, i = [], set(), 0
    while len(out) < limit:
        new = False
        for some in lists:
            if i < len(some) and some[i] not in seen and len(out) < limit:
                seen.add(some[i])
                out.append(some[i])
                new = True
        i += 1
        if not new:
            return out
    return out


def test_interleave_has_no_last_turn(spark):
    df = spark.createDataFrame([(0, 1, "a"), (0, 1_500_000, "b")], "site_ord int, rn int, url string")
    assert [(r.place, r.url) for r in search.interleave(df).orderBy("place").collect()] == [(1, "a"), (2, "b")]


def test_interleave_against_a_loop(spark):
    rng, rows, want = random.Random(3), [], []
    for b in range(80):
        lists = [[f"u{rng.randrange(8)}" for _ in range(rng.randrange(6))] for _ in range(rng.randrange(1, 4))]
        rows += [(b, s, n, u) for s, some in enumerate(lists) for n, u in enumerate(some, 1)]
        want += [(b, n, u) for n, u in enumerate(merge_loop(lists, 5), 1)]
    df = spark.createDataFrame(rows, "book int, site_ord int, rn int, url string")
    assert sorted(tuple(r) for r in search.interleave(df, 5, ("book",)).select("book", "place", "url").collect()) == want


def test_orientation_against_a_loop(spark):
    rng, rows, want = random.Random(8), [], []
    for b in range(80):
        links_ = [(f"u{rng.randrange(9)}", rng.choice(["", "第{}章", "第{}章", "x"]).format(rng.randrange(6))) for _ in range(rng.randrange(1, 8))]
        rows += [(b, i, u, t) for i, (u, t) in enumerate(links_)]
        one = list({u: (u, t) for u, t in reversed(links_)}.values())
        one.sort(key=lambda x: [u for u, _ in links_].index(x[0]))
        known = [int(t[1:-1]) for _, t in one if t.startswith("第") and int(t[1:-1]) > 0]
        steps = [y - x for x, y in zip(known, known[1:], strict=False) if x != y]
        if len(known) >= 3 and steps and statistics.median(steps) < 0:
            one.reverse()
        want += [(b, n, u, t or f"第{n}章") for n, (u, t) in enumerate(one, 1)]
    df = spark.createDataFrame(rows, "book int, pos int, url string, title string")
    got = links.orient(links.dedupe(df, ["book"]), ["book"]).select("book", "number", "url", "title")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_cache(spark):
    old = spark.createDataFrame([("b", i, f"u{i}") for i in (1, 2, 3)] + [("s", 1, "v1"), ("n", 1, "w")], "book string, number int, url string")
    new = spark.createDataFrame([("b", 1, "u1"), ("b", 2, "u3"), ("b", 3, "u2"), ("b", 4, "u4"), ("s", 1, "v1"), ("s", 2, "v2"), ("n", 2, "w")], "book string, number int, url string")
    have = spark.createDataFrame([("b", i, f"t{i}\n\nc{i}\n") for i in (1, 2, 3)] + [("s", 1, "only"), ("n", 1, " \n ")], "book string, number int, text string")
    assert {r.book: r.changed for r in cache.mapping_changed(old, new, ["book"]).collect()} == {"b": True, "s": False, "n": True}
    moved = cache.realign(old, new, have, ["book"])
    assert {(r.book, r.number): (r.text, r.migrated) for r in moved.where("book <> 'n'").collect()} == {("b", 1): ("t1\n\nc1\n", True), ("b", 2): ("t3\n\nc3\n", True), ("b", 3): ("t2\n\nc2\n", True), ("s", 1): ("only", False)}
    assert {(r.book, r.number): (r.title, r.content) for r in cache.read_blocks(have, ["book"]).where("number = 1").collect()} == {("b", 1): ("t1", "c1"), ("s", 1): ("第1章", "only")}
    todo = lambda **k: sorted((r.book, r.number) for r in cache.worklist(new, moved, ["book"], **k).collect())
    assert todo() == [("b", 4), ("n", 2), ("s", 2)] and len(todo(refresh=True)) == 7 and todo(first=2) == [("n", 2), ("s", 2)]
    got = cache.collate(new, moved, ["book"], spark.createDataFrame([("s", 1)], "book string, number int"))
    assert {(r.book, r.number) for r in got.where("failed").collect()} == {("b", 4), ("n", 2), ("s", 1), ("s", 2)}
    assert cache.collate(new, moved, ["book"], interrupted=True).where("failed").count() == 0
    report_ = report.run_report(got, assemble.assemble(got.where("content IS NOT NULL").select("book", F.lit("x").alias("adapter"), "number", F.col("cached_title").alias("title"), "content"), ["book"]), cache.first_chapters(new, ["book"], 3), ["book"])
    assert {r.book: (r.total_chapters, r.failed_chapters, r.skipped_chapters, r.exit_code) for r in report_.collect()} == {"b": (3, [4], 1, 2), "n": (0, [2], 0, 1), "s": (1, [1, 2], 0, 2)}


def test_ranges(spark):
    df = spark.createDataFrame([("a", n) for n in (11, 2, 3, 4, 8, 10, 10)] + [("b", 5)], "k string, number int")
    assert {r.k: r.ranges for r in report.number_ranges(df, ["k"]).collect()} == {"a": "2–4, 8, 10–11", "b": "5"}


def test_breaker_against_a_loop(spark):
    rng, rows = random.Random(6), []
    for b in range(100):
        rows += [(b, i, rng.choice(["ok", "error", "error", "cache", "blocked" if rng.random() < 0.2 else "ok"])) for i in range(1, rng.randrange(2, 12))]
    df = spark.createDataFrame(rows, "book int, idx int, st string")
    for refresh in (False, True):
        want, stopped, streak = [], set(), {}
        for b, i, st in rows:
            if b in stopped:
                if refresh or st != "cache":
                    want.append((b, i))
                continue
            streak[b] = 0 if st == "ok" else streak.get(b, 0) + (st == "error")
            if st in ("error", "blocked"):
                want.append((b, i))
            if st == "blocked" or st == "error" and streak[b] >= 2:
                stopped.add(b)
        assert sorted(tuple(r) for r in report.breaker(df, ["book"], 2, refresh).collect()) == want


def test_chains(spark):
    starts = spark.createDataFrame([("a", "1"), ("l", "x"), ("m", "gone"), ("z", "7"), ("n", "n1")], "key string, url string")
    edges = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", None), ("x", "y"), ("y", "x"), ("7", "8"), ("8", "9"), ("9", "10"), ("10", None), ("n1", "n2")], "url string, next_url string")
    got = {}
    for r in sorted(chapters.follow(starts, edges, 3).collect(), key=lambda r: (r.key, r.step)):
        got.setdefault(r.key, []).append((r.url, r.status))
    assert got == {"a": [("1", "ok"), ("2", "ok"), ("3", "ok")], "l": [("x", "ok"), ("y", "ok"), ("x", "loop")], "m": [("gone", "missing")], "z": [("7", "ok"), ("8", "ok"), ("9", "too_many_pages")], "n": [("n1", "ok"), ("n2", "missing")]}
