"""The supported sites: each one's addresses, selectors and search form, and where its pages differ from the common rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text, urls
from ..functions.fixed import java
from ..functions.urls import let
from . import assemble
from .dialects import Chapter, Dialect, Hits

EDGE = " ：:—-_"


def _from_first(lines: Column, pattern: str) -> Column:
    """The lines from the first one that fits the pattern, or all of them."""
    at = lambda x: F.array_position(F.transform(x, lambda y: y.rlike(pattern)), F.lit(True)).cast("int")
    return let(lines, lambda x: let(at(x), lambda i: F.when(i > 0, F.slice(x, F.greatest(i, F.lit(1)), F.size(x))).otherwise(x)))


def _heading(lines: Column, pattern: str) -> Column:
    """Place (1 or 2) of a heading in the first two lines, or 0."""
    return F.array_position(F.transform(F.slice(lines, 1, 2), lambda x: x.rlike(pattern)), F.lit(True)).cast("int")


def _after_book(title: Column, book: Column) -> Column:
    return F.btrim(F.substring(title, F.length(book) + 1, F.length(title)), F.lit(EDGE))


def _cleaned(title: Column, lines: Column) -> Column:
    return F.struct(title.alias("title"), F.array_join(lines, "\n").alias("content"))


class TrxsCc(Dialect):
    # Hosts, selectors and search form.
    name, hosts = "trxs_cc", ("trxs.cc",)
    catalog = ("#list dl dd a", ".listmain dl dd a", ".book_list ul li a", "#chapterList li a", ".volume-wrap ul li a", "#all_chapter a", ".section-box .section-list li a", "#list ul li a")
    content = (".read_chapterDetail", "#readContent_set", "div.readDetail", ".read-content", "#chaptercontent")
    search_form, response_encoding = "https://www.trxs.cc/e/search/index.php", "gb2312"
    hits = Hits("div.bk", ("h3 a[href]", "a[href]"), ("h3",), (".booknews, p",))

    def site_title(self, title: Column) -> Column:
        return text.strip(F.regexp_replace(title, java(fixed.TITLE_NOTE_SUFFIX), ""))

    def guess_path(self, parts: Column) -> Column:
        book = F.nullif(F.regexp_extract(parts["path"], fixed.TONGREN_PATH, 1), F.lit(""))
        return F.concat(F.lit("/tongren/"), F.regexp_replace(book, fixed.HTML_TAIL, ""), F.lit(".html"))

    def clean(self, chapter: Chapter) -> Column:
        """Lines that repeat book and chapter go, as do labels; a heading in the first two lines becomes the title, and the first chapter starts at its heading."""
        pattern, book = java(fixed.NUMBERED_HEADING), chapter.book

        def repeated(x: Column) -> Column:
            bare = F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+", "")
            return F.startswith(bare, book) & F.substring(bare, F.length(book) + 1, F.length(bare)).rlike(pattern)

        own = F.filter(chapter.lines, lambda x: ~repeated(x) & ~x.isin(fixed.BODY_LABELS))
        bare_title = F.when(F.startswith(chapter.clean_title, book), _after_book(chapter.clean_title, book)).otherwise(chapter.clean_title)

        def parted(lines: Column, at: Column) -> Column:
            title = F.when(at > 0, F.get(lines, at - 1)).otherwise(bare_title)
            title = F.when((title == "") | (title == book), text.numbered(chapter.number)).otherwise(title)
            return _cleaned(title, F.when(at > 0, F.filter(lines, lambda x, i: i != at - 1)).otherwise(lines))

        kept = F.when(chapter.first, _from_first(own, pattern)).otherwise(own)
        return let(kept, lambda lines: let(_heading(lines, pattern), lambda at: parted(lines, at)))


class Txxt(Dialect):
    # Host and selectors.
    name, hosts = "23txxt", ("23txxt.com",)
    catalog = ("#list dl dd a", ".listmain dl dd a", ".book_list ul li a", "#chapterList li a", "#all_chapter a", "#catalog a", "#chapterlist a", ".booklist a")
    content = ("#content", ".read_chapterDetail", ".readContent", ".content", ".showtxt", ".novel_content", ".box_box")

    def chapter_list(self, links: DataFrame, keys: list[str]) -> DataFrame:
        return numbered_catalog(links, keys)

    def guess_path(self, parts: Column) -> Column:
        return F.concat(F.lit("/bqg/"), F.nullif(F.regexp_extract(parts["path"], fixed.BQG_PATH, 1), F.lit("")), F.lit("/"))

    def chapter_path(self, path: Column) -> Column:
        return F.regexp_replace(path, fixed.PAGE_OF_CHAPTER, "")

    def _chapter(self, url: Column) -> Column:
        return let(urls.parts(url), lambda p: let(self.chapter_path(p["path"]), lambda x: urls.build(p["scheme"], p["authority"], x, p["query"])))

    def next_page(self, linked: Column, numbered: Column, page: Column) -> Column:
        """A link to another page of the same chapter; the site labels the next chapter in the same way."""
        same = (urls.normalize(linked) != urls.normalize(page)) & (self._chapter(linked) == self._chapter(page))
        return F.when(F.coalesce(same, F.lit(False)), linked).otherwise(numbered)

    def page_title(self, content: Column) -> Column:
        heading = F.get(F.filter(F.split(content, "\n"), lambda x: x.rlike(java(fixed.PAGE_HEADING))), F.lit(0))
        return F.nullif(text.clean_lines(F.regexp_extract(heading, java(fixed.PAGE_HEADING), 1)), F.lit(""))

    def clean(self, chapter: Chapter) -> Column:
        """The first page heading becomes the title; page headings and notices of continuation go."""
        page, notice = java(fixed.PAGE_HEADING), java(fixed.CONTINUATION_NOTICE)
        heading = F.get(F.filter(chapter.lines, lambda x: x.rlike(page)), F.lit(0))
        own = F.nullif(text.clean_lines(F.regexp_extract(heading, page, 1)), F.lit(""))
        given = F.nullif(F.when(chapter.clean_title == fixed.SITE_TITLE, text.numbered(chapter.number)).otherwise(chapter.clean_title), F.lit(""))
        return _cleaned(F.coalesce(own, given, text.numbered(chapter.number)), F.filter(chapter.lines, lambda x: ~x.rlike(page) & ~x.rlike(notice)))


class Bixiange(Dialect):
    # Hosts, selectors and search form.
    name, hosts = "bixiange", ("bixiange.top", "bxg123.top", "bixiange.me")
    catalog, content = (".catalog a",), ("#mycontent",)
    search_form, response_encoding = "https://www.bixiange.top/e/search/indexpage.php", "gb18030"
    hits = Hits(".list li", (".info .title a[href]", ".cover a[href]", "a[href]"), (".info .title a[href]",), (".descript, .tips",))

    def site_title(self, title: Column) -> Column:
        return text.strip(F.regexp_replace(title, java(fixed.TITLE_RANGE_SUFFIX), ""))

    def guess_path(self, parts: Column) -> Column:
        trimmed, shape = F.regexp_replace(parts["path"], "/+$", ""), fixed.SECTION_PATH
        return F.when(trimmed.rlike(shape), F.concat(F.lit("/"), F.regexp_extract(trimmed, shape, 1), F.lit("/"), F.regexp_extract(trimmed, shape, 2), F.lit("/")))

    def clean(self, chapter: Chapter) -> Column:
        """Section labels and advertising go; the first chapter starts at its heading, which becomes its title."""
        section, pollution, start = java(fixed.SECTION_HEADING), java(fixed.POLLUTION_LINE), java(fixed.CHAPTER_HEADING)
        own, book = F.filter(chapter.lines, lambda x: ~x.rlike(section) & ~x.rlike(pollution)), text.clean_lines(chapter.book)
        given = F.when((book != "") & F.startswith(chapter.clean_title, book), _after_book(chapter.clean_title, book)).otherwise(chapter.clean_title)

        def parted(lines: Column, at: Column) -> Column:
            title = F.when(at > 0, F.get(lines, at - 1)).otherwise(given)
            return _cleaned(F.coalesce(F.nullif(title, F.lit("")), text.numbered(chapter.number, "节")), F.when(at > 0, F.filter(lines, lambda x, i: i != at - 1)).otherwise(lines))

        kept = F.when(chapter.first, _from_first(own, start)).otherwise(own)
        return let(kept, lambda lines: let(F.when(chapter.first, _heading(lines, start)).otherwise(0), lambda at: parted(lines, at)))

    def assemble(self, chapters: DataFrame, keys: list[str]) -> DataFrame:
        """Parts that are mere sections, re-cut at real headings. A first part titled by a section label has no title of its own."""
        section = F.col("title").rlike(java(fixed.SECTION_HEADING)) | (F.col("title") == "")
        first = chapters.groupBy(*keys).agg(F.min_by(F.struct(F.when(~section, F.col("title")).alias("t")), "number").alias("f")).select(*keys, F.col("f.t").alias("first_title"))
        return assemble.sessions(assemble.chapter_lines(chapters, keys), keys, first, ["number", "line_pos"])


def numbered_catalog(links: DataFrame, keys: list[str]) -> DataFrame:
    """A catalog by the numbers in its titles: the first link of each number (those with a full chapter number before those with a bare leading
    one, `开始阅读` as number 1 if there is no other), then extras in page order; the rest is dropped."""
    number = text.chapter_number(F.col("title"))
    bare = F.when(number <= 0, text.leading_number(F.col("title")))
    phased = links.withColumn("_full", F.when(number > 0, number)).withColumn("_bare", bare).withColumn("_start", text.strip(F.col("title")) == fixed.START_LABEL)
    rows = phased.select(*keys, "adapter", "title", "url", F.col("number").alias("ord"), F.coalesce("_full", "_bare").alias("n"), F.when(F.col("_full").isNotNull(), 0).otherwise(1).alias("phase"), "_start")
    given = rows.where("n IS NOT NULL")
    first = Window.partitionBy(*keys).orderBy("ord")
    starts = rows.where("_start").withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k").withColumn("n", F.lit(1)).withColumn("phase", F.lit(2)).withColumn("ord", F.lit(-1))
    best = Window.partitionBy(*keys, "n").orderBy("phase", "ord")
    numbered = given.unionByName(starts).withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
    # A bare number that is taken already may still be an extra.
    taken = numbered.select(*keys, "ord", F.lit(True).alias("_taken"))
    bare_rows = rows.where("n IS NULL OR phase = 1").join(taken, [*keys, "ord"], "left").where("_taken IS NULL").drop("_taken")
    special = bare_rows.where(~F.col("_start") & text.is_extra_title(F.col("title")))
    both = numbered.select(*keys, "adapter", "title", "url", F.lit(0).alias("late"), "n", "ord").unionByName(special.select(*keys, "adapter", "title", "url", F.lit(1).alias("late"), F.lit(0).alias("n"), "ord"))
    order = Window.partitionBy(*keys).orderBy("late", "n", "ord")
    return both.withColumn("number", F.row_number().over(order)).select(*keys, "adapter", "number", "title", "url")


BUILT_IN = (TrxsCc(), Txxt(), Bixiange())
