"""Search hits: parsing of result pages, title filter, and the merge of several sites' lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..session import written
from . import dialects, dom, ranks

DEFAULT_LIMIT, MAX_LIMIT = 10, 100

# Lines of a listing.
LISTING_HEAD = "站内搜索结果（已查询并限定在 %s）"
LISTING_TITLE = "[%d] %s"
LISTING_SITE = "    站点：%s"
LISTING_URL = "    链接：%s"
LISTING_SNIPPET = "    摘要：%s"


def hits(pages: DataFrame, limit: int = DEFAULT_LIMIT, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, site_ord, adapter, rn, title, url, snippet) from result pages (*by, site_ord, adapter, url, html): of each card the first link of the first rule that
    finds one. Foreign hosts, repeated links and blank titles are dropped; at most `limit` of each page. A site without rules gives none. `by` tells searches apart, of which there may be any
    number: each has a page of a site at most, or several, told apart and ordered by a whole number `page`, if there is that column; `limit` is for all pages of a site together."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be from 1 to {MAX_LIMIT}")
    groups, scopes = {}, {}
    for d in dialects.sites():
        for kind, some in (("link", d.hits.links), ("title", d.hits.titles), ("snippet", d.hits.snippets)) if d.hits else ():
            groups[f"{kind}:{d.name}"], scopes[f"{kind}:{d.name}"] = list(some), d.hits.card
    paged = ["page"] if "page" in pages.columns else []
    keys = [*by, "site_ord", "adapter", "url", *paged]
    nodes = dom.select(pages.select(*keys, "html"), groups, scopes)
    kind = F.substring_index("grp", ":", 1)
    spaced = text.clean_lines(F.col("spaced"))
    place = F.struct("rank", "node_id")
    cards = nodes.groupBy(*keys, "scope").agg(
        F.min_by(F.struct(F.col("link").alias("href"), spaced.alias("label")), F.when(kind == "link", place)).alias("link"),
        F.min_by(spaced, F.when(kind == "title", F.col("node_id"))).alias("title"),
        F.min_by(spaced, F.when((kind == "snippet") & (spaced != ""), F.col("node_id"))).alias("snippet"),
    )
    found = cards.select(*by, "site_ord", "adapter", F.struct(*paged, "scope").alias("pos"), F.coalesce("title", "link.label").alias("title"), F.col("link.href").alias("url"), F.coalesce("snippet", F.lit("")).alias("snippet"))
    own = found.where((dialects.adapter_of(F.col("url")) == F.col("adapter")) & (F.col("title") != ""))
    first = Window.partitionBy(*by, "site_ord", "url").orderBy("pos")
    own = own.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    ranked = own.withColumn("rn", F.row_number().over(Window.partitionBy(*by, "site_ord").orderBy("pos")))
    return ranked.where(F.col("rn") <= limit).select(*by, "site_ord", "adapter", "rn", "title", "url", "snippet")


def title_filter(found: DataFrame, query: str) -> DataFrame:
    """Hits whose title has the whole query in it, letters and digits compared only. A query of under three such characters drops all."""
    return found.where(_has_query(query))


def _has_query(query: str) -> Column:
    wanted = text.match_key(F.lit(query))
    return (F.length(wanted) >= 3) & F.contains(text.match_key(F.col("title")), wanted)


def results(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Hits as results: url without fragment, stripped title and snippet, and the site they are on."""
    url = urls.normalize(F.col("url"))
    out = found.select(*by, "site_ord", "rn", text.strip(F.col("title")).alias("title"), url.alias("url"), text.strip(F.col("snippet")).alias("snippet"), urls.site_name(url, F.col("adapter")).alias("site"))
    return out.where((F.col("title") != "") & urls.part(F.col("url"), "scheme").isin("http", "https") & (urls.part(F.col("url"), "authority") != ""))


def interleave(found: DataFrame, limit: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lists merged by turns: all first items in list order, then all second ones. A URL counts where it comes first, and the merge ends before a
    turn that brings no new URL. Adds `place` from 1. `found`: *keys, site_ord, rn, url, ..."""
    by = list(keys)
    if limit is not None:  # each turn brings one new URL at least, so later turns are out of reach
        found = found.where(F.col("rn") <= limit)
    seen = found.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "url").orderBy("rn", "site_ord")))
    turns = seen.groupBy(*by, "rn").agg(F.max((F.col("_k") == 1).cast("int")).alias("fresh")).where("fresh = 0")
    end = turns.groupBy(*by).agg(F.min("rn").alias("_end")) if by else turns.agg(F.min("rn").alias("_end"))
    new = seen.where("_k = 1").drop("_k")
    new = new.join(end, by, "left") if by else new.crossJoin(F.broadcast(end))  # one row
    new = new.where(F.col("_end").isNull() | (F.col("rn") < F.col("_end"))).drop("_end")
    if limit is not None and not by:
        new = new.orderBy("rn", "site_ord").limit(limit)
    if limit is None:
        return ranks.numbered(new, by, ["rn", "site_ord"], "place")
    return new.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("rn", "site_ord"))).where(F.col("place") <= limit)


def requests(spark: SparkSession, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(site_ord, adapter, url, data, response_encoding, filtered) of the search requests of all sites that have a search; the words sent are the query's longest, if it
    has several. A blank query or a limit out of range raises."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be from 1 to {MAX_LIMIT}")
    keyword, filtered = spark.range(1).select(text.search_keyword(F.lit(query)).alias("k")).select("k.keyword", "k.filtered").first()
    rows = [(r["site_ord"], r["adapter"], r["url"], r["data"], r["response_encoding"], filtered) for r in dialects.search_requests(keyword)]
    return spark.createDataFrame(rows, "site_ord int, adapter string, url string, data binary, response_encoding string, filtered boolean")


def outcomes(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with what came back (site_ord, html, and page if a site may answer in several): adds these and status, `blocked` for a page that asks for verification, `missing`
    without a response. The requests go to the pages, which stay where they are."""
    status = F.when(F.col("html").isNull(), "missing").when(text.is_verification_page(F.col("html")), "blocked").otherwise("ok")
    paged = ["page"] if "page" in responses.columns else []
    came = F.broadcast(asked).join(responses.select("site_ord", *paged, "html"), "site_ord")  # a row a site
    silent = asked.join(responses.select("site_ord").distinct(), "site_ord", "left_anti")
    return came.unionByName(silent, allowMissingColumns=True).withColumn("status", status)


def found_on_sites(came: DataFrame, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Results of one search, of the rows of `outcomes`, by `place`: hits of sites that answered, whose titles have the whole query in them if just a part of it was
    sent, merged by turns. Sites that failed give nothing and stop nothing."""
    paged = ["page"] if "page" in came.columns else []
    ok = came.where("status = 'ok'").select("site_ord", "adapter", "url", *paged, "html")
    flags = F.broadcast(came.select("site_ord", "filtered").distinct())  # a row a site
    some = written(hits(ok, limit))  # at most `limit` rows a site, which several steps read: pages are parsed once
    kept = some.join(flags, "site_ord").where(~F.col("filtered") | _has_query(query)).drop("filtered")
    again = kept.withColumn("rn", F.row_number().over(Window.partitionBy("site_ord").orderBy("rn")))
    return interleave(results(again), limit).select("place", "title", "url", "snippet", "site")


def sites(found: DataFrame) -> DataFrame:
    """(sites): the sites that results are from, sorted, as one line."""
    return found.agg(F.array_join(F.array_sort(F.collect_set("site")), ", ").alias("sites"))


def listing(found: DataFrame) -> DataFrame:
    """(place, entry): results as they are shown, by number, below the sites that they are limited to at place 0, null without results."""
    head = sites(found).select(F.lit(0).alias("place"), F.when(F.col("sites") != "", F.format_string(LISTING_HEAD, F.col("sites"))).alias("entry"))
    lines = F.array(F.format_string(LISTING_TITLE, F.col("place"), F.col("title")), F.format_string(LISTING_SITE, F.col("site")), F.format_string(LISTING_URL, F.col("url")))
    note = F.when(F.col("snippet") != "", F.format_string(LISTING_SNIPPET, F.col("snippet")))
    return head.unionByName(found.select("place", F.array_join(F.concat(lines, F.array_compact(F.array(note))), "\n").alias("entry")))


def pick(found: DataFrame, number: int) -> DataFrame:
    """The result with that number, from 1; a number that no result has raises."""
    chosen = found.where(F.col("place") == number)
    if chosen.isEmpty():
        raise LookupError(f"the number must be from 1 to {found.count()}")
    return chosen
