"""Site dialects: what a site is called and how it is recognised, and hooks that say where its pages differ from the common rules.

A hook gets and gives Column expressions (or, where rows are chosen, DataFrames) of all pages of its site at once; plans ask the registry for them while they are built, so a
dialect that is registered is part of every plan built from then on. A hook that returns None leaves the common rule in place, and only dialects that have an
answer become branches of an expression. A dialect's rows never pass through another's branch.

    class Mine(Dialect):
        name, hosts, catalog = "mine", ("mine.example",), ("ol.toc a",)
        def site_title(self, title): return F.regexp_replace(title, " - mine$", "")

    with registered(Mine()): ...
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import urlencode, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, urls

# Fields of the search forms besides the words, and their encoding.
FORM_FIELDS = {"show": "title", "classid": "0"}
FORM_ENCODING = "gb2312"


@dataclass(frozen=True)
class Hits:
    """Selectors of search hits: the card, links to try in it one after the other, title nodes, snippet nodes."""

    card: str
    links: tuple[str, ...]
    titles: tuple[str, ...]
    snippets: tuple[str, ...]


@dataclass(frozen=True)
class Chapter:
    """A chapter as clean-up gets it: columns of its title as written and squeezed, its clean lines, its number, its book's title, and whether it is the first."""

    title: Column
    clean_title: Column
    lines: Column
    number: Column
    book: Column
    first: Column


class Dialect:
    """The common rules. Sites override what differs."""

    name = "generic"
    hosts: tuple[str, ...] = ()
    catalog: tuple[str, ...] = ()
    content: tuple[str, ...] = ()
    search_form: str | None = None
    response_encoding: str | None = None
    hits: Hits | None = None

    def matches(self, authority: Column) -> Column | None:
        """Whether a page with this authority, in lower case, is the site's, besides those on its hosts and their subdomains."""
        return None

    def normalize(self, url: Column) -> Column | None:
        """The address that a normalised URL goes by."""
        return None

    def site_title(self, title: Column) -> Column | None:
        """A book's title without what the site appends to it."""
        return None

    def catalog_label(self, label: Column) -> Column | None:
        """Whether a link with this label leads to the table of contents."""
        return None

    def chapter_list(self, links: DataFrame, keys: list[str]) -> DataFrame | None:
        """(*keys, adapter, number, title, url) of the site's catalogs, from their links in page order."""
        return None

    def guess_path(self, parts: Column) -> Column | None:
        """The path of the table of contents that a chapter's address points to by its shape; null if it has no such shape."""
        return None

    def page_title(self, content: Column) -> Column | None:
        """A chapter's title as its content says it; null if it does not."""
        return None

    def clean(self, chapter: Chapter) -> Column | None:
        """struct(title, content) of a chapter without what the site adds."""
        return None

    def assemble(self, chapters: DataFrame, keys: list[str]) -> DataFrame | None:
        """(*keys, number, title, content) of the books' final chapters, from the site's own."""
        return None

    def next_page(self, linked: Column, numbered: Column, page: Column) -> Column | None:
        """The page that continues one: of a link that says so, and of the link with the next greater page number."""
        return None

    def chapter_path(self, path: Column) -> Column | None:
        """The path that a chapter's first page has."""
        return None

    def search_address(self, query: str) -> str | None:
        """A search as an address."""
        return f"{self.search_form}?{form(query)}" if self.search_form else None

    def search_request(self, query: str) -> dict | None:
        """url, method, data and headers of a search; None if the site has none."""
        if not self.search_form:
            return None
        at = urlsplit(self.search_form)
        site = f"{at.scheme}://{at.netloc}"
        headers = [("Content-Type", "application/x-www-form-urlencoded"), ("Origin", site), ("Referer", f"{site}/")]
        return {"url": self.search_form, "method": "POST", "data": form(query).encode("ascii"), "headers": headers}


class Generic(Dialect):
    # Selectors.
    catalog = ("#list a", "#catalog a", "#chapterList a", ".chapter-list a", ".book-list a", ".listmain a")
    content = (".read-content", ".readContent", ".content", ".showtxt", "article")


GENERIC = Generic()
_sites: list[Dialect] = []


def sites() -> tuple[Dialect, ...]:
    """The registered dialects in order."""
    return tuple(_sites)


def known() -> tuple[Dialect, ...]:
    """All dialects, the generic one last."""
    return (*_sites, GENERIC)


def register(dialect: Dialect) -> None:
    """Adds a site behind those that are there; its name must be new."""
    if not dialect.name or dialect.name in {d.name for d in known()}:
        raise ValueError(f"a dialect named {dialect.name!r} is there already")
    _sites.append(dialect)


def unregister(name: str) -> None:
    _sites[:] = [d for d in _sites if d.name != name]


@contextmanager
def registered(*more: Dialect) -> Iterator[None]:
    """These sites too, for the plans that are built within."""
    before = list(_sites)
    try:
        for d in more:
            register(d)
        yield
    finally:
        _sites[:] = before


def hook(adapter: Column, ask: Callable[[Dialect], Column | None], otherwise: Column) -> Column:
    """For each row what its dialect answers, `otherwise` where that has no answer."""
    out = None
    for d in known():
        if (found := ask(d)) is not None:
            out = F.when(adapter == d.name, found) if out is None else out.when(adapter == d.name, found)
    return otherwise if out is None else out.otherwise(otherwise)


def adapter_of(url: Column, hosts: list[tuple[int, str, str]] | None = None) -> Column:
    """The first registered dialect whose host the URL's authority is or ends with, or which takes it by its own rule, else `generic`. Hosts (place, adapter, host) are a
    literal map, so pages are not joined or shuffled."""
    rules: list[tuple[int, str, Dialect]] = [] if hosts is not None else [(i, d.name, d) for i, d in enumerate(sites())]
    hosts = hosts if hosts is not None else [(i, d.name, h) for i, d in enumerate(sites()) for h in d.hosts]
    names = {i: a for i, a, _ in [*hosts, *rules]}
    if not names:
        return F.lit("generic")
    name = F.create_map(*(x for i, a in names.items() for x in (F.lit(i), F.lit(a))))

    def first(authority: Column) -> Column:
        labels = F.split(authority, r"\.")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
        places = []
        if hosts:
            place = F.create_map(*(x for i, _, h in hosts for x in (F.lit(h), F.lit(i))))
            places.append(F.array_min(F.transform(suffixes, lambda h: place[h])))
        places += [F.when(found, i) for i, _, d in rules if (found := d.matches(authority)) is not None]
        return F.least(*places) if len(places) > 1 else places[0] if places else F.lit(None).cast("int")

    return F.coalesce(name[urls.let(F.lower(urls.part(url, "authority")), first)], F.lit("generic"))


def dispatch(pages: DataFrame, hosts: list[tuple[int, str, str]] | None = None, url: str = "url") -> DataFrame:
    """Adds `adapter`."""
    return pages.withColumn("adapter", adapter_of(F.col(url), hosts))


def normalize(url: Column, adapter: Column) -> Column:
    """Without its fragment, and as its site addresses it."""
    return urls.let(urls.normalize(url), lambda u: hook(adapter, lambda d: d.normalize(u), u))


def guess_catalog(url: Column, adapter: Column) -> Column:
    """The table of contents that a chapter's address points to by its shape; null for sites without such shapes."""

    def guess(p: Column) -> Column:
        path = hook(adapter, lambda d: d.guess_path(p), F.lit(None).cast("string"))
        return urls.let(path, lambda x: F.when(x.isNotNull(), urls.build(p["scheme"], p["authority"], x, F.lit(""))))

    return urls.let(urls.parts(url), guess)


def canonical_chapter(url: Column, adapter: Column) -> Column:
    """The address that a chapter's first page has."""
    path = lambda p: hook(adapter, lambda d: d.chapter_path(p["path"]), p["path"])
    return urls.let(urls.parts(url), lambda p: urls.let(path(p), lambda x: urls.build(p["scheme"], p["authority"], x, p["query"])))


def site_title(title: Column, adapter: Column) -> Column:
    """What a site appends to its book titles goes."""
    return hook(adapter, lambda d: d.site_title(title), title)


def marked(markers: list[str], c: Column) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(c, F.lit(m))
    return found


def catalog_label(label: Column, adapter: Column) -> Column:
    return hook(adapter, lambda d: d.catalog_label(label), marked(fixed.CATALOG_MARKERS, label))


def form(query: str) -> str:
    """The words of a query as a filled-in form; a character outside the form's encoding raises, as does a blank query."""
    words = query.split()
    if not words:
        raise ValueError("a search needs a word")
    return urlencode({"keyboard": " ".join(words)} | FORM_FIELDS, encoding=FORM_ENCODING)


def search_requests(query: str) -> list[dict]:
    """The search request of each site that has a search, in registry order."""
    form(query)  # refuses what no site can be asked
    asked = [(i, d, d.search_request(query)) for i, d in enumerate(sites())]
    return [{"site_ord": i, "adapter": d.name, **r, "response_encoding": d.response_encoding} for i, d, r in asked if r is not None]


def search_url(query: str) -> str:
    """The first site's search as an address."""
    return next(a for d in sites() if (a := d.search_address(query)))
