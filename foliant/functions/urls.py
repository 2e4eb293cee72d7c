"""URL rules as Column expressions: splitting, joining by RFC 3986, and the identities that books and pages go by."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import REFUSED_HREFS
from .text import strip

SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


_GROUPS = {"scheme": 1, "authority": 2, "path": 3, "query": 4}


def let(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f uses it: expression trees would else grow by each use."""
    return F.element_at(F.transform(F.array(value), f), 1)


def part(url: Column, name: str) -> Column:
    """scheme (lower case), authority, path or query of a URL; empty if absent."""
    found = F.regexp_extract(url, SPLIT, _GROUPS[name])
    return F.lower(found) if name == "scheme" else found


def parts(url: Column) -> Column:
    """All four as a struct."""
    return let(url, lambda u: F.struct(*(part(u, n).alias(n) for n in _GROUPS)))


def build(scheme: Column, authority: Column, path: Column, query: Column) -> Column:
    """The URL of these parts; none of them should be costly."""
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""),
        F.when((authority != "") & (path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def built(p: Column) -> Column:
    return build(p["scheme"], p["authority"], p["path"], p["query"])


def normalize(url: Column) -> Column:
    """Without its fragment; the scheme in lower case."""
    return let(parts(url), built)


def _resolved(path: Column, base: Column) -> Column:
    folder = let(F.split(base, "/"), lambda x: F.when(F.element_at(x, -1) != "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))
    joined = let(F.concat(folder, F.split(path, "/")), lambda x: F.filter(x, lambda y, i: (i == 0) | (i == F.size(x) - 1) | (y != "")))
    empty = F.array().cast("array<string>")

    def folded(segments: Column) -> Column:
        kept = F.aggregate(segments, empty, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
        tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(empty)
        return F.coalesce(F.nullif(F.array_join(F.concat(kept, tail), "/"), F.lit("")), F.lit("/"))

    return let(F.when(F.startswith(path, F.lit("/")), F.split(path, "/")).otherwise(joined), folded)


_SPLIT = re.compile(SPLIT)
_BLANK = "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _without_dots(segments: list[str]) -> str:
    """RFC 3986, 5.2.4, on the segments of a path."""
    kept: list[str] = []
    for x in segments:
        if x == "..":
            del kept[-1:]
        elif x != ".":
            kept.append(x)
    return "/".join(kept + [""] * (segments[-1] in (".", ".."))) or "/"


class Resolver:
    """`absolute` for links of one page, for use where the page is parsed anyway."""

    def __init__(self, base: str) -> None:
        scheme, self.authority, self.path, self.query = (x or "" for x in _SPLIT.match(base).groups())
        self.scheme = scheme.lower()
        folder = self.path.split("/")
        self.folder = folder[:-1] if folder[-1] else folder

    def __call__(self, href: str | None) -> str | None:
        if not href or href.startswith(tuple(REFUSED_HREFS)):
            return None
        parts = _SPLIT.match(href.strip(_BLANK).translate({9: None, 10: None, 13: None}))
        scheme, authority, path, query = (x or "" for x in parts.groups())
        scheme = scheme.lower() or self.scheme
        if scheme == self.scheme and not authority:
            authority, given = self.authority, path
            if given.startswith("/"):
                path = _without_dots(given.split("/"))
            elif given:
                way = [*self.folder, *given.split("/")]
                path = _without_dots([x for i, x in enumerate(way) if x or i in (0, len(way) - 1)])
            else:
                path, query = self.path, query or self.query
        if scheme not in ("http", "https") or not authority:
            return None
        path = f"/{path}" if path and not path.startswith("/") else path
        return f"{scheme}://{authority}{path}" + (f"?{query}" if query else "")


def absolute(href: Column, base: Column) -> Column:
    """An http(s) link of a page as an absolute URL without fragment; null for what is no such link."""
    refused = F.lit(False)
    for prefix in REFUSED_HREFS:
        refused = refused | F.startswith(href, F.lit(prefix))

    def joined(h: Column, b: Column) -> Column:
        path = F.when((h["authority"] != "") | ((h["scheme"] != "") & (h["scheme"] != b["scheme"])), h["path"]).when(h["path"] == "", b["path"]).otherwise(_resolved(h["path"], b["path"]))
        foreign = (h["scheme"] != "") & (h["scheme"] != b["scheme"])
        own = ~foreign & (h["authority"] == "")
        return F.struct(
            F.when(foreign, h["scheme"]).otherwise(b["scheme"]).alias("scheme"),
            F.when(own, b["authority"]).otherwise(h["authority"]).alias("authority"),
            path.alias("path"),
            F.when(own & (h["path"] == "") & (h["query"] == ""), b["query"]).otherwise(h["query"]).alias("query"),
        )

    text = F.regexp_replace(strip(href), r"[\t\r\n]", "")
    url = let(parts(text), lambda h: let(parts(base), lambda b: let(joined(h, b), lambda u: F.when(u["scheme"].isin("http", "https") & (u["authority"] != ""), built(u)))))
    return F.when(href.isNotNull() & (href != "") & ~refused, url)


def same_origin(a: Column, b: Column) -> Column:
    return F.lower(part(a, "authority")) == F.lower(part(b, "authority"))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(part(url, "authority")), r"^www\.", "")


def same_document_key(url: Column) -> Column:
    """Equal for URLs that may stand for one document: scheme, query, `www.`, trailing slashes and search-engine country don't count."""
    host = bare_host(url)
    host = F.when(host.rlike(r"(?U)^google(?:\.\p{L}{2,3}){1,2}$"), F.lit("google")).otherwise(host)
    return F.concat(host, F.lit(" "), F.regexp_replace(part(url, "path"), "/+$", ""))


def site_name(url: Column, adapter: Column) -> Column:
    return F.coalesce(F.nullif(bare_host(url), F.lit("")), adapter)


def host_matches(url: Column, host: Column) -> Column:
    authority = F.lower(part(url, "authority"))
    return (authority == host) | F.endswith(authority, F.concat(F.lit("."), host))
