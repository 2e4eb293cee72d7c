"""Relational operators over pages, links, chapters and caches."""

from . import dialects, sites

for _site in sites.BUILT_IN:
    dialects.register(_site)
