"""URL rules by hashed host-suffix and path-prefix expressions; DataFrame functions only.

Each distinct URL is expanded into its host and every parent domain, times every prefix of its path that is as long as some rule's path. The
expressions meet the rules in an equi-join on the first four bytes of their SHA-256 digests; a hit counts if the full digests agree, and
of a URL's hits the rule with the longest host and path wins, then the one with the longer host, then a block.

Cases: a null URL or one without `://` has empty host and path, which no rule fits; so verdict `default`. Rules with a null host or path
count as empty there; of two equal rules a block wins. Repeated pages are each returned; empty tables give empty results; a page's other
columns are ignored. Rules are broadcast only if counted to be at most `BROADCAST_RULES`; else both sides shuffle by digest prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000


def _lower(host: Column) -> Column:
    """A-Z only, for URLs and rules alike."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or the end, A-Z in lower case; empty where there is none."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    return F.when(F.locate("://", url) > 0, _lower(host)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, F.lit("\x00"), path), 256))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each page; `rules` has host, path and verdict (allow or block)."""
    known = rules.select(_lower(F.coalesce("host", F.lit(""))).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").where("rule_host <> ''")
    known = known.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))  # block is the greater word
    known = known.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("digest", 1, 4))
    lengths = sorted(r[0] for r in known.select(F.length("rule_path")).distinct().collect())  # a bounded set: lengths, not rules
    small = known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    hosts = parsed.where("host <> ''").select("host", "path").distinct()
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    asked = hosts.select("host", "path", F.explode(suffixes).alias("suffix")).select("host", "path", "suffix", F.explode(prefixes).alias("prefix"))
    asked = asked.withColumn("asked", _digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("asked", 1, 4))
    hits = asked.join(F.broadcast(known) if small else known, "short").where("asked = digest")
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), "rule_verdict", F.concat("rule_host", "rule_path").alias("rule"))
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )
