"""Logged conversation snapshots reduced to the maximal ones, then rendered.

A chat is often logged after each turn, so that one conversation is a prefix of a later one. The turns of a conversation are chained:
prefix hash i is the SHA-256 of prefix hash i-1, the role and the text, with the lengths of both, so that no text reads as another split. A conversation whose last hash is an inner prefix hash of another is
dropped by an anti-join, and of equal conversations the one with the smallest conv_id stays.

Cases: rows without a conv_id belong to no conversation and are left out; a null role or text counts as empty; turns go by (turn, role,
text), nulls first, and exactly repeated rows are one turn; an empty table gives an empty result; other columns are ignored.
A conversation's turns meet in one row, as they must to be rendered; what grows without bound, copies of a conversation or of a first turn,
meets only in aggregates and in joins on hashes of distinct prefixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def chains(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, prefixes): by conversation the sorted turns and the hash of each prefix."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), text("role"), text("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.array_distinct(F.collect_list("t"))).alias("turns"))
    link = lambda last, t: F.sha2(F.concat_ws("\x1f", last, F.length(t["role"]).cast("string"), t["role"], t["text"]), 256)
    grown = F.aggregate("turns", F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all")), lambda acc, t: F.struct(link(acc["last"], t).alias("last"), F.concat(acc["all"], F.array(link(acc["last"], t))).alias("all")), lambda acc: acc["all"])
    return whole.select("conv_id", "turns", grown.alias("prefixes"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, copies): conversations that no other one continues, one of each; copies counts the equal ones."""
    rows = written(chains(turns).withColumn("whole", F.element_at("prefixes", -1)))
    inner = rows.select(F.explode(F.slice("prefixes", 1, F.size("prefixes") - 1)).alias("whole")).distinct()
    firsts = rows.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")).join(inner, "whole", "left_anti")
    return rows.select("conv_id", "turns").join(firsts.select("conv_id", "copies"), "conv_id")


def render(turns: DataFrame, open_tag: str = "<|im_start|>", close_tag: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, copies, chat): each maximal conversation as one string, a header, the text and an end mark for each turn."""
    line = lambda t: F.concat(F.lit(open_tag), t["role"], F.lit("\n"), t["text"], F.lit(close_tag), F.lit("\n"))
    return maximal(turns).select("conv_id", F.size("turns").cast("long").alias("n_turns"), "copies", F.array_join(F.transform("turns", line), "").alias("chat"))
