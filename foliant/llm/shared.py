"""Row keys and connected components shared by the operators, and the library's written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, written

__all__ = ["NO_ID", "components", "given_id", "scratch", "with_key", "written"]

NO_ID = -(1 << 63)


def with_key(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text_hash, text, *more): the first two tell rows apart that share an id, and are never null."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.coalesce("text", F.lit("")).alias("text"),
        *more,
    )


def given_id(column: str = "doc_id"):
    """Undoes the stand-in for a null id."""
    return F.when(F.col(column) != NO_ID, F.col(column)).alias(column)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): for each node of an edge (a, b), the smallest node that it can reach.

    Each round takes the least label among a node's neighbours for the node and for the node that it is labelled by, then follows labels one
    step, so that whole trees join at once and the number of rounds grows with the logarithm of the longest chain. Labels are a written table
    after each round and nothing but an emptiness test reaches the driver. A hub's rows meet in joins (which AQE splits) and in partial aggregates.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        lower = near.join(labels, "node").where("seen < root")
        told = lower.select("node", "seen").union(lower.select(F.col("root").alias("node"), "seen")).groupBy("node").agg(F.min("seen").alias("seen"))
        hooked = labels.join(told, "node", "left").select("node", F.least("root", F.coalesce("seen", "root")).alias("half"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("half"), F.col("root").alias("far"))
        now = written(hooked.join(jump, "half", "left").select("node", F.least("half", F.coalesce("far", "half")).alias("root"), "was"))
        if now.where("root <> was").isEmpty():
            return now.select("node", "root")
        labels = now.select("node", "root")
    raise RuntimeError("components did not settle")
