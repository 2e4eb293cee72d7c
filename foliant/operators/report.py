"""Run reports: number ranges, early stops, exit codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_ranges(rows: DataFrame, keys: list[str], number: str = "number") -> DataFrame:
    """(*keys, ranges): distinct numbers as `2–4, 8, 10–11`."""
    order = Window.partitionBy(*keys).orderBy(number)
    islands = rows.select(*keys, number).distinct().withColumn("_i", F.col(number) - F.row_number().over(order))
    spans = islands.groupBy(*keys, "_i").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    label = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("–", F.col("a").cast("string"), F.col("b").cast("string")))
    return spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", label.alias("l")))).alias("s")).select(*keys, F.array_join(F.transform("s", lambda x: x["l"]), ", ").alias("ranges"))


def breaker(attempts: DataFrame, keys: list[str], most: int = 5, refresh: bool = False) -> DataFrame:
    """The failed rows of `attempts` (*keys, idx, st in ok, error, blocked, cache) when a run stops at the first block or the `most`-th error in a row.
    Cached rows neither count nor reset the row of errors; after a stop what is not cached has failed too (with `refresh` all of it)."""
    order = Window.partitionBy(*keys).orderBy("idx")
    runs = attempts.withColumn("_g", F.sum(F.when(F.col("st") == "ok", 1).otherwise(0)).over(order))
    streak = F.sum(F.when(F.col("st") == "error", 1).otherwise(0)).over(Window.partitionBy(*keys, "_g").orderBy("idx"))
    runs = runs.withColumn("_streak", streak)
    stop = (F.col("st") == "blocked") | ((F.col("st") == "error") & (F.col("_streak") >= most))
    runs = runs.withColumn("_stop", F.min(F.when(stop, F.col("idx"))).over(Window.partitionBy(*keys)))
    before = F.col("_stop").isNull() | (F.col("idx") <= F.col("_stop"))
    failed = (before & F.col("st").isin("error", "blocked")) | (~before & (F.lit(refresh) | (F.col("st") != "cache")))
    return runs.where(failed).select(*keys, "idx")


def run_report(collated: DataFrame, assembled: DataFrame, skipped: DataFrame, keys: list[str], interrupted: bool = False) -> DataFrame:
    """One row a book: chapters in the output, failed numbers, chapters left for later, and the exit code (2 for failures before 130 for an
    interrupted run; 1 where nothing could be put together)."""
    failed = collated.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("failed"), F.col("number")))).alias("failed_chapters"))
    total = assembled.groupBy(*keys).agg(F.count("*").alias("total_chapters"))
    out = failed.join(total, keys, "left").join(skipped.select(*keys, F.col("n_skipped").alias("skipped_chapters")), keys, "left")
    out = out.select(*keys, F.coalesce("total_chapters", F.lit(0)).alias("total_chapters"), "failed_chapters", F.coalesce("skipped_chapters", F.lit(0)).alias("skipped_chapters"), F.lit(interrupted).alias("interrupted"))
    code = F.when(F.col("total_chapters") == 0, 1).when(F.size("failed_chapters") > 0, 2).when(F.col("interrupted"), 130).otherwise(0)
    return out.withColumn("exit_code", code)
