"""Numbers from 1 in the order of a whole-number column, dealt by ranges of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = 4096


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "number", span: int = SPAN) -> DataFrame:
    """Adds `name`: the row's number within `keys` by `order`, whose first column is a whole number, nulls first. A key's rows are numbered within ranges of `span` values of
    that column, and moved on by the sizes of the ranges before. So no task gets more than the rows of a range of values, however many a key has; rows of one value stay together."""
    # Ranges have numbers of their own: that of the null values is before all others.
    given = F.col(order[0]).isNotNull()
    dealt = rows.withColumn("_given", given).withColumn("_range", F.coalesce(F.floor(F.col(order[0]) / span), F.lit(0)))
    unit = [*keys, "_given", "_range"]
    sizes = dealt.groupBy(*unit).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_given", "_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(k).alias(f"_start_{i}") for i, k in enumerate(unit)), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(*unit).orderBy(*order)))
    same = F.lit(True)
    for i, k in enumerate(unit):
        same = same & (F.col(k).eqNullSafe(F.col(f"_start_{i}")) if k in keys else F.col(k) == F.col(f"_start_{i}"))
    out = own.join(starts, same).withColumn("_number", (F.col("_start") + F.col("_rank")).cast("int"))
    return out.select(*rows.columns, F.col("_number").alias(name))
