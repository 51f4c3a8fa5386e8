"""Running sums and row numbers over groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block at least.
LEAST_ROWS = 512


def running(df: DataFrame, group: str, order: Column, value: Column, out: str, rows: int, ties: list[str]) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that come before, in (order, ties).

    ``order`` is a non-negative long below 2**31, spread evenly, so equal slices of it make even blocks. Each
    block is summed alone; the sums of whole blocks, a row each, are added up per group and joined back on the
    same key that the blocks are dealt by. Both the rows of a block and the number of blocks grow with the square root of ``rows``. Rows that tie in all of it are in arbitrary order among themselves.
    """
    blocks = max(1, rows // max(LEAST_ROWS, 2 * isqrt(rows)))
    width = -(-(1 << 31) // blocks)
    dealt = df.withColumn("__order", order).withColumn("__value", value).withColumn("__block", F.expr(f"__order div {width}"))
    sums = dealt.groupBy(group, "__block").agg(F.sum("__value").alias("__sum"))
    before = F.sum("__sum").over(W.partitionBy(group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(F.col(group).alias("__g"), F.col("__block").alias("__b"), F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum("__value").over(W.partitionBy(group, "__block").orderBy("__order", *ties).rowsBetween(W.unboundedPreceding, -1))
    numbered = dealt.withColumn("__inside", F.coalesce(inside, F.lit(0)))
    joined = numbered.join(sums, (F.col(group) == F.col("__g")) & (F.col("__block") == F.col("__b")))
    return joined.withColumn(out, F.col("__before") + F.col("__inside")).drop("__order", "__value", "__block", "__inside", "__g", "__b", "__before")
