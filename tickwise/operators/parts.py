"""Ordered work on groups of any size: a range sort deals rows in order, and parts of one group exchange only their edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwise.plans.shared import materialize


def dealt(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``__part``, which rises with ``order``. Written, so that every pass over it sees the same parts."""
    return materialize(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def carried(placed: DataFrame, per: tuple[str, ...], summary: Column, over: Column, name: str, back: bool = False) -> DataFrame:
    """``placed`` with ``name``: ``over`` of the group's earlier parts' (or with ``back`` later parts') ``summary``; null if none.

    ``over`` reads the column ``__edge``. There is one edge per group and part, so their window is small.
    """
    edges = placed.groupBy("__part", *per).agg(summary.alias("__edge"))
    others = W.partitionBy(*per).orderBy(F.col("__part").desc() if back else F.col("__part")).rowsBetween(W.unboundedPreceding, -1)
    named = edges.select(F.col("__part").alias("__of"), *[F.col(c).alias(f"__of_{c}") for c in per], over.over(others).alias(name))
    on = reduce(Column.__and__, [F.col("__part") == F.col("__of"), *[F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in per]])
    return placed.join(named, on).drop("__of", *[f"__of_{c}" for c in per])
