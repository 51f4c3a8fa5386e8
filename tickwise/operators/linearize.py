"""Linearizability of registers, decided from intervals instead of by search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def violations(history: DataFrame, key: tuple[str, ...], kind: str, value: str, began: str, ended: str) -> DataFrame:
    """(key, value, problem) of a history of reads and writes; a key without a row is linearizable.

    A write has kind "w" and a read "r"; each value of a key is written once. A value's zone runs from the least end to the
    largest start of its operations: forward if that is ahead, otherwise the value fits at one instant and the zone is turned.
    A register's history is linearizable exactly if no read ends before its value's write began or reads what none wrote, no
    two forward zones overlap, and no turned zone lies inside a forward one. One aggregate and a sort of zones per key.
    A null value is what a read before any write returns: it is as if a write of it had ended before all else.
    """
    ops = history.select(*key, kind, value, began, ended)
    starts = ops.groupBy(*key).agg((F.min(began) - 2).alias(began), (F.min(began) - 1).alias(ended))
    initial = starts.select(*key, F.lit("w").alias(kind), F.lit(None).cast(ops.schema[value].dataType).alias(value), began, ended)
    is_write = F.col(kind) == "w"
    zones = ops.unionByName(initial).groupBy(*key, value).agg(
        F.count(F.when(is_write, 1)).alias("__writes"), F.min(F.when(is_write, F.col(began))).alias("__born"), F.min(F.when(~is_write, F.col(ended))).alias("__read"),
        F.min(ended).alias("__end"), F.max(began).alias("__start"),
    )
    single = zones.select(*key, value, F.when(F.col("__writes") == 0, "never written").when(F.col("__writes") > 1, "written twice").when(F.col("__read") < F.col("__born"), "read before its write").alias("problem"))
    forward = F.col("__end") < F.col("__start")
    spans = zones.select(*key, value, forward.alias("__forward"), F.least("__end", "__start").alias("__lo"), F.greatest("__end", "__start").alias("__hi"))
    # a turned zone is inside only if it starts later, so at equal starts it comes first
    before = W.partitionBy(*key).orderBy("__lo", F.col("__forward"), "__hi").rowsBetween(W.unboundedPreceding, -1)
    reached = spans.withColumn("__open", F.max(F.when(F.col("__forward"), F.col("__hi"))).over(before))
    crossing = reached.select(*key, value, F.when(F.col("__forward") & (F.col("__lo") < F.col("__open")), "zones overlap").when(~F.col("__forward") & (F.col("__hi") < F.col("__open")), "inside another zone").alias("problem"))
    return single.unionByName(crossing).where(F.col("problem").isNotNull())
