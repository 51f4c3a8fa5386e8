"""Versioned tables: each row with the ticks in which it held, and reads as of a tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwise.operators.parts import carried, dealt


def versions(changes: DataFrame, key: tuple[str, ...], tick: str, alive: Column) -> DataFrame:
    """(columns, from_tick, to_tick) from a log of puts and deletes: a version ends where the key's next change begins.

    Of changes to a key in one tick the last in canonical order counts, and a put beats a delete. ``alive`` is false for deletes.
    """
    rest = [c for c in changes.columns if c not in key and c != tick]
    marked = changes.withColumn("__alive", alive)
    one = marked.groupBy(*key, tick).agg(F.max(F.struct("__alive", *rest)).alias("__row"))
    placed = carried(dealt(one, [F.col(c) for c in (*key, tick)]), key, F.min(tick), F.min("__edge"), "__next", back=True)
    following = F.coalesce(F.lead(tick).over(W.partitionBy("__part", *key).orderBy(tick)), "__next")
    ended = placed.withColumn("to_tick", following).where("__row.__alive")
    return ended.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest], F.col(tick).alias("from_tick"), "to_tick")


def as_of(history: DataFrame, tick: Column) -> DataFrame:
    """The rows that held at ``tick``; both bounds reach the scan as pushed filters."""
    return history.where((F.col("from_tick") <= tick) & (F.col("to_tick").isNull() | (F.col("to_tick") > tick))).drop("from_tick", "to_tick")


def changed(history: DataFrame, after: Column, upto: Column) -> DataFrame:
    """Rows that began in (after, upto], and rows that ended then, with ``change`` +1 or -1."""
    began = history.where((F.col("from_tick") > after) & (F.col("from_tick") <= upto)).withColumn("change", F.lit(1))
    ended = history.where((F.col("to_tick") > after) & (F.col("to_tick") <= upto)).withColumn("change", F.lit(-1))
    return began.unionByName(ended).drop("from_tick", "to_tick")


def store(kept: DataFrame, path: str, era: int) -> None:
    """Writes versions in folders by the era, ``era`` ticks long, in which they ended; those that still hold have one of their own."""
    kept.withColumn("until", F.call_function("div", F.col("to_tick").cast("bigint"), F.lit(era).cast("bigint"))).write.partitionBy("until").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_of_stored(history: DataFrame, tick: int, era: int) -> DataFrame:
    """``as_of`` over stored versions: eras that ended before are not read, and the bounds reach the scan of the others."""
    return as_of(history.where(F.col("until").isNull() | (F.col("until") >= tick // era)).drop("until"), F.lit(tick))


def current(history: DataFrame) -> DataFrame:
    """The rows that hold now: one folder of a stored history."""
    return history.where("until is null").drop("from_tick", "to_tick", "until")
