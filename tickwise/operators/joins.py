"""Joins that Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwise.plans.rules import matched

from .parts import carried, dealt


def range_join(points: DataFrame, value: str, ranges: DataFrame, low: str, high: str, width: int, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both sides with low <= value <= high, and equal ``on`` columns: an equi-join on slices.

    A range lies in at most two slices of its level, whose slices are ``width`` times a power of two wide, as wide as the range
    or wider; a point lies in one slice of each level that has ranges. So neither a long range nor a narrow width costs
    more than a row per level. The value and bounds are whole numbers. A null in ``on`` equals a null.
    """
    span = F.greatest(F.lit(1.0), (F.col(high) - F.col(low) + 1).cast("double") / width)
    level = F.when(span <= 1, 0).otherwise(F.ceil(F.log2(span))).cast("int")
    leveled = ranges.where(F.col(low) <= F.col(high)).withColumn("__level", level)
    levels = [r[0] for r in leveled.select("__level").distinct().collect()] or [0]
    at = lambda c: F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("__level"))))
    left = points.withColumn("__level", F.explode(F.array(*[F.lit(n) for n in sorted(levels)]))).withColumn("__slice", at(value))
    right = leveled.withColumn("__slice", F.explode(F.sequence(at(low), at(high))))
    joined = matched(left, right, [*on, "__level", "__slice"], "inner")
    return joined.where(F.col(value).between(F.col(low), F.col(high))).drop("__level", "__slice")


def asof_join(left: DataFrame, right: DataFrame, on: tuple[str, ...], at: str, payload: tuple[str, ...], prefix: str = "last_") -> DataFrame:
    """Each left row with the latest right row of the same key at or before its time; null if there is none.

    One sort of both sides together instead of a join: ``last`` over the rows so far carries the payload, so rows never
    multiply. A key's rows may lie in many parts, each of which starts from the latest right row of those before. At equal times the right row counts; of right rows with one time, the one with the largest payload.
    """
    row = F.struct(*[F.col(c) for c in (at, *payload)])
    a = left.withColumn("__right", F.lit(0)).withColumn("__row", F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType))
    b = right.groupBy(*on, at).agg(F.max(row).alias("__row")).withColumn("__right", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    placed = carried(dealt(both, [*[F.col(c) for c in on], F.col(at)]), on, F.max("__row"), F.max("__edge"), "__before")
    seen = W.partitionBy("__part", *on).orderBy(at, F.col("__right").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = placed.withColumn("__row", F.coalesce(F.last("__row", ignorenulls=True).over(seen), "__before")).where("__right = 0")
    return found.select(*left.columns, *[F.col(f"__row.{c}").alias(prefix + c) for c in (at, *payload)])


def divide(domain: DataFrame, facts: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Groups of ``facts`` that hold every row of ``domain``: counted, not paired, so no group times domain is built."""
    need = domain.distinct()
    have = matched(facts.select(*group, *domain.columns).distinct(), need, domain.columns, "left_semi").groupBy(*group).agg(F.count("*").alias("__n"))
    return have.join(need.agg(F.count("*").alias("__need")), F.col("__n") == F.col("__need")).select(*group)


def lookup(rows: DataFrame, cells: DataFrame, on: tuple[str, ...], value: str, bottom) -> DataFrame:
    """A lattice cell per row, or ``bottom`` where the key has none."""
    return matched(rows, cells.select(*on, value), list(on), "left").withColumn(value, F.coalesce(value, F.lit(bottom)))
