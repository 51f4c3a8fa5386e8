"""Delivery: exactly-once by dots, gapless prefixes, late and final rows, rows that never arrived, and snapshots at progress points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwise.plans.rules import matched


class DotReused(RuntimeError):
    """A dot came back with another payload."""


def once(received: DataFrame, dot: tuple[str, ...], seen: DataFrame | None = None) -> DataFrame:
    """Each dot's payload once, however often it was delivered, and not if ``seen`` (dots and payloads) has it."""
    distinct = received.distinct()
    known = distinct if seen is None else distinct.unionByName(seen.select(*received.columns)).distinct()
    twice = known.groupBy(*dot).count().where("count > 1").limit(1).collect()
    if twice:
        raise DotReused(str(twice[0].asDict()))
    return distinct if seen is None else matched(distinct, seen.select(*dot), list(dot), "left_anti")


def prefix(received: DataFrame, producer: tuple[str, ...], seq: str, start: int = 0) -> DataFrame:
    """Per producer the numbers from ``start`` up to the first gap, as (producer, upto): what a cumulative ack may name.

    Islands first: only their ends meet per producer, not the rows. A producer without ``start`` is absent.
    """
    return islands(received.where(F.col(seq) >= start), producer, seq).where(F.col("lo") == start).select(*producer, F.col("hi").alias("upto"))


def islands(rows: DataFrame, per: tuple[str, ...], value: str, bucket: int = 4096) -> DataFrame:
    """Whole numbers as disjoint, maximal [lo, hi] intervals per group.

    First within slices of ``bucket`` numbers, then over the slices' intervals, so a large group is spread over tasks.
    """
    inner = W.partitionBy(*per, "__slice").orderBy(value)
    numbered = rows.select(*per, value).distinct().withColumn("__slice", F.floor(F.col(value) / bucket)).withColumn("__run", F.col(value) - F.row_number().over(inner))
    runs = numbered.groupBy(*per, "__slice", "__run").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).drop("__slice", "__run")
    return merge_intervals(runs, per)


def merge_intervals(intervals: DataFrame, per: tuple[str, ...], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Overlapping or touching [lo, hi] intervals of whole numbers as their unions."""
    order = W.partitionBy(*per).orderBy(lo, hi)
    reached = F.max(hi).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = intervals.withColumn("__new", F.when(F.col(lo) <= reached + 1, 0).otherwise(1))
    grouped = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return grouped.groupBy(*per, "__island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__island")


def late(received: DataFrame, seals: DataFrame, key: tuple[str, ...], tick: str, sealed_at: str) -> DataFrame:
    """Rows that came after their key was sealed: violations to report, never dropped silently."""
    return matched(received, seals.select(*key, sealed_at), list(key), "inner").where(F.col(tick) > F.col(sealed_at)).drop(sealed_at)


def with_finality(rows: DataFrame, complete: DataFrame, key: tuple[str, ...], monotone: bool = False) -> DataFrame:
    """``rows`` with ``final``: whether nothing to come can take the row back, as its key is sealed or its view only grows."""
    if monotone:
        return rows.withColumn("final", F.lit(True))
    marks = complete.select(*key).distinct().withColumn("final", F.lit(True))
    return matched(rows, marks, list(key), "left").withColumn("final", F.coalesce("final", F.lit(False)))


def deliver(sent: DataFrame, omissions: DataFrame | None = None, crashes: DataFrame | None = None) -> DataFrame:
    """Messages (src, dst, tick, ...) as they arrive one tick on, under a schedule of faults.

    ``omissions`` (src, dst, tick) lose a message; ``crashes`` (node, tick) stop a node from that tick: it sends nothing from
    then on and gets nothing from then on. A node's messages to itself are not lost. More columns that both sides have, such
    as a schedule's id, must agree, so many schedules run as one batch.
    """
    got = sent
    if omissions is not None:
        remote = got.where("src <> dst").join(omissions, omissions.columns, "left_anti")
        got = remote.unionByName(got.where("src = dst"))
    if crashes is not None:
        shared = [c for c in crashes.columns if c in sent.columns and c != "tick"]
        for end, off in (("src", 0), ("dst", 1)):
            down = crashes.groupBy("node", *shared).agg(F.min("tick").alias("__down")).withColumnRenamed("node", end)
            got = got.join(down, [end, *shared], "left").where(F.col("__down").isNull() | (F.col("tick") + off < F.col("__down"))).drop("__down")
    return got.withColumn("tick", F.col("tick") + 1).select(*sent.columns)


def snapshots(rows: DataFrame, progress: str, points: list[int]) -> DataFrame:
    """A running result published at each progress point: the rows so far, once per point at or after them."""
    at = F.filter(F.array(*[F.lit(p) for p in sorted(points)]), lambda p: p >= F.col(progress))
    return rows.withColumn("point", F.explode(at))


def snapshot_totals(rows: DataFrame, progress: str, points: list[int], aggregates: dict[str, Column], totals: dict[str, Column]) -> DataFrame:
    """Aggregates of the rows up to each progress point, one row a point, without repeating a row.

    Rows are aggregated once between the points; ``totals`` joins these parts, a row a point, over all up to each.
    """
    at = F.array_min(F.filter(F.array(*[F.lit(p) for p in sorted(points)]), lambda p: p >= F.col(progress)))
    parts = rows.withColumn("__at", at).where("__at is not null").groupBy("__at").agg(*[c.alias(name) for name, c in aggregates.items()])
    wanted = rows.sparkSession.createDataFrame([(int(p),) for p in points], "point long")
    return wanted.join(parts, F.col("__at") <= F.col("point")).groupBy("point").agg(*[c.alias(name) for name, c in totals.items()])


def undelivered(sent: DataFrame, got: DataFrame, dot: tuple[str, ...]) -> DataFrame:
    """What was sent and has not arrived, to be sent again: an anti-join on the dots."""
    return matched(sent, got.select(*dot).distinct(), list(dot), "left_anti")
