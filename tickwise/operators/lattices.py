"""Lattices beyond one column per key: bags, lexicographic pairs, undominated sets, classes, tombstones, dots.

A value is kept as rows, one per element, so merging is an aggregate or an anti-join and no group has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwise.plans.fixpoint import NotConverged
from tickwise.plans.rules import matched
from tickwise.plans.shared import Shared

#: Parts that a group is dealt over before its survivors meet in one place.
SALTS = 64


def bag_join(rows: DataFrame, count: str) -> DataFrame:
    """LBag: each element's largest multiplicity; those below one are absent."""
    others = [c for c in rows.columns if c != count]
    return rows.groupBy(*others).agg(F.max(count).alias(count)).where(F.col(count) > 0).select(*rows.columns)


def bag_sum(rows: DataFrame, count: str) -> DataFrame:
    """a + b on bags: multiplicities add."""
    others = [c for c in rows.columns if c != count]
    return rows.groupBy(*others).agg(F.sum(count).alias(count)).where(F.col(count) > 0).select(*rows.columns)


def lex_join(rows: DataFrame, key: tuple[str, ...], rank: str, merge: dict[str, Column]) -> DataFrame:
    """Lex: per key the highest rank, and the join of the values that have it. One aggregate finds the rank, an equi-join the rest."""
    highest = rows.groupBy(*key).agg(F.max(rank).alias(rank))
    return matched(rows, highest, [*key, rank], "left_semi").groupBy(*key, rank).agg(*[c.alias(name) for name, c in merge.items()])


def undominated(rows: DataFrame, key: tuple[str, ...], first: str, second: str) -> DataFrame:
    """LDom of two-component versions: rows that no other row of the key reaches in both components and passes in one.

    Sorted by the first component downwards, a row stays if its second is above all those before. Parts of a group are
    cut down before the rest meet, so a large group is not sorted in one task. Null components take no part.
    """

    def skyline(part: DataFrame, *by: str) -> DataFrame:
        seen = W.partitionBy(*key, *by).orderBy(F.col(first).desc()).rowsBetween(W.unboundedPreceding, -1)
        best = part.withColumn("__before", F.max(second).over(seen))
        return best.where(F.col("__before").isNull() | (F.col(second) > F.col("__before"))).drop("__before")

    tops = rows.groupBy(*key, first).agg(F.max(second).alias(second)).where(F.col(first).isNotNull() & F.col(second).isNotNull())
    dealt = tops.withColumn("__salt", F.pmod(F.xxhash64(first), F.lit(SALTS)))
    kept = skyline(skyline(dealt, "__salt").drop("__salt"))
    return rows.join(kept, [*key, first, second], "left_semi")


def classes(links: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """LUnionFind: (element, class), the class named by its least element.

    Rounds of large stars and small stars: each links an element's neighbours to the least of them, so a path's length halves
    about every round. A round is two aggregates over the links and is written to the shared folder.
    """
    both = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    edges = Shared(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rounds = 0
    while True:
        proper = edges.df.where("a > b")
        around = proper.unionByName(proper.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        grown = Shared(large)
        low = grown.df.groupBy("a").agg(F.min("b").alias("m"))
        small = grown.df.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a > b").distinct()
        following = Shared(small)
        same = following.df.subtract(proper).isEmpty() and proper.subtract(following.df).isEmpty()
        grown.drop()
        if same:
            break
        rounds += 1
        if rounds > max_rounds:
            raise NotConverged(f"classes still changed after {max_rounds} rounds")
        edges = following
    members = both.select(F.col("a").alias("element")).unionByName(both.select(F.col("b").alias("element"))).distinct()
    roots = following.df.select(F.col("a").alias("element"), F.col("b").alias("class"))
    return members.join(roots, "element", "left").withColumn("class", F.coalesce("class", "element"))


def live(adds: DataFrame, tombs: DataFrame) -> DataFrame:
    """LTombSet: what was added and never removed. A tombstone wins whenever it comes; both sides only grow."""
    return matched(adds.distinct(), tombs.select(*adds.columns), adds.columns, "left_anti")


def observed_remove(adds: DataFrame, removes: DataFrame, dot: tuple[str, ...]) -> DataFrame:
    """A causal set of dots: an element lives while one of its dots was removed by nobody. ``removes`` holds dots."""
    elements = [c for c in adds.columns if c not in dot]
    return matched(adds, removes.select(*dot).distinct(), list(dot), "left_anti").select(*elements).distinct()


def conflicts(rows: DataFrame, key: tuple[str, ...], value: str) -> DataFrame:
    """LConflict: (key, value, is_top); two different values give top, whose value is null."""
    low, high = F.min(value), F.max(value)
    return rows.where(F.col(value).isNotNull()).groupBy(*key).agg(F.when(low == high, low).alias(value), (low != high).alias("is_top"))


def vector_join(rows: DataFrame, key: tuple[str, ...], value: str, place: str = "place") -> DataFrame:
    """LVec of maxima: (key, place, value), place by place; the longer vector wins where the other ends."""
    return rows.select(*key, F.posexplode(value).alias(place, value)).groupBy(*key, place).agg(F.max(value).alias(value))


__all__ = ["bag_join", "bag_sum", "classes", "conflicts", "lex_join", "live", "observed_remove", "undominated", "vector_join"]
