"""Lattices of one's own: a merge, and the laws it must obey, tested on rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lattice:
    """``merge`` is an aggregate that gives the join of a column's values; nulls, the bottom, must take no part.

    Usable wherever a kind's name is: in a Relation's or Table's ``lattice`` and in a Fold.
    """

    name: str
    merge: Callable[[Column], Column]


def broken_laws(lattice: Lattice, values: DataFrame, column: str) -> DataFrame:
    """(law, a, b, c): triples of the values, as text, for which the merge is not idempotent, commutative or associative.

    Values are few, as in a property test: all triples of them are tried.
    """
    one = values.select(F.col(column)).where(F.col(column).isNotNull()).distinct()
    triples = one.select(F.col(column).alias("a")).crossJoin(one.select(F.col(column).alias("b"))).crossJoin(one.select(F.col(column).alias("c")))
    numbered = triples.withColumn("t", F.xxhash64(*[F.col(x).cast("string") for x in "abc"]))

    def merged(*names: str) -> DataFrame:
        """Per triple the merge of the named values, in that order of rows."""
        rows = numbered.select("a", "b", "c", F.posexplode(F.array(*names)).alias("i", "v"))
        return rows.groupBy("a", "b", "c").agg(lattice.merge(F.col("v")).alias("m"))

    def twice(first: tuple[str, str], last: str) -> DataFrame:
        inner = merged(*first).withColumnRenamed("m", "x")
        return inner.select("a", "b", "c", F.explode(F.array("x", last)).alias("v")).groupBy("a", "b", "c").agg(lattice.merge(F.col("v")).alias("m"))

    def differ(law: str, left: DataFrame, right: DataFrame) -> DataFrame:
        both = left.join(right.withColumnRenamed("m", "n"), ["a", "b", "c"]).where(~F.col("m").eqNullSafe(F.col("n")))
        return both.select(F.lit(law).alias("law"), *[F.col(x).cast("string").alias(x) for x in "abc"])

    same = numbered.select("a", "b", "c", F.col("a").alias("m"))
    found = differ("idempotent", merged("a", "a"), same)
    found = found.unionByName(differ("commutative", merged("a", "b"), merged("b", "a")))
    return found.unionByName(differ("associative", twice(("a", "b"), "c"), twice(("b", "c"), "a")))
