"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.plans.shared import Shared

#: Edges that one task takes; a graph of no more meets in one, and its rounds shuffle nothing.
TASK = 50_000


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _dealt(edges: DataFrame, n: int) -> DataFrame:
    """The edges, of which there are about ``n``, where they lie or, if one task can take them, in one partition."""
    return edges if n > TASK else edges.coalesce(1)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round hangs a node's larger neighbours on its smallest one, then flattens what it points at, so
    edges never multiply and the rounds grow with the logarithm of the longest chain. Minima pre-aggregate
    before the shuffle; the join back to a node with very many edges is left to skew splitting. Rounds over
    TASK edges or fewer run in a task each: dealt out, each of their many files and tasks would hold a few rows.
    Loops, repeated edges and null ends are ignored; no edges give no rows. Raises past ``max_rounds``.
    """
    clean = edges.where("a is not null and b is not null and a <> b")
    now = Shared(clean.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = _state(now.df)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.df.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.df.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        both = _dealt(both, seen[0])
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        held = Shared(large)
        down = _dealt(held.df, seen[0])
        low = down.groupBy("hi").agg(F.min("lo").alias("m"))
        small = down.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        following = Shared(_dealt(small.unionByName(low.select("hi", F.col("m").alias("lo"))), seen[0]).distinct())
        held.drop()
        now.drop()
        now, before = following, seen
        seen = _state(now.df)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return now.df.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
