"""Transitive closures by classes: vertices that reach each other stand for one another, so a dense graph's recursion stays small.

Two vertices with an edge each way are of one class, and so are two classes. The recursion runs over classes, and the pairs
of vertices are spread from pairs of classes, each once, without a shuffle of the pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, StringType, TimestampNTZType, TimestampType

from tickwise.operators.lattices import classes
from tickwise.plans.fixpoint import evaluate
from tickwise.plans.rules import Atom, Relation, Rule, matched
from tickwise.plans.shared import Shared

#: Targets of a class in one block, its sources in one row that meets it, about, and copies of a block that share the rows.
SHARE, ROW, COPIES = 2048, 32, 8
_EDGE, _REACH = Atom("edge", ("x", "y")), Relation("reach", ("x", "y"))
_RULES = [Rule("reach", ("x", "y"), (_EDGE,)), Rule("reach", ("x", "z"), (Atom("reach", ("x", "y")), Atom("edge", ("y", "z"))))]


def quotient(edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(element, class) of all vertices and the edges between classes, named as before; none if no edge goes both ways."""
    x, y = edges.columns
    kind = edges.schema[x].dataType
    if kind != edges.schema[y].dataType or not isinstance(kind, (IntegralType, StringType, DateType, TimestampType, TimestampNTZType)):
        return None
    held, members = Shared(edges.select(F.col(x).alias("x"), F.col(y).alias("y")).distinct()), None
    while True:
        back = held.df.select(F.col("y").alias("x"), F.col("x").alias("y"))
        mutual = Shared(held.df.where("x < y").join(back, ["x", "y"], "left_semi"))
        if mutual.df.isEmpty():
            break
        found = Shared(classes(mutual.df, "x", "y")).df
        of = lambda rows, c: rows.join(found.select(F.col("element").alias(c), F.col("class").alias("__c")), c, "left").withColumn(c, F.coalesce("__c", c)).drop("__c")
        if members is None:
            members = held.df.select("x").unionByName(back.select("x")).distinct().select(F.col("x").alias("element"), F.col("x").alias("class"))
        members = Shared(of(members, "class")).df
        held = Shared(of(of(held.df, "x"), "y").select("x", "y").distinct())
    return None if members is None else (members, held.df.select(F.col("x").alias(x), F.col("y").alias(y)))


def _blocks(rows: DataFrame, value: str, key: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(key, blocks) and (key, block, values): the values of a key dealt over blocks of about ``size``, an array each."""
    counts = rows.groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias(f"{key}_blocks"))
    dealt = rows.join(counts, key).withColumn(f"{key}_block", F.pmod(F.xxhash64(value), F.col(f"{key}_blocks").cast("bigint")).cast("int"))
    held = dealt.groupBy(key, f"{key}_block").agg(F.collect_list(F.struct(value))[value].alias(value))  # a bare list drops nulls
    return counts, held


def spread(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(x, y) for each pair (a, b), source (x, a) and target (y, b), where a and b are structs, in which nulls are equal.

    A few sources at a time meet each block of the class's targets, and copies of the blocks are dealt over all tasks. Rows that are
    exploded look as small to the planner as what they come from, so it is told not to broadcast them.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (left_counts, left), (right_counts, right) = _blocks(sources, "x", "a", ROW), _blocks(targets, "y", "b", SHARE)
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(f"{c}_blocks") - 1)).alias(f"{c}_block")
    rows = pairs.join(left_counts, "a").join(right_counts, "b").select("a", "b", "b_blocks", numbers("a")).hint("merge")
    key = ["b", "b_block", "copy"]
    met = rows.join(left, ["a", "a_block"]).select("b", "x", F.pmod("a_block", F.lit(COPIES)).alias("copy"), numbers("b")).repartition(parts, *key).hint("merge")
    both = met.join(right.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).repartition(parts, *key), key)
    return both.select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y"))


def _keyed(members: DataFrame, element: str, key: str, *by: str) -> DataFrame:
    return members.select(F.col("element").alias(element), F.struct(*by).alias(key))


def _paired(reach: DataFrame) -> DataFrame:
    a, b = reach.columns
    return reach.select(F.struct(F.col(a).alias("class")).alias("a"), F.struct(F.col(b).alias("class")).alias("b"))


def expanded(reach: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of vertices from pairs of classes."""
    a, b = reach.columns
    return spread(_paired(reach), _keyed(members, "x", "a", "class"), _keyed(members, "y", "b", "class")).select(F.col("x").alias(a), F.col("y").alias(b))


def met(reach: DataFrame, members: DataFrame, ends: tuple[str, str], rows: DataFrame) -> DataFrame:
    """The closure's pairs, named ``ends``, joined with ``rows`` on the one end that they hold: rows meet classes, and pairs of vertices no shuffle."""
    start, end = ends
    last = end in rows.columns
    of = members.select(F.col("element").alias(end if last else start), F.col("class").alias("__class"))
    side = matched(rows, of, [end if last else start], "inner").select(F.struct(*rows.columns).alias("y" if last else "x"), F.struct(F.col("__class").alias("class")).alias("b" if last else "a"))
    if last:
        return spread(_paired(reach), _keyed(members, "x", "a", "class"), side).select(F.col("x").alias(start), "y.*")
    return spread(_paired(reach), side, _keyed(members, "y", "b", "class")).select("x.*", F.col("y").alias(end))


class Closure:
    """The closure of edges (x, y) without nulls as pairs of classes, ``reach`` (x, y), and which class each vertex is of, ``members``."""

    def __init__(self, edges: DataFrame):
        edges = edges.select("x", "y")
        found = quotient(edges)
        if found is None:
            members = edges.select("x").unionByName(edges.select(F.col("y").alias("x"))).distinct()
            found = members.select(F.col("x").alias("element"), F.col("x").alias("class")), edges
        self.members, self.reach = found[0], Shared(evaluate(_RULES, [_REACH], {"edge": found[1]})["reach"]).df

    def unreached(self, nodes: DataFrame) -> DataFrame:
        """(x, y) of ``nodes``, one column without nulls, where x does not reach y.

        Nodes that reach nothing are one class of sources, those that nothing reaches one of targets, so classes are paired, not nodes.
        """
        placed = nodes.select(F.col(nodes.columns[0]).alias("element")).distinct().join(self.members, "element", "left")
        side = lambda c: self.reach.select(F.col(c).alias("class")).distinct().withColumn("met", F.lit(True))
        of = lambda c: Shared(placed.join(side(c), "class", "left").select("element", F.when(F.col("met"), F.col("class")).alias("class"))).df
        sources, targets = _keyed(of("x"), "x", "a", "class"), _keyed(of("y"), "y", "b", "class")
        held = self.reach.select(F.struct(F.col("x").alias("class")).alias("a"), F.struct(F.col("y").alias("class")).alias("b"))
        pairs = sources.select("a").distinct().crossJoin(targets.select("b").distinct()).join(held, ["a", "b"], "left_anti")
        return spread(Shared(pairs).df, sources, targets)

    def lost(self, after: Closure) -> DataFrame:
        """Pairs (x, y) of this closure that ``after``, over some of the edges, has not. Vertices of one class in both are told apart by neither."""
        both = self.members.join(after.members.select("element", F.col("class").alias("after"), F.lit(True).alias("stays")), "element", "left")
        both = Shared(both).df
        kinds = both.select("class", "after", "stays").distinct()

        def of(reach: DataFrame, by: str, which: DataFrame) -> DataFrame:
            side = lambda c: which.select(F.col(by).alias(c), F.struct("class", "after", "stays").alias("a" if c == "x" else "b"))
            return reach.join(side("x"), "x").join(side("y"), "y").select("a", "b")

        gone = Shared(of(self.reach, "class", kinds).join(of(after.reach, "after", kinds.where("stays")), ["a", "b"], "left_anti")).df
        key = ("class", "after", "stays")
        return spread(gone, _keyed(both, "x", "a", *key), _keyed(both, "y", "b", *key))


__all__ = ["Closure", "expanded", "met", "quotient", "spread"]
