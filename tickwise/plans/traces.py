"""Specs over traces: relations whose first columns are node and tick, read at points of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at(trace: DataFrame, tick: int, node: str | None = None) -> DataFrame:
    """The rows at one tick, of one node if named; both reach the scan as filters."""
    rows = trace.where(F.col("tick") == tick)
    return (rows if node is None else rows.where(F.col("node") == node)).drop("tick")


def ever(trace: DataFrame, upto: int | None = None) -> DataFrame:
    """(node, columns) that held at some tick, up to ``upto`` if given."""
    rows = trace if upto is None else trace.where(F.col("tick") <= upto)
    return rows.drop("tick").distinct()


def always(trace: DataFrame, first: int, last: int) -> DataFrame:
    """(node, columns) that held at every tick of first..last: counted, not checked tick by tick."""
    cols = [c for c in trace.columns if c != "tick"]
    return trace.where(F.col("tick").between(first, last)).distinct().groupBy(*cols).agg(F.count("*").alias("__n")).where(F.col("__n") == last - first + 1).drop("__n")


def spans(trace: DataFrame) -> DataFrame:
    """(node, columns, from_tick, to_tick): the maximal runs of ticks in which each row held."""
    from tickwise.streaming.channels import islands

    cols = tuple(c for c in trace.columns if c != "tick")
    return islands(trace, cols, "tick").withColumnRenamed("lo", "from_tick").withColumnRenamed("hi", "to_tick")


def quorum(votes: DataFrame, members: DataFrame, on: tuple[str, ...], voter: str = "node") -> DataFrame:
    """Keys for which more than half of ``members`` (their ``voter`` column) voted; others' votes don't count."""
    counted = votes.select(*on, voter).distinct().join(members.select(voter).distinct(), voter, "left_semi").groupBy(*on).agg(F.count("*").alias("__n"))
    size = members.select(voter).distinct().agg(F.count("*").alias("__size"))
    return counted.join(size, F.col("__n") * 2 > F.col("__size")).select(*on)


def agree(trace: DataFrame, key: tuple[str, ...], value: str) -> DataFrame:
    """Violations of agreement: keys for which two values were ever held, by whichever nodes and at whichever ticks."""
    return trace.groupBy(*key).agg(F.min(value).alias("least"), F.max(value).alias("most")).where("least <> most")


def caused(sent: DataFrame, got: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """(sender, receiver, on, sent_at, got_at) of messages: direct happens-before edges between nodes."""
    a = sent.select(F.col("node").alias("sender"), F.col("tick").alias("sent_at"), F.col("dst").alias("receiver"), *on)
    b = got.select(F.col("node").alias("receiver"), F.col("tick").alias("got_at"), *on)
    return a.join(b, ["receiver", *on]).where("got_at > sent_at").select("sender", "receiver", *on, "sent_at", "got_at")
