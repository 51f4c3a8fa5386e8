"""Choice under several functional dependencies at once: greedy, in order of priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.plans.fixpoint import NotConverged
from tickwise.plans.shared import Shared

from .choice import index


def _agree(a: DataFrame, b: DataFrame, key: tuple[str, ...], how: str) -> DataFrame:
    """``a`` joined with ``b`` on equal keys, where a null equals a null; b's key columns drop out."""
    other = b.select(*[F.col(c).alias(f"__of_{c}") if c in key else F.col(c) for c in b.columns])
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in key])
    return a.join(other, on, how).drop(*[f"__of_{c}" for c in key])


def choose_all(rows: DataFrame, keys: list[tuple[str, ...]], by: list[Column], max_rounds: int = 200) -> DataFrame:
    """What a scan in order would take: a row is taken unless a row taken before has its value of one of ``keys``.

    No scan is needed: a row that comes first for each of its keys must be taken, and rows that share a key with it cannot be.
    Every round takes all such rows at once and drops their rivals. The first row left is always among them, so rounds end;
    their number is the longest chain of rivals. Ties go to the canonical order of the row, and a null is a value like others.
    """
    left, taken, rounds = Shared(index(rows, by, "__p")), [], 0
    while True:
        marked = left.df
        for i, key in enumerate(keys):
            least = left.df.groupBy(*key).agg(F.min("__p").alias(f"__least{i}"))
            marked = _agree(marked, least, key, "inner").where(F.col("__p") == F.col(f"__least{i}")).drop(f"__least{i}")
        first = Shared(marked)
        if first.df.isEmpty():
            break
        taken.append(first.df.select(*rows.columns))
        rounds += 1
        if rounds > max_rounds:
            raise NotConverged(f"choice still had candidates after {max_rounds} rounds")
        rest = left.df
        for key in keys:
            rest = _agree(rest, first.df.select(*key), key, "left_anti")
        left = Shared(rest)
    return reduce(DataFrame.unionByName, taken) if taken else rows.limit(0)
