"""Timers as event rows (count, at): which firings a tick delivers, from its clock and the last tick's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fired(clocks: DataFrame, every: int, times: int | None = None, after: str = "last", now: str = "now", boot: str = "boot") -> DataFrame:
    """The firings that fall in (after, now] per row of ``clocks``: firing k is due at boot + (k + 1) * every.

    Several fall in one tick of a late node, and each counts. ``times`` ends the timer after that many; one-shot is times=1.
    The other columns of ``clocks`` (a node, a tick) come along. A row without a firing gives none.
    """
    if every <= 0 or (times is not None and times <= 0):
        raise ValueError("a period and a number of firings are positive")
    first = F.greatest(F.floor((F.col(after) - F.col(boot)) / every), F.lit(0))
    end = F.floor((F.col(now) - F.col(boot)) / every)
    end = end if times is None else F.least(end, F.lit(times))
    counts = F.when(end > first, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))
    others = [c for c in clocks.columns if c not in (after, now, boot)]
    return clocks.select(*others, boot, F.explode(counts).alias("count")).select(*others, "count", (F.col(boot) + (F.col("count") + 1) * every).alias("at"))


def fired_while(clocks: DataFrame, guard: DataFrame, on: tuple[str, ...], every: int, **names) -> DataFrame:
    """Firings of the ticks whose guard held at the end of the tick before; those missed meanwhile are skipped, not late."""
    return fired(clocks.join(guard.select(*on).distinct(), list(on), "left_semi"), every, **names)


def fired_ticks(ticks: DataFrame, every: int, tick: str = "tick", at: str = "now") -> DataFrame:
    """A logical timer: firing k in tick (k + 1) * every - 1 of the incarnation, whose first tick is 0."""
    if every <= 0:
        raise ValueError("a number of ticks is positive")
    due = ticks.where((F.col(tick) + 1) % every == 0)
    others = [c for c in ticks.columns if c != at]
    return due.select(*others, F.expr(f"({tick} + 1) div {every} - 1").alias("count"), F.col(at).alias("at"))
