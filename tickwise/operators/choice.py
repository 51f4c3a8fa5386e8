"""Choice, numbering and ordered folds. Ties go to the canonical order of the whole row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tickwise.plans.rules import matched

from .parts import carried, dealt


def _order(rows: DataFrame, by: list[Column]) -> list[Column]:
    return [*by, *[F.col(c).asc_nulls_first() for c in rows.columns]]


def arg_best(rows: DataFrame, per: tuple[str, ...], cost: Column, largest: bool = False) -> DataFrame:
    """All rows whose cost is the group's least (or largest): ties stay. An aggregate and a join, so groups aren't sorted."""
    best = (F.max if largest else F.min)(cost)
    if not per:
        return rows.join(rows.agg(best.alias("__best")), cost == F.col("__best")).drop("__best")
    return matched(rows, rows.groupBy(*per).agg(best.alias("__best")), list(per), "inner").where(cost == F.col("__best")).drop("__best")


def top(rows: DataFrame, k: int, per: tuple[str, ...], by: list[Column]) -> DataFrame:
    """The first k rows of each group in the order given; Spark keeps k rows a group before the shuffle."""
    n = F.row_number().over(W.partitionBy(*per).orderBy(*_order(rows, by)))
    return rows.withColumn("__n", n).where(F.col("__n") <= k).drop("__n")


def choose(rows: DataFrame, per: tuple[str, ...], seed: int = 0) -> DataFrame:
    """One row per group: least by a seeded hash of the row, so reruns agree and seeds differ."""
    return top(rows, 1, per, [F.xxhash64(F.lit(seed), *[F.col(c) for c in rows.columns])])


def choose_fresh(rows: DataFrame, per: tuple[str, ...], node: str, incarnation: int, tick: int, seed: int = 0) -> DataFrame:
    """One row per group, drawn anew for each node, incarnation and tick; the same draw gives the same row."""
    return top(rows, 1, per, [F.xxhash64(F.lit(seed), F.lit(node), F.lit(incarnation), F.lit(tick), *[F.col(c) for c in rows.columns])])


def prefer(writes: list[DataFrame], key: tuple[str, ...], unlisted: DataFrame | None = None) -> DataFrame:
    """Writer precedence: of the writes to a key those of the earliest writer listed. Those of a writer not listed stay.

    Survivors that still differ are the table's conflict to report.
    """
    ranked = reduce(DataFrame.unionByName, [w.withColumn("__rank", F.lit(i)) for i, w in enumerate(writes)])
    best = ranked.groupBy(*key).agg(F.min("__rank").alias("__rank"))
    kept = matched(ranked, best, [*key, "__rank"], "left_semi").drop("__rank").distinct()
    return kept if unlisted is None else kept.unionByName(unlisted).distinct()


def choose_best(rows: DataFrame, per: tuple[str, ...], cost: Column, most: bool = False) -> DataFrame:
    """One row per group of least (or most) cost, ties by the canonical order."""
    return top(rows, 1, per, [cost.desc() if most else cost.asc()])


def choose_sticky(rows: DataFrame, held: DataFrame, per: tuple[str, ...], by: list[Column]) -> DataFrame:
    """Last tick's choice while it is still a candidate, else the first in order. ``held`` has the columns of ``rows``."""
    still = matched(held.withColumn("__held", F.lit(1)), rows, rows.columns, "left_semi")
    marked = matched(rows, still, rows.columns, "left")
    n = F.row_number().over(W.partitionBy(*per).orderBy(F.col("__held").asc_nulls_last(), *_order(rows, by)))
    return marked.withColumn("__n", n).where("__n = 1").drop("__n", "__held")


def index(rows: DataFrame, by: list[Column], name: str = "index", per: tuple[str, ...] = ()) -> DataFrame:
    """Numbers the distinct rows from 0, in each group of ``per`` if given.

    A range sort deals the rows, so no group is numbered by one task: each part counts its rows of each group, and a part's
    numbers start where those of the group's earlier parts end. The dealt rows are written, so both passes see the same parts.
    """
    distinct = rows.distinct()
    order = [*[F.col(c).asc_nulls_first() for c in per], *_order(distinct, by)]
    placed = carried(dealt(distinct, order), per, F.count("*"), F.sum("__edge"), "__before")
    inside = F.row_number().over(W.partitionBy("__part", *per).orderBy(*order))
    return placed.select(*rows.columns, (F.coalesce("__before", F.lit(0)) + inside - 1).alias(name))


def number_new(rows: DataFrame, assigned: DataFrame, by: list[Column], name: str = "seq") -> DataFrame:
    """``assigned`` and numbers for the rows that have none yet, above all numbers ever given: stable, never reused."""
    fresh = index(matched(rows, assigned.select(*rows.columns), rows.columns, "left_anti"), by, "__i")
    most = assigned.agg(F.coalesce(F.max(name), F.lit(-1)).alias("__most"))
    given = fresh.crossJoin(most).withColumn(name, F.col("__most") + 1 + F.col("__i")).drop("__most", "__i")
    return assigned.unionByName(given.select(*assigned.columns))


def fold(rows: DataFrame, per: tuple[str, ...], by: list[str], init: Any, step: Callable[[Any, Any], Any], finish: Callable[[Any], dict], schema: str) -> DataFrame:
    """An ordered fold per group: ``step(state, row)`` over the group's rows in the order of ``by``, ties by the other columns.

    Rows stream past in order, so a task holds one state and no group. ``finish`` makes the columns of ``schema`` out of the
    last state. An order that any step may need is one group's in one task; for steps that combine use ``user_aggregate``.
    """
    others = [c for c in rows.columns if c not in per and c not in by]
    ordered = rows.repartition(*[F.col(c) for c in per]).sortWithinPartitions(*per, *by, *others)
    out = StructType([*rows.select(*per).schema, *rows.sparkSession.createDataFrame([], schema).schema])
    arrow, at = to_arrow_schema(out), [rows.columns.index(c) for c in per]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, some = None, init, False
        for b in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                key = tuple(row[i] for i in at)
                if not some or key != now:
                    if some:
                        done.append((*now, *finish(state).values()))
                    now, state, some = key, init, True
                state = step(state, dict(zip(b.schema.names, row)))
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(list(zip(*done)) or [()] * len(arrow), arrow)], schema=arrow)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((*now, *finish(state).values()), arrow)], schema=arrow)

    return ordered.mapInArrow(run, out)


def user_aggregate(rows: DataFrame, per: tuple[str, ...], init: Column, step, combine, finish, name: str, part_rows: int = 10_000, fan_in: int = 256) -> DataFrame:
    """A user's aggregate of init, step, combine and finish, for steps that may go in any order.

    Each group is dealt over parts of about ``part_rows`` rows and stepped there; the parts' states meet ``fan_in`` at a time,
    level by level, so no task holds more of a group than that, however large it is.
    """
    items = [c for c in rows.columns if c not in per]
    parts = max(1, -(-rows.count() // part_rows))
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(parts)))
    states = dealt.groupBy(*per, "__part").agg(F.aggregate(F.collect_list(F.struct(*items)), init, step).alias("__state"))
    while parts > 1:
        parts = -(-parts // fan_in)
        states = states.withColumn("__part", F.expr(f"__part div {fan_in}")).groupBy(*per, "__part").agg(F.aggregate(F.collect_list("__state"), init, combine).alias("__state"))
    return states.select(*per, finish(F.col("__state")).alias(name))


def estimate(rows: DataFrame, per: tuple[str, ...], value: Column, one_in: int, z: float = 1.96) -> DataFrame:
    """Online aggregates: (per, sampled, count, sum, avg, avg_error) from one row in ``one_in``, picked by a hash of the row.

    count and sum are scaled up from the sample; avg_error is half the width of the confidence interval of the mean at ``z``
    standard errors. The same rows are picked at every run, and a smaller ``one_in`` picks these and more.
    """
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in rows.columns]).cast("binary")), 1, 8), 16, 10).cast("bigint")
    picked = rows.withColumn("__v", value.cast("double")).where(drawn < (1 << 32) // one_in)
    agg = picked.groupBy(*per).agg(F.count("__v").alias("sampled"), F.sum("__v").alias("__s"), F.avg("__v").alias("avg"), F.stddev_samp("__v").alias("__d"))
    return agg.select(*per, "sampled", (F.col("sampled") * one_in).alias("count"), (F.col("__s") * one_in).alias("sum"), "avg", (F.lit(z) * F.col("__d") / F.sqrt("sampled")).alias("avg_error"))


def weights(rows: DataFrame, weight: str = "weight") -> DataFrame:
    """Z-set weights summed per row; zero drops out."""
    cols = [c for c in rows.columns if c != weight]
    return rows.groupBy(*cols).agg(F.sum(weight).alias(weight)).where(F.col(weight) != 0)


def alive(rows: DataFrame, born: str, now: Column, ttl: int, most: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Soft state: the latest birth of each row, younger than ``ttl``, and of those the ``most`` youngest per ``by``."""
    cols = [c for c in rows.columns if c != born]
    young = rows.groupBy(*cols).agg(F.max(born).alias(born)).where(now - F.col(born) < ttl)
    return young if most is None else top(young, most, by, [F.col(born).desc()])
