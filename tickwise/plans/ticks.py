"""Tick by tick: state that carries over, and inserts, deletes and upserts that take effect at the next tick.

A tick writes only what it changes. A table is its last full copy and the changes since, put together when it is read: the
latest change to a row (or key) counts. Now and then the changes are written into a new full copy.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .rules import lattice_join, matched
from .shared import Shared

#: Changes that pile up before a table is written in full.
COMPACT = 8
#: What wins in one tick: an insert over an upsert, that over a delete, that over a row that is not kept.
_KEPT, _DELETE, _UPSERT, _INSERT = range(4)


class KeyConflict(RuntimeError):
    """Two rows with one key in one tick, or two upserts of one key that differ."""


class InvariantViolated(RuntimeError):
    """An invariant's violation rows were not empty."""


class NotWritable(RuntimeError):
    """A write that the table's kind does not allow: to a sealed table after its first tick, or a removal from a lattice."""


@dataclass(frozen=True)
class Table:
    """A table that persists: DDL of its columns, and its key if that is not all of them.

    ``lattice`` names columns that merge per key (column -> kind, as in Relation); such a table only grows, and without a
    key it is a cell. ``kind``: table; sealed (written in the first tick only); soft (rows live ``ttl`` after their last
    insert by the tick's ``now``, and of those the ``most`` youngest); zset (the column ``weight`` adds up, zero drops out)
    and bag (the same, never below zero). ``resolve`` picks, per key, one of the carried and staged rows: a function
    of a DataFrame of the table's columns and ``staged``, which tells the two apart.
    """

    name: str
    ddl: str
    key: tuple[str, ...] = ()
    lattice: dict[str, Any] = field(default_factory=dict)
    kind: str = "table"
    ttl: int | None = None
    most: int | None = None
    resolve: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Stored:
    """A table's rows: a full copy, the changes since, and what the last tick changed."""

    base: Shared | None = None
    changes: tuple[Shared, ...] = ()
    last: Shared | None = None


class View:
    """How a table of a kind is put together from its copy and changes."""

    def __init__(self, spec: Table, spark: SparkSession):
        self.spec, self.empty = spec, spark.createDataFrame([], spec.ddl)
        self.columns = self.empty.columns
        added = {"weight"} if spec.kind in ("zset", "bag") else set(spec.lattice)
        self.added = [c for c in self.columns if c in added]
        self.identity = list(spec.key) or [c for c in self.columns if c not in added]
        if spec.lattice and not spec.key:
            self.identity = [c for c in self.columns if c not in spec.lattice]

    def _marked(self, rows: DataFrame, live: bool, rank: int) -> DataFrame:
        return rows.select(*self.columns, F.lit(live).alias("__live"), F.lit(rank).cast("long").alias("__rank"))

    def change(self, rows: DataFrame, live: bool, tick: int, order: int) -> DataFrame:
        return self._marked(rows, live, 4 * tick + order)

    def rows(self, stored: Stored, only: DataFrame | None = None, now: int | None = None) -> DataFrame:
        """The table's rows, or those that agree with ``only`` on the columns that tell rows apart."""
        parts = ([self._marked(stored.base.df, True, -1) if "__rank" not in stored.base.df.columns else stored.base.df] if stored.base else []) + [x.df for x in stored.changes]
        if only is not None and self.identity:
            parts = [matched(p, only.select(*self.identity), self.identity, "left_semi") for p in parts]
        if not parts:
            return self.empty
        spec, both = self.spec, reduce(DataFrame.unionByName, parts)
        if spec.lattice:
            merged = both.groupBy(*self.identity) if self.identity else both.groupBy()
            out = merged.agg(*[lattice_join(kind)(F.col(c)).alias(c) for c, kind in spec.lattice.items()])
            return reduce(lambda x, c: x.where(F.col(c).isNotNull()), spec.lattice, out).select(*self.columns)
        if spec.kind in ("zset", "bag"):
            out = both.groupBy(*self.identity).agg(F.sum("weight").alias("weight")).where("weight > 0" if spec.kind == "bag" else "weight <> 0")
            return out.select(*self.columns)
        if spec.kind == "soft":
            born = both.groupBy(*self.columns).agg(F.max("__rank").alias("__born"))
            alive = born.where(F.lit(now) - F.col("__born") < spec.ttl) if spec.ttl is not None and now is not None else born
            if spec.most is not None:
                alive = alive.withColumn("__n", F.row_number().over(W.orderBy(F.col("__born").desc(), *[F.col(c).desc() for c in self.columns]))).where(F.col("__n") <= spec.most)
            return alive.select(*self.columns)
        if stored.base and len(parts) == 1:
            return parts[0].select(*self.columns)
        others = [c for c in self.columns if c not in self.identity]
        latest = both.groupBy(*self.identity).agg(F.max_by(F.struct("__live", *others), "__rank").alias("__x"))
        return latest.where("__x.__live").select(*self.identity, *[F.col(f"__x.`{c}`").alias(c) for c in others]).select(*self.columns)

    def compacted(self, stored: Stored, now: int | None) -> DataFrame:
        """What to write as a full copy; soft rows keep their births."""
        if self.spec.kind != "soft":
            return self.rows(stored)
        both = reduce(DataFrame.unionByName, ([stored.base.df] if stored.base else []) + [x.df for x in stored.changes])
        born = both.groupBy(*self.columns).agg(F.max("__rank").alias("__rank")).withColumn("__live", F.lit(True))
        return born.where(F.lit(now) - F.col("__rank") < self.spec.ttl) if self.spec.ttl is not None and now is not None else born


class Tables(dict):
    """The tables of a tick by name, put together when they are asked for."""

    def __init__(self, views: dict[str, View], stored: dict[str, Stored], now: int | None):
        super().__init__()
        self.views, self.stored, self.now = views, stored, now

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.views[name].rows(self.stored[name], now=self.now)
        return self[name]


@dataclass
class Tick:
    """What a step sees and what it stages. ``now`` is the tick's clock, as ``advance`` was told."""

    number: int
    tables: Tables
    before: Tables
    events: dict[str, DataFrame]
    now: int | None = None
    fresh: bool = False
    recovered: bool = False
    staged: dict[str, dict[str, list[DataFrame]]] = field(default_factory=dict)
    messages: list[tuple[str, int, DataFrame]] = field(default_factory=list)
    keep: dict[str, DataFrame] = field(default_factory=dict)

    def _stage(self, kind: str, table: str, rows: DataFrame) -> None:
        view = self.tables.views[table]
        if view.spec.kind == "sealed" and not (self.fresh and kind == "insert"):
            raise NotWritable(f"{table} is sealed: only inserts in the first tick write it")
        if kind != "insert" and (view.spec.lattice or view.spec.kind in ("zset", "bag")):
            raise NotWritable(f"{table} only takes inserts: its rows merge")
        self.staged.setdefault(table, {}).setdefault(kind, []).append(rows.select(*view.columns))

    def insert(self, table: str, rows: DataFrame) -> None:
        self._stage("insert", table, rows)

    def delete(self, table: str, rows: DataFrame) -> None:
        """Exact rows leave at the next tick, unless they are also inserted then."""
        self._stage("delete", table, rows)

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Replaces the rows of the same key at the next tick."""
        self._stage("upsert", table, rows)

    def keep_while(self, table: str, rows: DataFrame) -> None:
        """Only rows that agree with ``rows`` on its columns carry over."""
        if self.tables.views[table].spec.lattice:
            raise NotWritable(f"{table} only grows")
        self.keep[table] = rows

    def send(self, event: str, rows: DataFrame, delay: int = 1, to: str | None = None) -> None:
        """Delivers rows as an event ``delay`` ticks later. ``to`` names the column that holds each row's destination."""
        if to is not None:
            rows = rows.where(F.col(to).isNotNull())
        self.messages.append((event, self.number + max(1, delay), rows))

    def _touched(self, table: str) -> tuple[DataFrame, DataFrame]:
        """The rows of now and of before that the last tick may have changed."""
        view, last = self.tables.views[table], self.tables.stored[table].last
        if view.spec.kind == "soft" or not view.identity:
            return self.tables[table], self.before[table]
        if last is None:
            return view.empty, view.empty
        ids = last.df.select(*view.identity).distinct()
        return view.rows(self.tables.stored[table], ids), view.rows(self.before.stored[table], ids)

    def inserted(self, table: str) -> DataFrame:
        now, was = self._touched(table)
        return matched(now, was, now.columns, "left_anti")

    def deleted(self, table: str) -> DataFrame:
        now, was = self._touched(table)
        return matched(was, now, now.columns, "left_anti")

    def cell(self, table: str, column: str, bottom: Any = None) -> DataFrame:
        """One row with a cell's value, or ``bottom`` while nothing was merged into it."""
        return self.tables[table].agg(F.coalesce(F.first(column), F.lit(bottom)).alias(column))


def check(rows: DataFrame, what: str) -> None:
    """An invariant: raises if there is a violation row."""
    if not rows.isEmpty():
        raise InvariantViolated(f"{what}: {rows.limit(3).collect()}")


def _unique(rows: DataFrame, key: tuple[str, ...], what: str) -> None:
    twice = rows.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise KeyConflict(f"{what}: {twice[0].asDict()}")


class Ticks:
    """Runs ``step(tick)`` once per tick; each tick's changes are written to the shared folder, which cuts lineage.

    With a ``journal`` (a folder that outlives the session, as must spark.checkpoint.dir then) every tick also notes where its
    tables and waiting messages lie. A new Ticks over the same journal goes on after the last tick noted; ``recovered`` tells.
    A tick counts once its note is there: one cut off before that is run again from the same tables.
    """

    NOTE = "kind string, name string, at long, path string, schema string, batch long"

    def __init__(self, spark: SparkSession, tables: list[Table], step: Callable[[Tick], None], journal: str | None = None):
        self.spark, self.step, self.journal = spark, step, journal
        self.views = {t.name: View(t, spark) for t in tables}
        self.stored = {t.name: Stored() for t in tables}
        self.earlier, self.number, self.batch, self.now, self.fresh = dict(self.stored), 0, -1, None, True
        self.waiting: dict[int, list[tuple[str, Shared]]] = {}
        self.watchers: list[tuple[str, Callable[[int, DataFrame, DataFrame], None]]] = []
        self.recovered = journal is not None and self._recover()

    @property
    def state(self) -> Tables:
        return Tables(self.views, self.stored, self.now)

    @property
    def before(self) -> Tables:
        return Tables(self.views, self.earlier, self.now)

    def watch(self, table: str, sink: Callable[[int, DataFrame, DataFrame], None]) -> None:
        """After every tick, ``sink`` gets the next tick's number and the rows that the table gained and lost."""
        self.watchers.append((table, sink))

    def view(self) -> Tick:
        """What the next tick's step will see of the tables, without events."""
        return Tick(self.number, self.state, self.before, {}, self.now)

    def _write(self, rows: DataFrame) -> Shared:
        return Shared(rows, keep=self.journal is not None)

    def advance(self, events: dict[str, DataFrame] | None = None, batch: int | None = None, now: int | None = None) -> Tables:
        """One tick over the carried tables and the events, at the clock ``now`` (the tick's number if not given); returns the tables of the next one."""
        got: dict[str, list[DataFrame]] = {k: [v] for k, v in (events or {}).items()}
        for name, held in self.waiting.pop(self.number, []):
            got.setdefault(name, []).append(held.df)
        self.now = self.number if now is None else now
        tick = Tick(self.number, self.state, self.before, {k: reduce(DataFrame.unionByName, v).distinct() for k, v in got.items()}, self.now, self.number == 0, self.recovered and self.fresh)
        self.step(tick)
        following = {name: self._next(name, tick) for name in self.views}
        for event, at, rows in tick.messages:
            self.waiting.setdefault(at, []).append((event, self._write(rows.distinct())))
        self.earlier, self.stored, self.fresh = self.stored, following, False
        self.number += 1
        self.batch = self.batch if batch is None else batch
        if self.journal is not None:
            self._note()
        for table, sink in self.watchers:
            seen = self.view()
            sink(self.number, seen.inserted(table), seen.deleted(table))
        return self.state

    def _note(self) -> None:
        rows = [(f"{when} {part}", name, i, x.path, x.df.schema.json(), self.batch) for when, tables in (("table", self.stored), ("before", self.earlier)) for name, s in tables.items() for part, held in (("base", [s.base] if s.base else []), ("change", s.changes), ("last", [s.last] if s.last else [])) for i, x in enumerate(held)]
        rows += [("message", name, at, x.path, x.df.schema.json(), self.batch) for at, held in self.waiting.items() for name, x in held]
        rows.append(("clock", "", -1 if self.now is None else self.now, "", "", self.batch))
        self.spark.createDataFrame(rows, self.NOTE).coalesce(1).write.mode("overwrite").parquet(f"{self.journal}/tick={self.number}")

    def _recover(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.journal)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return False
        notes = self.spark.read.schema(f"{self.NOTE}, tick int").parquet(self.journal)
        last = notes.agg({"tick": "max"}).first()[0]
        if last is None:
            return False
        self.number = last
        for r in sorted(notes.where(f"tick = {last}").collect(), key=lambda r: (r["kind"], r["name"], r["at"])):
            self.batch = r["batch"]
            when, _, part = r["kind"].partition(" ")
            if when == "clock":
                self.now = None if r["at"] < 0 else r["at"]
                continue
            held = Shared.at(self.spark, r["path"], StructType.fromJson(json.loads(r["schema"])))
            if when == "message":
                self.waiting.setdefault(r["at"], []).append((r["name"], held))
                continue
            tables = self.stored if when == "table" else self.earlier
            s = tables[r["name"]]
            tables[r["name"]] = replace(s, changes=(*s.changes, held)) if part == "change" else replace(s, **{part: held})
        return True

    def _next(self, name: str, tick: Tick) -> Stored:
        """The table at the next tick: the same with this tick's changes, if there are any."""
        view, now, staged = self.views[name], self.stored[name], tick.staged.get(name, {})
        if not staged and name not in tick.keep:
            return replace(now, last=None)
        written = self._write(self._changes(view, now, name, tick, staged))
        if written.df.isEmpty():
            return replace(now, last=None)
        if view.spec.key and not view.spec.lattice and view.spec.kind in ("table", "sealed"):
            self._check(view, now, name, written.df, "upsert" in staged, "insert" in staged)
        if len(now.changes) + 1 < COMPACT:
            return Stored(now.base, (*now.changes, written), written)
        full = self._write(view.compacted(Stored(now.base, (*now.changes, written)), tick.now))
        return Stored(full, (), written)

    def _changes(self, view: View, now: Stored, name: str, tick: Tick, staged: dict[str, list[DataFrame]]) -> DataFrame:
        """The rows that this tick changes, each with whether it lives and what it outranks."""
        spec = view.spec
        union = lambda kind: reduce(DataFrame.unionByName, staged[kind])
        if spec.lattice or spec.kind in ("zset", "bag"):
            return view.change(union("insert"), True, tick.number, _INSERT)
        if spec.kind == "soft":
            return view._marked(union("insert").distinct(), True, tick.now)
        out = []
        if name in tick.keep:
            out.append(view.change(matched(tick.tables[name], tick.keep[name], tick.keep[name].columns, "left_anti"), False, tick.number, _KEPT))
        if "delete" in staged:
            gone = union("delete").distinct()
            if spec.key:
                gone = matched(view.rows(now, gone), gone, view.columns, "left_semi")
            out.append(view.change(gone, False, tick.number, _DELETE))
        puts = [(kind, union(kind).distinct()) for kind in ("upsert", "insert") if kind in staged]
        if spec.key and spec.resolve is not None and puts:
            come = Shared(reduce(DataFrame.unionByName, [rows for _, rows in puts]).distinct()).df
            both = view.rows(now, come).withColumn("staged", F.lit(False)).unionByName(come.withColumn("staged", F.lit(True)))
            puts = [("insert", spec.resolve(both).select(*view.columns))]
        for kind, rows in puts:
            out.append(view.change(rows, True, tick.number, _UPSERT if kind == "upsert" else _INSERT))
        return reduce(DataFrame.unionByName, out)

    def _check(self, view: View, now: Stored, name: str, changes: DataFrame, upserts: bool, inserts: bool) -> None:
        """Raises if two rows would have one key: staged ones that differ, or an insert next to another row that stays."""
        key, come = view.spec.key, changes.where("__live").select(*view.columns)
        if not (upserts or inserts):
            return
        _unique(come.distinct(), key, f"conflicting upserts of {name}" if upserts else f"two rows of {name} with one key")
        if inserts and view.spec.resolve is None and (now.base or now.changes):
            fresh = changes.where(F.col("__live") & (F.pmod("__rank", F.lit(4)) == _INSERT)).select(*view.columns)
            gone = changes.where(~F.col("__live") | (F.pmod("__rank", F.lit(4)) == _UPSERT)).select(*key)
            held = matched(view.rows(now, fresh), gone, list(key), "left_anti")
            _unique(held.unionByName(fresh).distinct(), key, f"two rows of {name} with one key")

    def run(self, script: Iterable[dict[str, DataFrame]], ticks: int | None = None) -> Tables:
        """Feeds a script of events, a dict per tick, then empty ticks up to ``ticks``."""
        for events in script:
            self.advance(events)
        while ticks is not None and self.number < ticks:
            self.advance()
        return self.state


__all__ = ["InvariantViolated", "KeyConflict", "NotWritable", "Stored", "Table", "Tick", "Ticks", "View", "check"]
