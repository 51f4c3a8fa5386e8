"""Stratified evaluation of rules: semi-naive for sets, merging per key for lattices.

Spark has no recursion with set semantics, so the driver loops. A round joins what the last round added, and shuffles only
what it derives: the rows known so far lie in hash buckets, where the derived ones meet them. Each round's new rows are
written to the shared folder, which cuts lineage and survives lost executors. A transitive closure goes over classes of
vertices that reach each other, so its rounds do not carry the pairs inside them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import Agg, Any_, Atom, Relation, Rule, alternatives, derived, lattice_join, simple
from .shared import Bucketed, Shared

#: Tables of one level that pile up before they are written as one of the next level.
COMPACT = 8


class NotConverged(RuntimeError):
    """A recursion was still changing after the allowed rounds; it is never cut short silently."""


class Unstratified(ValueError):
    """A head depends on itself through negation or aggregation; ``cycle`` names the heads on the way, the first again at the end."""

    def __init__(self, rel: str, head: str, cycle: list[str]):
        super().__init__(f"{head} depends on itself through negation or aggregation of {rel}: {' <- '.join(cycle)}")
        self.cycle = cycle


def _way(uses: dict[str, set[str]], start: str, goal: str) -> list[str]:
    """A shortest chain of uses from ``start`` to ``goal``."""
    ways = [[start]]
    seen = {start}
    for way in ways:
        if way[-1] == goal:
            return way
        for following in sorted(uses[way[-1]] - seen):
            seen.add(following)
            ways.append([*way, following])
    return [start, goal]


def strata(rules: list[Rule]) -> list[list[str]]:
    """Heads in groups that depend on each other, in the order to evaluate them; refuses negation inside a group."""
    heads = list(dict.fromkeys(r.head for r in rules))
    uses = {h: {rel for r in rules if r.head == h for rel, _ in r.reads() if rel in heads} for h in heads}
    reach = {h: set(uses[h]) for h in heads}
    for k in heads:
        for h in heads:
            if k in reach[h]:
                reach[h] |= reach[k]
    groups: list[list[str]] = []
    for h in heads:
        if not any(h in g for g in groups):
            groups.append([x for x in heads if x == h or (x in reach[h] and h in reach[x])])
    for r in rules:
        group = next(g for g in groups if r.head in g)
        for rel, negative in r.reads():
            if negative and rel in group:
                raise Unstratified(rel, r.head, [r.head, *_way(uses, rel, r.head)])
    out: list[list[str]] = []
    while groups:
        now = next(g for g in groups if not any(x in reach[g[0]] for other in groups if other is not g for x in other))
        groups.remove(now)
        out.append(now)
    return out


def points_of_order(rules: list[Rule]) -> list[tuple[str, str]]:
    """(head, relation) for each rule that must wait for a relation to be complete: what it negates, aggregates or looks up.

    A program without any is monotone: more input only adds rows.
    """
    return sorted({(r.head, rel) for r in rules for rel, negative in r.reads() if negative})


def merged(relation: Relation, rows: DataFrame) -> DataFrame:
    """One row per key: each lattice column is the join of all its values; values at the bottom (null) drop out."""
    cells = [lattice_join(kind)(F.col(c)).alias(c) for c, kind in relation.lattice.items()]
    out = rows.groupBy(*relation.key).agg(*cells) if relation.key else rows.agg(*cells)
    for c in relation.lattice:
        out = out.where(F.col(c).isNotNull())
    return out.select(*relation.columns)


class Known:
    """The rows of one head so far, and the way to tell which derived rows are new.

    A set's new rows are those that no bucket holds. A lattice's new rows are the cells that grew, so a key may lie in several
    tables, and what it is worth is the join of all. Tables are put together level by level, so a row is rewritten
    only a few times however many rounds there are.
    """

    def __init__(self, relation: Relation):
        self.relation = relation
        self.levels: list[list[Bucketed]] = [[]]
        self.rows = 0

    def _keyed(self, rows: DataFrame) -> DataFrame:
        key = self.relation.key
        return rows.select(F.struct(*(key or [F.lit(0).alias("__none")])).alias("__key"), *self.relation.lattice)

    def tables(self) -> list[Bucketed]:
        return [t for level in self.levels for t in level]

    def add(self, rows: DataFrame) -> DataFrame | None:
        """Writes what is new of ``rows`` and returns it; none if nothing is."""
        lattice = self.relation.lattice
        keyed = self._keyed(rows)
        if lattice:
            keyed = self._grown(keyed)
        else:
            keyed = keyed.distinct()
            for t in self.tables():
                keyed = keyed.join(t.df, "__key", "left_anti")
        fresh = Bucketed(keyed, self.rows)
        new = fresh.plain.count()
        if not new:
            fresh.drop()
            return None
        self.rows += new
        self.levels[0].append(fresh)
        self._compact()
        return self._shown(fresh.plain)

    def _grown(self, keyed: DataFrame) -> DataFrame:
        """The cells of ``keyed`` that are new or above those held, each joined with what is held."""
        cells = [(c, lattice_join(kind)) for c, kind in self.relation.lattice.items()]
        come = keyed.groupBy("__key").agg(*[f(F.col(c)).alias(c) for c, f in cells])
        for c, _ in cells:
            come = come.where(F.col(c).isNotNull())
        if not self.tables():
            return come
        come = Shared(come).df
        held = reduce(DataFrame.unionByName, [t.df.join(come.select("__key"), "__key", "left_semi") for t in self.tables()])
        both = held.withColumn("__held", F.lit(True)).unionByName(come.withColumn("__held", F.lit(False)))
        was = [f(F.when(F.col("__held"), F.col(c))).alias(f"__was_{c}") for c, f in cells]
        out = both.groupBy("__key").agg(*[f(F.col(c)).alias(c) for c, f in cells], *was)
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__was_{c}")) for c, _ in cells])
        return out.where(~same).select("__key", *self.relation.lattice)

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) >= COMPACT:
                rows = reduce(DataFrame.unionByName, [t.df for t in level])
                if self.relation.lattice:
                    rows = rows.groupBy("__key").agg(*[lattice_join(kind)(F.col(c)).alias(c) for c, kind in self.relation.lattice.items()])
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(Bucketed(rows, self.rows))
                for t in level:
                    t.forget()
                self.levels[i] = []

    def _shown(self, keyed: DataFrame) -> DataFrame:
        return keyed.select(*[F.col(f"__key.`{c}`").alias(c) for c in self.relation.key], *self.relation.lattice).select(*self.relation.columns)

    def whole(self) -> DataFrame:
        rows = self._shown(reduce(DataFrame.unionByName, [t.plain for t in self.tables()]))
        return merged(self.relation, rows) if self.relation.lattice else rows

    def close(self) -> None:
        for t in self.tables():
            t.forget()


def _expanded(rules: list[Rule]) -> list[Rule]:
    """Rules without patterns, and one for each choice of alternatives, so that a recursive atom is never inside one."""
    out = []
    for r in map(simple, rules):
        out += [r] if r.folds() else alternatives(r)
    return out


def evaluate(rules: list[Rule], relations: list[Relation], base: dict[str, DataFrame], max_rounds: int = 200, rounds: dict[str, list[int]] | None = None, closures: dict[str, tuple[DataFrame, DataFrame]] | None = None) -> dict[str, DataFrame]:
    """All heads' rows. ``base`` holds the relations that no rule derives; a base relation may also be a head.

    With ``rounds``, it takes for each head of a recursion the number of new rows of every round, the start included. With
    ``closures``, it takes for each head that was found by classes the pairs of classes and (element, class).
    """
    env = dict(base)
    by_name = {r.name: r for r in relations}
    rules = _expanded(rules)
    for group in strata(rules):
        own = [r for r in rules if r.head in group]
        recursive = any(rel in group for r in own for rel, _ in r.reads())
        if not recursive:
            for h in group:
                parts = [derived(r, by_name[h], env) for r in own if r.head == h]
                parts += [base[h]] if h in base else []
                rows = reduce(DataFrame.unionByName, parts)
                # one rule with aggregates gives one row a group
                single = len(parts) == 1 and any(r.head == h and r.folds() for r in own)
                env[h] = merged(by_name[h], rows) if by_name[h].lattice else rows if single else rows.distinct()
        else:
            env |= _by_classes(group, own, by_name, env, base, max_rounds, rounds, closures) or _recursion(group, own, by_name, env, base, max_rounds, rounds)
    return env


def _closed(group: list[str], rules: list[Rule], relations: dict[str, Relation], env: dict[str, DataFrame], base: dict[str, DataFrame]) -> str | None:
    """The relation whose transitive closure the group is: pairs of it, and ways put together of it and ways."""
    head = group[0]
    if len(group) > 1 or head in base or relations[head].lattice or len(relations[head].columns) != 2:
        return None
    over = {x.rel for r in rules for x in r.body if isinstance(x, Atom) and x.rel != head}
    if len(over) != 1 or any(not isinstance(x, Atom) for r in rules for x in r.body):
        return None
    rel = over.pop()
    columns = {head: list(relations[head].columns), rel: env[rel].columns}
    if len(columns[rel]) != 2:
        return None
    starts = 0
    for r in rules:
        ways = [tuple(x.by_column(columns[x.rel])) for x in r.body]
        named = [v for w in ways for v in w]
        if not all(isinstance(v, str) for v in named):
            return None
        if not any(x.rel == head for x in r.body):
            starts += 1
            if len(ways) != 1 or len(set(named)) != 2 or tuple(r.args) != ways[0]:
                return None
        elif len(ways) != 2 or len(set(named)) != 3 or not any(a[1] == b[0] and tuple(r.args) == (a[0], b[1]) for a, b in (ways, ways[::-1])):
            return None
    return rel if starts else None


def _inside(body: tuple, group: list[str]) -> bool:
    return any(isinstance(x, Any_) and any(isinstance(y, Atom) and y.rel in group or _inside((y,), group) for b in x.bodies for y in b) for x in body)


def _by_classes(group: list[str], rules: list[Rule], relations: dict[str, Relation], env: dict[str, DataFrame], base: dict[str, DataFrame], max_rounds: int, rounds: dict[str, list[int]] | None, closures: dict[str, tuple[DataFrame, DataFrame]] | None) -> dict[str, DataFrame] | None:
    """A transitive closure by recursion over classes of vertices that reach each other; none if there are no such.

    Rounds are counted over vertices, so who asks for them gets the plain recursion.
    """
    from tickwise.operators.closure import expanded, quotient

    rel = None if rounds is not None else _closed(group, rules, relations, env, base)
    found = quotient(env[rel]) if rel is not None else None
    if found is None:
        return None
    members, between = found
    reach = _recursion(group, rules, relations, env | {rel: between}, base, max_rounds, rounds)[group[0]]
    if closures is not None:
        closures[group[0]] = reach, members
    return {group[0]: expanded(reach, members)}


def _recursion(group: list[str], rules: list[Rule], relations: dict[str, Relation], env: dict[str, DataFrame], base: dict[str, DataFrame], max_rounds: int, rounds: dict[str, list[int]] | None) -> dict[str, DataFrame]:
    starts: dict[str, list[DataFrame]] = {h: [base[h]] if h in base else [] for h in group}
    for r in rules:
        if _inside(r.body, group):
            raise ValueError(f"a rule of {r.head} recurs inside alternatives that could not be told apart")
        if not any(isinstance(x, Atom) and x.rel in group for x in r.body):
            starts[r.head].append(derived(r, relations[r.head], env))
    known = {h: Known(relations[h]) for h in group}
    empty: dict[str, DataFrame] = {}
    delta: dict[str, DataFrame] = {}

    def note(h: str, new: DataFrame | None) -> None:
        if rounds is not None:
            rounds.setdefault(h, []).append(0 if new is None else new.count())

    for h in group:
        if starts[h]:
            rows = reduce(DataFrame.unionByName, starts[h]).select(*relations[h].columns)
            new = known[h].add(rows)
            note(h, new)
            if new is not None:
                delta[h] = new
            empty[h] = rows.limit(0)
    while len(empty) < len(group):
        # a head with no rows of its own yet: empty, in the shape that its first rule gives over what is there
        lacking = [x for x in group if x not in empty]
        found = next(((h, r) for h in lacking for r in rules if r.head == h and all(not isinstance(x, Atom) or x.rel in env or x.rel in empty for x in r.body)), None)
        if found is None:
            raise ValueError(f"cannot tell the columns' types of {lacking}; give one a base, perhaps empty")
        empty[found[0]] = Shared(derived(found[1], relations[found[0]], env | empty).limit(0)).df

    def whole(h: str) -> DataFrame:
        return known[h].whole() if known[h].tables() else empty[h]

    count = 0
    while delta:
        count += 1
        if count > max_rounds:
            raise NotConverged(f"{', '.join(group)} still changed after {max_rounds} rounds")
        now = env | {h: whole(h) for h in group}
        fresh: dict[str, DataFrame] = {}
        for h in group:
            found = [
                derived(r, relations[h], now, first=i, delta=delta[x.rel])
                for r in rules if r.head == h for i, x in enumerate(r.body) if isinstance(x, Atom) and x.rel in delta
            ]
            if found:
                fresh[h] = reduce(DataFrame.unionByName, found)
        following = {h: known[h].add(rows) for h, rows in fresh.items()}
        for h, new in following.items():
            note(h, new)
        delta = {h: new for h, new in following.items() if new is not None}
    out = {h: whole(h) for h in group}
    for k in known.values():
        k.close()
    return out


__all__ = ["Agg", "Known", "NotConverged", "Unstratified", "evaluate", "merged", "points_of_order", "strata"]
