"""Rules over typed relations, compiled to DataFrame plans.

A body is a conjunction of literals over named variables. Its valuations are the distinct bindings of the variables
that the rule names; a wildcard is projected away before anything is counted. Joins are natural joins on shared
variables and negation is an anti-join, so Catalyst sees plain equi-joins and picks how to run them. A null is the
value None: it equals itself, in joins and negation as well.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


@dataclass(frozen=True)
class Const:
    """A constant in an atom: selects."""

    value: Any


@dataclass(frozen=True)
class Expr:
    """A SQL expression over bound variables, in an atom: the column must equal it."""

    sql: str


@dataclass(frozen=True)
class Parts:
    """A pattern for a struct column: a term per field, in order. With ``tag``, the first field must be that variant's number."""

    terms: tuple
    tag: int | None = None


@dataclass(frozen=True)
class Some:
    """A pattern for a column that may be null: it must not be, and the term stands for its value."""

    term: Any


@dataclass(frozen=True)
class Atom:
    """rel(args): a term per column, or a dict of terms by column name.

    A term is a variable's name, None for a wildcard, a Const, an Expr or a pattern. A repeated variable asks for equality.
    A dict must name every column unless ``rest`` says that the others don't matter.
    """

    rel: str
    args: tuple | dict
    rest: bool = False

    def terms(self) -> list:
        return list(self.args.values() if isinstance(self.args, dict) else self.args)

    def vars(self) -> set[str]:
        return {a for a in self.terms() if isinstance(a, str)}

    def by_column(self, columns: list[str]) -> list:
        """The terms in the order of the relation's columns."""
        if not isinstance(self.args, dict):
            if len(self.args) != len(columns):
                raise ValueError(f"{self.rel} has {len(columns)} columns, not {len(self.args)}")
            return list(self.args)
        unknown, missing = set(self.args) - set(columns), set(columns) - set(self.args)
        if unknown or (missing and not self.rest):
            raise ValueError(f"{self.rel}: unknown columns {sorted(unknown)}, columns left out {sorted(missing)}")
        return [self.args.get(c) for c in columns]


@dataclass(frozen=True)
class Not:
    """No row of the atom, or of the body, agrees with the bound variables."""

    body: tuple

    def atoms(self) -> list[Atom]:
        return [x for x in self.body if isinstance(x, Atom)]


@dataclass(frozen=True)
class ForAll:
    """Every binding of ``domain`` satisfies ``body``, too: relational division."""

    domain: tuple
    body: tuple


@dataclass(frozen=True)
class Outer:
    """A left outer match; ``matched`` names a boolean that tells a missing row from nulls in it."""

    atom: Atom
    matched: str


@dataclass(frozen=True)
class Any_:
    """A union of alternative bodies that bind the same variables."""

    bodies: tuple


@dataclass(frozen=True)
class Guard:
    """A SQL condition over bound variables."""

    expr: str


@dataclass(frozen=True)
class Let:
    """var = SQL expression over bound variables; ``some`` drops the valuations where it is null."""

    var: str
    expr: str
    some: bool = False


@dataclass(frozen=True)
class Lookup:
    """var = the cell of a lattice relation at the key (bound variables), or the SQL value ``bottom`` if there is none."""

    var: str
    rel: str
    key: tuple
    bottom: str


@dataclass(frozen=True)
class Fold:
    """var = the lattice fold of ``expr`` over the body's valuations that agree with the bound variables; ``bottom`` if none.

    ``kind`` is a lattice kind of Relation; variables bound outside are correlated if the body binds them, too.
    """

    var: str
    kind: Any
    expr: str
    body: tuple
    bottom: str = "null"


@dataclass(frozen=True)
class Each:
    """One row per element of an array expression; ``index`` names its place from 0."""

    var: str
    expr: str
    index: str | None = None


@dataclass(frozen=True)
class Agg:
    """An aggregate over the group's distinct valuations.

    count, sum, min, max, avg, and, or, set, list; collect (in the order of ``by``, then of the whole valuation), map (``expr``
    is the pair of key and value, two values of a key raise) and percentile (nearest rank at ``p``). ``default`` is the SQL
    value of a group without valuations, for rules with a driver or without groups.
    """

    fn: str
    expr: str | tuple[str, str] | None = None
    by: tuple[str, ...] = ()
    p: float | None = None
    default: str | None = None


@dataclass(frozen=True)
class Relation:
    """Columns, and for a lattice relation how its last columns merge per key: column -> min, max, or, and, set, point or a Lattice."""

    name: str
    columns: tuple[str, ...]
    lattice: dict[str, Any] = field(default_factory=dict)

    @property
    def key(self) -> list[str]:
        return [c for c in self.columns if c not in self.lattice]


@dataclass(frozen=True)
class Rule:
    """head columns <- body. A head entry is a variable, a SQL expression, or an Agg.

    ``per`` is the driver of a rule with aggregates: an atom that the body begins with, and each of whose rows has a row in
    the head even if the rest of the body matches nothing.
    """

    head: str
    args: tuple
    body: tuple
    per: Atom | None = None

    def whole(self) -> tuple:
        return self.body if self.per is None else (self.per, *self.body)

    def folds(self) -> bool:
        return any(isinstance(a, Agg) for a in self.args)

    def reads(self) -> list[tuple[str, bool]]:
        """(relation, whether it is read negatively) in the body."""
        return list(_reads(self.whole(), self.folds()))


def keys_of(relation: Relation, key: tuple[str, ...], terms: tuple) -> Atom:
    """The relation's keys alone: an atom over its columns ``key``."""
    return Atom(relation.name, dict(zip(key, terms, strict=True)), rest=True)


def values_of(relation: Relation, key: tuple[str, ...], terms: tuple) -> Atom:
    """The relation's values alone: an atom over the columns that aren't in ``key``."""
    return Atom(relation.name, dict(zip([c for c in relation.columns if c not in key], terms, strict=True)), rest=True)


def member(var: str, collection: str) -> Guard:
    """The bound variable is in an array, given as SQL."""
    return Guard(f"array_contains({collection}, ${var})")


def block(name: str, variables: tuple[str, ...], header: tuple, statements: list[Rule]) -> list[Rule]:
    """Rules that share a header: its valuations are derived once, as the relation ``name``, and each statement's body follows it."""
    return [Rule(name, variables, header), *[replace(r, body=(Atom(name, variables), *r.body)) for r in statements]]


def _reads(body: tuple, negative: bool):
    for x in body:
        if isinstance(x, Atom):
            yield x.rel, negative
        elif isinstance(x, Outer):
            yield x.atom.rel, True
        elif isinstance(x, Lookup):
            yield x.rel, True
        elif isinstance(x, Fold):
            yield from _reads(x.body, True)
        elif isinstance(x, Not):
            yield from _reads(x.body, True)
        elif isinstance(x, ForAll):
            yield from _reads(x.domain + x.body, True)
        elif isinstance(x, Any_):
            for b in x.bodies:
                yield from _reads(b, negative)


_fresh = itertools.count()


def _variables(body: tuple) -> set[str]:
    """The variables that a body binds at its top."""
    out: set[str] = set()
    for x in body:
        if isinstance(x, Atom):
            out |= _term_variables(x.terms())
        elif isinstance(x, (Let, Each, Lookup, Fold)):
            out |= {x.var} | ({x.index} if isinstance(x, Each) and x.index else set())
        elif isinstance(x, Outer):
            out |= _term_variables(x.atom.terms()) | {x.matched}
        elif isinstance(x, Any_):
            out |= set.intersection(*[_variables(b) for b in x.bodies])
    return out


def _term_variables(terms) -> set[str]:
    out: set[str] = set()
    for t in terms:
        if isinstance(t, str):
            out.add(t)
        elif isinstance(t, Parts):
            out |= _term_variables(t.terms)
        elif isinstance(t, Some):
            out |= _term_variables([t.term])
    return out


def _simple_atom(atom: Atom) -> tuple[Atom, list]:
    """The atom with variables, constants and wildcards alone, and the literals that test and take apart what stood there."""
    more: list = []

    def plain(term):
        if term is None or isinstance(term, (str, Const)):
            return term
        var = f"__p{next(_fresh)}"
        take_apart(var, term)
        return var

    def take_apart(var: str, term) -> None:
        if isinstance(term, Expr):
            more.append(Guard(f"${var} <=> ({term.sql})"))
        elif isinstance(term, Some):
            more.append(Guard(f"${var} is not null"))
            bind(f"${var}", term.term)
        else:
            fields = list(term.terms)
            if term.tag is not None:
                more.append(Guard(f"__field(${var}, 0) <=> {term.tag}"))
                fields = [None, *fields]
            for i, t in enumerate(fields):
                if t is not None:
                    bind(f"__field(${var}, {i})", t)

    def bind(sql: str, term) -> None:
        if term is None:
            return
        if isinstance(term, str):
            more.append(Let(term, sql))
        else:
            inner = f"__p{next(_fresh)}"
            more.append(Let(inner, sql))
            if isinstance(term, Const):
                more.append(_Same(inner, term.value))
            else:
                take_apart(inner, term)

    args = {c: plain(t) for c, t in atom.args.items()} if isinstance(atom.args, dict) else tuple(plain(t) for t in atom.args)
    return replace(atom, args=args), more


@dataclass(frozen=True)
class _Same:
    """A bound variable equals a constant."""

    var: str
    value: Any


def simple_body(body: tuple) -> tuple:
    """The body without patterns, expressions as terms, or nested bodies that have any."""
    out: list = []
    for x in body:
        if isinstance(x, Atom):
            atom, more = _simple_atom(x)
            out += [atom, *more]
        elif isinstance(x, Not):
            out.append(Not(simple_body(x.body)))
        elif isinstance(x, ForAll):
            out.append(ForAll(simple_body(x.domain), simple_body(x.body)))
        elif isinstance(x, Any_):
            out.append(Any_(tuple(simple_body(b) for b in x.bodies)))
        elif isinstance(x, Fold):
            out.append(replace(x, body=simple_body(x.body)))
        else:
            out.append(x)
    return tuple(out)


def simple(rule: Rule) -> Rule:
    return replace(rule, body=simple_body(rule.body))


def alternatives(rule: Rule) -> list[Rule]:
    """One rule for each choice among the bodies of its ``Any_`` literals. Variables of one alternative alone get names of their own."""
    for i, x in enumerate(rule.body):
        if isinstance(x, Any_):
            shared = set.intersection(*[_variables(b) for b in x.bodies])
            out = []
            for b in x.bodies:
                own = {v: f"__a{next(_fresh)}" for v in _variables(b) - shared}
                out += alternatives(replace(rule, body=(*rule.body[:i], *(_renamed(y, own) for y in b), *rule.body[i + 1 :])))
            return out
    return [rule]


def _renamed(x, names: dict[str, str]):
    """The literal with variables renamed, in terms and in SQL."""
    term = lambda t: names.get(t, t) if isinstance(t, str) else t
    sql = lambda e: _VARIABLE.sub(lambda m: m[0] if m[1] is None else "$" + names.get(m[1], m[1]), e)
    inside = lambda body: tuple(_renamed(y, names) for y in body)
    if isinstance(x, Atom):
        return replace(x, args={c: term(t) for c, t in x.args.items()} if isinstance(x.args, dict) else tuple(map(term, x.args)))
    if isinstance(x, Guard):
        return Guard(sql(x.expr))
    if isinstance(x, Let):
        return replace(x, var=term(x.var), expr=sql(x.expr))
    if isinstance(x, Each):
        return replace(x, var=term(x.var), expr=sql(x.expr), index=term(x.index))
    if isinstance(x, _Same):
        return replace(x, var=term(x.var))
    if isinstance(x, Lookup):
        return replace(x, var=term(x.var), key=tuple(map(term, x.key)))
    if isinstance(x, Fold):
        return replace(x, var=term(x.var), expr=sql(x.expr), body=inside(x.body))
    if isinstance(x, Outer):
        return Outer(_renamed(x.atom, names), term(x.matched))
    if isinstance(x, Not):
        return Not(inside(x.body))
    if isinstance(x, ForAll):
        return ForAll(inside(x.domain), inside(x.body))
    return Any_(tuple(inside(b) for b in x.bodies))


def atom_frame(atom: Atom, rel: DataFrame) -> DataFrame:
    """The atom's bindings: constants select, repeated variables must agree, wildcards drop out."""
    seen: dict[str, Column] = {}
    for name, arg in zip(rel.columns, atom.by_column(rel.columns), strict=True):
        if isinstance(arg, Const):
            rel = rel.where(F.col(name).eqNullSafe(F.lit(arg.value)))
        elif arg is not None:
            if arg in seen:
                rel = rel.where(F.col(name).eqNullSafe(seen[arg]))
            else:
                seen[arg] = F.col(name)
    return rel.select(*[c.alias(v) for v, c in seen.items()]) if seen else rel.select(F.lit(1).alias("__some"))


#: A quoted literal or name, which is passed over, or a variable.
_VARIABLE = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|\$(\w+)""")
_FIELD = re.compile(r"__field\(`(\w+)`, (\d+)\)")


def variables_of(expr: str) -> list[str]:
    return [m[1] for m in _VARIABLE.finditer(expr) if m[1] is not None]


def _bound(expr: str, bound: set[str]) -> bool:
    return all(v in bound for v in variables_of(expr))


def _sql(expr: str, frame: DataFrame | None = None) -> Column:
    """SQL in which $x outside quotes is the variable x, and __field($x, i) is field i of a struct."""
    named = _VARIABLE.sub(lambda m: m[0] if m[1] is None else f"`{m[1]}`", expr)
    if frame is not None:
        named = _FIELD.sub(lambda m: f"`{m[1]}`.`{frame.schema[m[1]].dataType.names[int(m[2])]}`", named)
    return F.expr(named)


def bindings(body: tuple, env: dict[str, DataFrame], start: DataFrame | None = None, first: int | None = None, delta: DataFrame | None = None, needed: set[str] | None = None) -> DataFrame:
    """The body's bindings. ``first`` is the place of an atom that reads ``delta`` in its relation's stead, and leads the join.

    With ``needed``, only these variables matter: an atom that binds none of them, nor any that another literal uses, is a
    semi-join.
    """
    waiting = list(enumerate(body))
    frame = start
    if first is not None:
        frame = atom_frame(body[first], delta)
        waiting = [(i, x) for i, x in waiting if i != first]
    while waiting:
        bound = set(frame.columns) - {"__some"} if frame is not None else set()
        ready = _next(waiting, bound, frame is not None)
        if ready is None:
            raise ValueError(f"a variable is never bound: {[x for _, x in waiting]}")
        waiting.remove(ready)
        used = None if needed is None else needed.union(*(_uses(x) for _, x in waiting))
        frame = _apply(ready[1], frame, bound, env, used)
    return frame


def _uses(x) -> set[str]:
    """Every variable that a literal mentions."""
    if isinstance(x, Atom):
        return x.vars()
    if isinstance(x, Outer):
        return x.atom.vars() | {x.matched}
    if isinstance(x, _Same):
        return {x.var}
    if isinstance(x, Lookup):
        return {x.var, *x.key}
    if isinstance(x, Any_):
        return set().union(*(_uses(y) for b in x.bodies for y in b))
    if isinstance(x, Not):
        return set().union(*map(_uses, x.body))
    if isinstance(x, ForAll):
        return set().union(*map(_uses, x.domain + x.body))
    own = set(variables_of(x.expr)) | ({x.var} if isinstance(x, (Let, Each, Fold)) else set())
    return own.union(*map(_uses, x.body)) if isinstance(x, Fold) else own


def _next(waiting: list, bound: set[str], started: bool):
    """Guards first, so that they protect what can fail; then other scalars, atoms that share a variable, and what is left.

    Negation and the like come once no atom is left that could bind their variables.
    """
    atoms = [w for w in waiting if isinstance(w[1], (Atom, Any_))]
    for kinds in ((Guard, _Same), (Let, Each)):
        for w in waiting:
            x = w[1]
            if isinstance(x, kinds) and started and (x.var in bound if isinstance(x, _Same) else _bound(x.expr, bound)):
                return w
    linked = [w for w in atoms if _variables((w[1],)) & bound]
    # alternatives may use what other atoms bind, so those go first
    for some in (linked, atoms):
        if some:
            return next((w for w in some if isinstance(w[1], Atom)), some[0])
    for w in waiting:
        if isinstance(w[1], Lookup) and started and set(w[1].key) <= bound:
            return w
    return next((w for w in waiting if isinstance(w[1], (Not, ForAll, Outer, Fold)) and started), None)


def _apply(x, frame: DataFrame | None, bound: set[str], env: dict[str, DataFrame], used: set[str] | None) -> DataFrame:
    if isinstance(x, Guard):
        return frame.where(_sql(x.expr, frame))
    if isinstance(x, _Same):
        return frame.where(F.col(x.var).eqNullSafe(F.lit(x.value)))
    if isinstance(x, Let):
        value = _sql(x.expr, frame)
        out = frame.where(F.col(x.var).eqNullSafe(value)) if x.var in bound else frame.withColumn(x.var, value)
        return out.where(F.col(x.var).isNotNull()) if x.some else out
    if isinstance(x, Each):
        rest = [F.col(c) for c in frame.columns]
        if x.index:
            return frame.select(*rest, F.posexplode(_sql(x.expr)).alias(x.index, x.var))
        return frame.select(*rest, F.explode(_sql(x.expr)).alias(x.var))
    if isinstance(x, Atom):
        other = atom_frame(x, env[x.rel])
        if frame is None:
            return other
        if not x.vars():
            return frame.join(other.limit(1), F.lit(True), "left_semi")
        if x.vars() <= bound or (used is not None and x.vars() & bound and not (x.vars() - bound) & used):
            return matched(frame, other, sorted(x.vars() & bound), "left_semi")
        return _join(frame, other.distinct() if None in x.by_column(env[x.rel].columns) else other, "inner")
    if isinstance(x, Any_):
        parts = [bindings(b, env, start=frame) for b in x.bodies]
        names = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
        shown = [p.select(*names) if names else p.select(F.lit(1).alias("__some")) for p in parts]
        return reduce(DataFrame.unionByName, shown).distinct()
    if isinstance(x, Outer):
        right = atom_frame(x.atom, env[x.atom.rel]).withColumn(x.matched, F.lit(True))
        return _join(frame, right, "left").withColumn(x.matched, F.coalesce(x.matched, F.lit(False)))
    if isinstance(x, Lookup):
        cells = env[x.rel]
        cell = cells.select(*[F.col(c).alias(v) for c, v in zip(cells.columns, x.key)], F.col(cells.columns[len(x.key)]).alias(x.var))
        return matched(frame, cell, list(x.key), "left").withColumn(x.var, F.coalesce(x.var, F.expr(x.bottom)))
    if isinstance(x, Fold):
        inner = bindings(x.body, env)
        on = sorted(bound & set(inner.columns))
        folded = inner.distinct().groupBy(*on).agg(lattice_join(x.kind)(_sql(x.expr)).alias(x.var))
        out = matched(frame, folded, on, "left") if on else frame.join(folded, F.lit(True), "left")
        return out.withColumn(x.var, F.coalesce(x.var, F.expr(x.bottom)))
    if isinstance(x, Not):
        return _without(frame, bound, x.body, env)
    return _for_all(x, frame, bound, env)


def _without(frame: DataFrame, bound: set[str], body: tuple, env: dict[str, DataFrame]) -> DataFrame:
    inside = _variables(body)
    if all(isinstance(b, Atom) or (isinstance(b, (Guard, Let, Each)) and _bound(b.expr, inside)) for b in body):
        inner = bindings(body, env, needed=bound & inside)
    else:
        # a guard that compares with the row needs the row's variables, once each
        own = sorted(bound & set().union(*map(_uses, body)))
        inner = bindings(body, env, start=frame.select(*own).distinct())
    on = sorted(bound & set(inner.columns))
    if on:
        return matched(frame, inner.select(*on), on, "left_anti")
    return frame.join(inner.limit(1).select(F.lit(1).alias("__any")), F.lit(True), "left_anti")


def _for_all(x: ForAll, frame: DataFrame, bound: set[str], env: dict[str, DataFrame]) -> DataFrame:
    """Rows for which every binding of the domain satisfies the body.

    If domain and body are atoms, bindings are counted: a row needs as many as the domain has. Otherwise the bindings
    that fail are found, and rows that have one drop out.
    """
    if not all(isinstance(y, Atom) for y in x.domain + x.body):
        domain = _join(frame.distinct(), bindings(x.domain, env), "inner")
        failing = _without(domain, set(domain.columns), x.body, env)
        return matched(frame, failing, sorted(bound & set(failing.columns)), "left_anti")
    domain = bindings(x.domain, env).distinct()
    own = sorted(set(domain.columns) - bound)
    outer = sorted(set(domain.columns) & bound)
    fine = bindings(x.domain + x.body, env, needed=set(domain.columns) | bound)
    by = sorted(set(fine.columns) & bound)
    need = domain.groupBy(*outer).agg(F.count("*").alias("__need"))
    have = fine.select(*own, *by).distinct().groupBy(*by).agg(F.count("*").alias("__have"))
    out = matched(frame, need, outer, "left") if outer else frame.crossJoin(need)
    out = matched(out, have, by, "left") if by else out.crossJoin(have)
    return out.where(F.coalesce("__need", F.lit(0)) == F.coalesce("__have", F.lit(0))).drop("__need", "__have")


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join on equal columns in which null equals null; the columns appear once."""
    named = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on])
    joined = left.join(named, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{c}" for c in on])


def _join(frame: DataFrame | None, other: DataFrame, how: str) -> DataFrame:
    if frame is None:
        return other
    on = sorted((set(frame.columns) & set(other.columns)) - {"__some"})
    if on:
        return matched(frame, other.drop("__some"), on, how)
    other = other.drop("__some") if "__some" in frame.columns else other
    return frame.crossJoin(other) if how == "inner" else frame.join(other, F.lit(True), how)


def lattice_join(kind):
    """How a kind of lattice merges, as an aggregate; nulls, the bottom, take no part."""
    if not isinstance(kind, str):
        return kind.merge
    point = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.when(F.min(c).isNotNull(), F.raise_error(F.lit("two values for one key of a point"))))
    return {"min": F.min, "max": F.max, "or": F.bool_or, "and": F.bool_and, "set": lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), "point": point}[kind]


#: What a group without valuations has, if there is a driver.
IDENTITY = {"count": "0L", "sum": "0L", "and": "true", "or": "false", "set": "array()", "list": "array()", "collect": "array()", "map": "map()"}


def _fold(a: Agg, named: list[str], valuations: DataFrame) -> Column:
    e = None if a.expr is None or isinstance(a.expr, tuple) else _sql(a.expr)
    if a.fn == "count":
        return F.count("*") if e is None else F.count_distinct(F.struct(e))
    if a.fn == "collect":
        items = F.array_sort(F.collect_list(F.struct(*[_sql(k).alias(f"k{i}") for i, k in enumerate(a.by)], e.alias("e"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(named)])))
        return F.transform(items, lambda x: x["e"])
    if a.fn == "map":
        return F.map_from_entries(F.array_sort(F.collect_set(F.struct(*map(_sql, a.expr)))))
    if a.fn == "percentile":
        kind = valuations.select(e.alias("e")).schema["e"].dataType
        if isinstance(kind, NumericType):
            return F.expr(f"percentile_disc({a.p!r}) within group (order by {_VARIABLE.sub(lambda m: m[0] if m[1] is None else f'`{m[1]}`', a.expr)})").cast(kind)
        ranked = F.array_sort(F.collect_list(e))
        return F.element_at(ranked, F.greatest(F.ceil(F.size(ranked) * F.lit(a.p)), F.lit(1)).cast("int"))
    return {
        "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "and": F.bool_and, "or": F.bool_or,
        "set": lambda c: F.array_sort(F.collect_set(c)), "list": lambda c: F.array_sort(F.collect_list(c)),
    }[a.fn](e)


def head_frame(rule: Rule, relation: Relation, valuations: DataFrame, env: dict[str, DataFrame] | None = None) -> DataFrame:
    """Projects the head; with aggregates, groups the distinct valuations of named variables by the rest.

    An empty group gives no row, unless the rule has a driver, or no groups and defaults.
    """
    named = list(zip(relation.columns, rule.args, strict=True))
    if not rule.folds():
        return valuations.select(*[_sql(a).alias(c) if isinstance(a, str) else F.lit(a.value).alias(c) for c, a in named])
    own = [c for c in valuations.columns if not c.startswith("__")]
    distinct = valuations.select(*own).distinct() if own else valuations.limit(1)
    groups = [(c, a) for c, a in named if not isinstance(a, Agg)]
    folds = [(c, a) for c, a in named if isinstance(a, Agg)]
    aggregated = [_fold(a, own, distinct).alias(c) for c, a in folds]
    if not groups:
        out = distinct.agg(*aggregated, F.count("*").alias("__n"))
        if any(a.default is None for _, a in folds):
            return out.where("__n > 0").select(*relation.columns)
        return out.select(*[F.when(F.col("__n") > 0, F.col(c)).otherwise(F.expr(a.default)).alias(c) for c, a in folds])
    out = distinct.groupBy(*[_sql(a).alias(c) for c, a in groups]).agg(*aggregated)
    if rule.per is not None:
        lost = [c for c, a in folds if a.default is None and a.fn not in IDENTITY]
        if lost:
            raise ValueError(f"{rule.head}: {lost} need a default, as a driver may have no valuations")
        keys = [c for c, _ in groups]
        driver = atom_frame(rule.per, env[rule.per.rel]).select(*[_sql(a).alias(c) for c, a in groups]).distinct()
        out = matched(driver, out.withColumn("__some", F.lit(True)), keys, "left")
        for c, a in folds:
            out = out.withColumn(c, F.when(F.col("__some"), F.col(c)).otherwise(F.expr(a.default or IDENTITY[a.fn]).cast(out.schema[c].dataType)))
    return out.select(*relation.columns)


def derived(rule: Rule, relation: Relation, env: dict[str, DataFrame], first: int | None = None, delta: DataFrame | None = None) -> DataFrame:
    """The head's rows that the rule gives over ``env``; ``first`` and ``delta`` as in ``bindings``, over ``rule.body``."""
    if rule.folds():
        return head_frame(rule, relation, bindings(rule.whole(), env), env)
    needed = set().union(*(variables_of(a) or _words(a) for a in rule.args if isinstance(a, str)))
    return head_frame(rule, relation, bindings(rule.body, env, first=first, delta=delta, needed=needed))


def _words(expr: str) -> set[str]:
    """Names in a head's expression, variables among them."""
    return set(re.findall(r"\w+", expr))
