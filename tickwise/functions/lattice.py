"""Operations on lattice values as Column functions. The bottom of a max, min or point is null; of a set or map, empty; of a bool, false.

Sets are arrays in order without repeats, maps have values of another lattice. What a larger input can take back
(reveal, is_bot, is_empty, leq, less, not_) is a point of order: ask it only of values that are complete.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def join(kind: str, a: Column, b: Column) -> Column:
    """The least value above both. ``kind``: max, min, set, bool, point, or map:<kind of its values>."""
    if kind == "max":
        return F.greatest(a, b)
    if kind == "min":
        return F.least(a, b)
    if kind == "set":
        return F.array_sort(F.array_union(a, b))
    if kind == "bool":
        return a | b
    if kind == "point":
        return F.when(a.isNull(), b).when(b.isNull() | (a == b), a).otherwise(F.raise_error(F.lit("two values for one key of a point")))
    inner = kind.removeprefix("map:")
    return F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(join(inner, x, y)))


def leq(kind: str, a: Column, b: Column) -> Column:
    """Whether b is at or above a."""
    if kind == "max":
        return a.isNull() | (b.isNotNull() & F.coalesce(a <= b, F.lit(False)))
    if kind == "min":
        return a.isNull() | (b.isNotNull() & F.coalesce(a >= b, F.lit(False)))
    if kind == "set":
        return F.size(F.array_except(a, b)) == 0
    if kind == "bool":
        return ~a | b
    if kind == "point":
        return a.isNull() | F.coalesce(a == b, F.lit(False))
    inner = kind.removeprefix("map:")
    return F.forall(F.map_entries(a), lambda e: F.map_contains_key(b, e["key"]) & leq(inner, e["value"], F.try_element_at(b, e["key"])))


def less(kind: str, a: Column, b: Column) -> Column:
    """Whether b is above a and not equal to it."""
    return leq(kind, a, b) & ~leq(kind, b, a)


def of(kind: str, x: Column) -> Column:
    """The lattice value of a plain one: an element's set, a key's map is ``lift_entries``."""
    return F.array(x) if kind == "set" else x


def lift(kind: str, x: Column) -> Column:
    """A plain collection or value where a lattice is wanted: an array becomes a set."""
    return F.array_sort(F.array_distinct(x)) if kind == "set" else x


def lift_entries(kind: str, m: Column) -> Column:
    """A map whose plain values become lattice values."""
    return F.transform_values(m, lambda _, v: of(kind, v))


def reveal(kind: str, x: Column) -> Column:
    """The plain value; null for a bottom."""
    if kind == "set":
        return F.when(F.size(x) > 0, x)
    if kind.startswith("map"):
        return F.when(F.size(x) > 0, x)
    return F.when(x, x) if kind == "bool" else x


def reveal_non_bot(x: Column) -> Column:
    """The value of a max, min or point that is known not to be the bottom; raises at one."""
    return F.coalesce(x, F.raise_error(F.lit("the bottom has no value")))


def is_bot(kind: str, x: Column) -> Column:
    return reveal(kind, x).isNull()


def contains(s: Column, x: Column) -> Column:
    return F.array_contains(s, x)


def size(x: Column) -> Column:
    """Elements of a set, keys of a map."""
    return F.size(x).cast("bigint")


def nonempty(s: Column) -> Column:
    return F.size(s) > 0


def is_empty(s: Column) -> Column:
    return F.size(s) == 0


def at_least(x: Column, c: Column) -> Column:
    """A max has reached c."""
    return F.coalesce(x >= c, F.lit(False))


def above(x: Column, c: Column) -> Column:
    return F.coalesce(x > c, F.lit(False))


def at_most(x: Column, c: Column) -> Column:
    """A min has come down to c."""
    return F.coalesce(x <= c, F.lit(False))


def below(x: Column, c: Column) -> Column:
    return F.coalesce(x < c, F.lit(False))


def at(m: Column, key: Column) -> Column:
    """A map's value at the key, null (a bottom) if it has none."""
    return F.try_element_at(m, key)


def has_key(m: Column, key: Column) -> Column:
    return F.map_contains_key(m, key)


def key_set(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def total(s: Column, kind: str = "bigint") -> Column:
    """The sum over a set of non-negative numbers: each counts once, so it only grows."""
    return F.aggregate(s, F.lit(0).cast(kind), lambda a, x: a + x)


def get(p: Column) -> Column:
    """A point's value, null while it has none."""
    return p


def add(x: Column, c: Column) -> Column:
    """A max or min moved by a plain number; the bottom stays."""
    return x + c


def add_lat(a: Column, b: Column) -> Column:
    """The sum of two maxima (or minima); the bottom if either is."""
    return a + b


def sub(x: Column, c: Column) -> Column:
    return x - c


def min_of(x: Column, c: Column) -> Column:
    """A max held down to c; the bottom stays."""
    return F.when(x.isNotNull(), F.least(x, c))


def intersect(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def min_elem(s: Column) -> Column:
    """A set's least element as a min."""
    return F.array_min(s)


def max_elem(s: Column) -> Column:
    """A set's largest element as a max."""
    return F.array_max(s)


def and_(a: Column, b: Column) -> Column:
    return a & b


def or_(a: Column, b: Column) -> Column:
    return a | b


def not_(a: Column) -> Column:
    return ~a


__all__ = [
    "above", "add", "add_lat", "and_", "at", "at_least", "at_most", "below", "contains", "get", "has_key", "intersect", "is_bot", "is_empty", "join", "key_set", "leq", "less", "lift", "lift_entries",
    "max_elem", "min_elem", "min_of", "nonempty", "not_", "of", "or_", "reveal", "reveal_non_bot", "size", "sub", "total",
]
