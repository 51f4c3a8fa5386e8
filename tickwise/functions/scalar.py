"""Scalar library as Column functions: JVM-side, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """IEEE division of doubles: by zero gives infinities or NaN instead of an error."""
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def round_away(x: Column) -> Column:
    """Nearest whole number, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def trunc(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(x, hi))


def to_fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def parse_i64(text: Column) -> Column:
    """A signed whole number in decimal digits, or null; no spaces, no other forms."""
    return F.when(F.regexp_like(text, F.lit(r"^[+-]?[0-9]+$")), text.try_cast("bigint"))


def range_(lo: Column, hi: Column) -> Column:
    """lo .. hi - 1; empty if hi <= lo."""
    return F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))


def enumerate_(v: Column) -> Column:
    return F.transform(v, lambda x, i: F.struct(i.cast("bigint").alias("at"), x.alias("value")))


def filter_map(v: Column, f) -> Column:
    return F.filter(F.transform(v, f), lambda x: x.isNotNull())


def scan(v: Column, init: Column, step, kind: str) -> Column:
    """All accumulators of a fold, in order."""
    start = F.struct(init.alias("acc"), F.array().cast(f"array<{kind}>").alias("all"))
    return F.aggregate(v, start, lambda s, x: F.struct(step(s["acc"], x).alias("acc"), F.array_append(s["all"], step(s["acc"], x)).alias("all")), lambda s: s["all"])


def sort_options(v: Column) -> Column:
    """Sorted with nulls first."""
    return F.sort_array(v)


def to_set(v: Column) -> Column:
    return F.array_sort(F.array_distinct(v))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def u32_be_at(data: Column, at: int) -> Column:
    """The unsigned big-endian 32-bit number at byte ``at`` (from 0), or null past the end."""
    part = F.substring(data, at + 1, 4)
    return F.when(F.length(part) == 4, F.conv(F.hex(part), 16, 10).cast("bigint"))


def put_u32_be(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x), 8, "0"))


def ring_between(x: Column, lo: Column, hi: Column, closed: bool = True) -> Column:
    """Whether x lies on the way from lo up to hi on a ring: lo < x <= hi, or < hi if open; lo = hi is the whole ring."""
    end = x <= hi if closed else x < hi
    return F.when(lo < hi, (x > lo) & end).otherwise((x > lo) | end)


def route(key: Column, members: list[str]) -> Column:
    """Rendezvous hashing: the member of the largest hash with the key; a new member takes keys only to itself."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(key, F.lit(m)).alias("h"), F.lit(m).alias("m")) for m in members]))["m"]


def majority(votes: Column, members: Column) -> Column:
    return F.size(F.array_intersect(votes, members)) * 2 > F.size(members)


def int_bytes(x: Column, width: int) -> Column:
    """``width`` bytes, big-endian; a negative number in two's complement. Null if it does not fit signed or unsigned."""
    low, high = (-(1 << 8 * width - 1), (1 << 8 * width) - 1) if width < 8 else (None, None)
    digits = F.unhex(F.right(F.lpad(F.hex(x.cast("bigint")), 16, "0"), F.lit(2 * width)))
    return digits if low is None else F.when(x.between(low, high), digits)


def int_at(data: Column, at: Column, width: int, signed: bool = False) -> Column:
    """The big-endian number of ``width`` bytes at byte ``at`` (from 0); null past the end. Eight unsigned bytes wrap to a long."""
    part = F.substring(data, at.cast("int") + 1, F.lit(width))
    value = F.conv(F.hex(part), 16, 10).cast("decimal(20,0)")
    half, whole = F.lit(str(1 << 8 * width - 1)).cast("decimal(20,0)"), F.lit(str(1 << 8 * width)).cast("decimal(21,0)")
    wrapped = F.when(value >= half, value - whole).otherwise(value) if signed or width == 8 else value
    return F.when((at >= 0) & (F.length(part) == width), wrapped.cast("bigint"))


def put_int(data: Column, at: Column, x: Column, width: int) -> Column:
    """``data`` with the number's bytes at byte ``at``; null if they reach past the end."""
    fits = (at >= 0) & (at + width <= F.length(data))
    return F.when(fits, F.concat(F.substring(data, F.lit(1), at.cast("int")), int_bytes(x, width), F.substring(data, at.cast("int") + width + 1, F.length(data))))


def uvarint(x: Column) -> Column:
    """Seven bits a byte, low bits first, the high bit set on all bytes but the last. A long counts as unsigned."""
    x = x.cast("bigint")
    size = F.greatest(F.ceil(F.length(F.bin(x)) / 7), F.lit(1)).cast("int")
    byte = lambda i: F.call_function("shiftrightunsigned", x, i * 7).bitwiseAND(F.lit(127).cast("bigint")) + F.when(i < size - 1, 128).otherwise(0)
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))


def uvarint_at(data: Column, at: Column) -> Column:
    """(value, next position) of the number at byte ``at``; null if it is cut off, longer than ten bytes or over 64 bits."""
    part = F.hex(F.substring(data, at.cast("int") + 1, F.lit(10)))
    items = F.transform(F.sequence(F.lit(0), F.greatest(F.length(part) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.conv(F.substring(part, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))
    size = F.array_position(F.transform(items, lambda b: b < 128), True).cast("int")
    value = F.aggregate(F.slice(items, F.lit(1), F.greatest(size, F.lit(1))), F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(0).alias("s")), lambda a, b: F.struct(a["v"].bitwiseOR(F.call_function("shiftleft", b.bitwiseAND(F.lit(127).cast("bigint")), a["s"])).alias("v"), (a["s"] + 7).alias("s")), lambda a: a["v"])
    whole = (at >= 0) & (at < F.length(data)) & (size > 0) & ((size < 10) | (F.get(items, F.lit(9)) <= 1))
    return F.when(whole, F.struct(value.alias("value"), (at.cast("bigint") + size).alias("next")))


def varint(x: Column) -> Column:
    """A signed number as ``uvarint``, zigzag: 0, -1, 1, -2 as 0, 1, 2, 3."""
    x = x.cast("bigint")
    return uvarint(F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63)))


def varint_at(data: Column, at: Column) -> Column:
    got = uvarint_at(data, at)
    n = got["value"]
    signed = F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(F.lit(1).cast("bigint")))
    return F.when(got.isNotNull(), F.struct(signed.alias("value"), got["next"].alias("next")))


def parse_u64(text: Column) -> Column:
    """A whole number in decimal digits, up to a long, or null."""
    return F.when(F.regexp_like(text, F.lit(r"^[+]?[0-9]+$")), text.try_cast("bigint"))


def words(text: Column) -> Column:
    """Split at Unicode white space, no empty words."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def trim(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def map_insert(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(map_remove(m, key), F.create_map(key, value))


def map_remove(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def map_entries(m: Column) -> Column:
    """(key, value) pairs in key order."""
    return F.array_sort(F.map_entries(m))


def to_map(pairs: Column) -> Column:
    """A map of pairs (key, value); of those with one key the last wins."""
    distinct = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(distinct)


def scan_while(v: Column, init: Column, step, kind: str) -> Column:
    """All accumulators of a fold up to the first step that gives null."""
    start = F.struct(init.alias("acc"), F.array().cast(f"array<{kind}>").alias("all"), F.lit(False).alias("done"))

    def go(s: Column, x: Column) -> Column:
        new = step(s["acc"], x)
        stop = s["done"] | new.isNull()
        return F.struct(F.when(stop, s["acc"]).otherwise(new).alias("acc"), F.when(stop, s["all"]).otherwise(F.array_append(s["all"], new)).alias("all"), stop.alias("done"))

    return F.aggregate(v, start, go, lambda s: s["all"])


def bytes_slice(data: Column, lo: Column, hi: Column) -> Column:
    """Bytes lo .. hi - 1, or null if that is not inside the data."""
    return F.when((lo >= 0) & (lo <= hi) & (hi <= F.length(data)), F.substring(data, lo.cast("int") + 1, (hi - lo).cast("int")))


def from_utf8(data: Column) -> Column:
    """The text of valid UTF-8, or null."""
    return F.try_validate_utf8(data.cast("string"))


def to_text(x: Column) -> Column:
    """The shortest decimal that reads back as the double, without an exponent: 1, 0.1, -2.5, NaN, inf."""
    plain = x.cast("string")
    parts = F.regexp_extract(plain, r"^(-?)([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$", 0)
    part = lambda i: F.regexp_extract(plain, r"^(-?)([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$", i)
    power = F.coalesce(part(4).try_cast("int"), F.lit(0))
    fraction = F.when(part(3) == "0", "").otherwise(part(3))
    digits, point = F.concat(part(2), fraction), F.length(part(2)) + power
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    middle = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits)))
    large = F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits)))
    shown = F.when(point <= 0, small).when(point < F.length(digits), middle).otherwise(large)
    special = F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x == 0, "0")
    return F.coalesce(special, F.when(parts != "", F.concat(part(1), F.regexp_replace(shown, r"^(0\.[0-9]*[1-9])0+$", "$1"))), plain)


def pow_i64(base: Column, exponent: int) -> Column:
    """A whole power by multiplication, so that overflow raises."""
    out = F.lit(1).cast("bigint")
    for _ in range(exponent):
        out = out * base
    return out


def wrapping_add(a: Column, b: Column) -> Column:
    """The sum modulo 2**64, as a signed long."""
    whole = a.cast("decimal(38,0)") + b.cast("decimal(38,0)")
    span, half = F.lit(str(1 << 64)).cast("decimal(38,0)"), F.lit(str(1 << 63)).cast("decimal(38,0)")
    return (F.pmod(whole + half, span) - half).cast("bigint")


def saturating_add(a: Column, b: Column) -> Column:
    whole = a.cast("decimal(38,0)") + b.cast("decimal(38,0)")
    low, high = (F.lit(str(v)).cast("decimal(38,0)") for v in (-(1 << 63), (1 << 63) - 1))
    return F.greatest(low, F.least(high, whole)).cast("bigint")


def leading_zeros(x: Column) -> Column:
    """Zero bits before the first one of a long, counted as unsigned; 64 for zero."""
    return F.when(x == 0, 64).otherwise(64 - F.length(F.bin(x)))


def from_millis(ms: Column) -> Column:
    """A duration, in nanoseconds."""
    return ms.cast("bigint") * 1_000_000


def as_millis(nanos: Column) -> Column:
    """A duration or instant in whole milliseconds, towards zero."""
    return F.call_function("div", nanos, F.lit(1_000_000).cast("bigint"))


def random_range(lo: Column, hi: Column, *key: Column) -> Column:
    """A draw of lo .. hi - 1 that depends on the key alone: seed, node, incarnation, tick and what else tells draws apart."""
    return lo + F.pmod(F.xxhash64(*key), hi - lo)


def random_float(*key: Column) -> Column:
    """A draw of [0, 1) that depends on the key alone."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / float(1 << 53)


def error(message: str, when: Column) -> Column:
    """True, or an error if the condition holds."""
    return F.when(when, F.raise_error(F.lit(message))).otherwise(F.lit(True))


def bytes_join(parts: Column) -> Column:
    """All parts of an array of binaries, end to end."""
    return F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))


def map_keys(m: Column) -> Column:
    """Keys in order."""
    return F.array_sort(F.map_keys(m))


def map_values(m: Column) -> Column:
    """Values in the order of their keys."""
    return F.transform(map_entries(m), lambda e: e["value"])


def blob(data: Column) -> Column:
    """A content address: (hash, length), by SHA-256."""
    return F.struct(F.sha2(data, 256).alias("hash"), F.length(data).cast("bigint").alias("length"))
