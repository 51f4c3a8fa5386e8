"""Lattices, matching, timers, channels, traces, provenance, linearizability and bytes against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tickwise.functions import scalar as S
from tickwise.operators import choice, lattices, linearize, matching
from tickwise.plans import provenance, traces
from tickwise.plans.rules import Atom, Guard, Not, Relation, Rule
from tickwise.sources.lines import lines
from tickwise.streaming import channels, timers


@pytest.fixture
def many_parts(spark):
    """Small tables stay in as many parts as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_classes_of_paths_rings_and_loners(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(60, 50), (50, 55), (55, 60), (70, 70)]
    got = dict(rows(lattices.classes(spark.createDataFrame(links, "a long, b long"), "a", "b")))
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 55: 50, 60: 50, 70: 70}
    assert rows(lattices.classes(spark.createDataFrame([], "a long, b long"), "a", "b")) == []


def test_lattice_rows(spark):
    r = random.Random(3)
    points = [(i % 3, r.randrange(12), r.randrange(12)) for i in range(90)]
    got = set(rows(lattices.undominated(spark.createDataFrame(points, "k long, a long, b long"), ("k",), "a", "b")))
    assert got == {p for p in points if not any(q[0] == p[0] and q[1] >= p[1] and q[2] >= p[2] and q != p for q in points)}
    bags = spark.createDataFrame([("k", "x", 2), ("k", "x", 5), ("k", "y", 0)], "k string, e string, n int")
    assert rows(lattices.bag_join(bags, "n")) == [("k", "x", 5)]
    assert rows(lattices.bag_sum(bags, "n")) == [("k", "x", 7)]
    adds = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "e string, dot int")
    assert rows(lattices.observed_remove(adds, spark.createDataFrame([(1,), (3,)], "dot int"), ("dot",))) == [("x",)]
    tops = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "k string, v int")
    assert {tuple(x) for x in lattices.conflicts(tops, ("k",), "v").collect()} == {("a", 1, False), ("b", None, True)}


def test_matching_is_what_a_scan_takes(spark):
    r = random.Random(5)
    pairs = sorted({(r.randrange(15), r.randrange(15), r.randrange(6)) for _ in range(120)}, key=lambda p: (p[2], p))
    left, right, want = set(), set(), []
    for a, b, c in pairs:
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.append((a, b, c))
    df = spark.createDataFrame(pairs, "a long, b long, c long")
    assert rows(matching.choose_all(df, [("a",), ("b",)], [F.col("c").asc()])) == sorted(want)
    nulls = spark.createDataFrame([(None, 1), (None, 2), (3, 2)], "p long, b long")
    assert sorted(map(str, matching.choose_all(nulls, [("p",), ("b",)], []).collect())) == ["Row(p=3, b=2)", "Row(p=None, b=1)"]


def test_index_numbers_groups_and_nulls(spark, many_parts):
    data = [(g, v) for g in (None, "a", "b") for v in [None, *range(40)]]
    df = spark.createDataFrame(data * 2, "g string, v long")
    got = {(x.g, x.v): x.i for x in choice.index(df, [F.col("v").desc_nulls_last()], "i", ("g",)).collect()}
    assert got == {(g, v): 40 if v is None else 39 - v for g, v in data}
    assert choice.index(df.limit(0), [], "i").collect() == []


def test_precedence_fresh_choice_and_own_aggregates(spark):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert rows(choice.prefer([a, b], ("k",))) == [(1, "a"), (2, "b")]
    assert rows(choice.prefer([a, b], ("k",), spark.createDataFrame([(1, "z")], "k int, v string"))) == [(1, "a"), (1, "z"), (2, "b")]
    many = spark.range(200).selectExpr("id % 4 as k", "id as v")
    draws = [rows(choice.choose_fresh(many, ("k",), "n", 0, t)) for t in (1, 1, 2)]
    assert draws[0] == draws[1] != draws[2]
    total = choice.user_aggregate(many, ("k",), F.lit(0).cast("long"), lambda s, x: s + x["v"], lambda s, t: s + t, lambda s: s, "t", part_rows=40, fan_in=2)
    assert rows(total) == [(k, sum(range(k, 200, 4))) for k in range(4)]


def test_timers(spark):
    clocks = spark.createDataFrame([("a", 0, 100, 100), ("a", 1, 100, 125), ("a", 2, 125, 131), ("b", 0, 100, 109)], "node string, tick int, last long, now long").withColumn("boot", F.lit(100))
    assert rows(timers.fired(clocks, 10)) == [("a", 1, 0, 110), ("a", 1, 1, 120), ("a", 2, 2, 130)]
    assert rows(timers.fired(clocks, 10, times=2)) == [("a", 1, 0, 110), ("a", 1, 1, 120)]
    guard = spark.createDataFrame([("a", 2)], "node string, tick int")
    assert rows(timers.fired_while(clocks, guard, ("node", "tick"), 10)) == [("a", 2, 2, 130)]
    ticks = spark.range(10).selectExpr("cast(id as int) as tick", "id * 7 as now")
    assert rows(timers.fired_ticks(ticks, 5)) == [(4, 0, 28), (9, 1, 63)]


def test_channels(spark):
    got = spark.createDataFrame([("p", 0, "x"), ("p", 0, "x"), ("p", 1, "y"), ("q", 2, "z")], "src string, seq long, v string")
    assert rows(channels.once(got, ("src", "seq"), got.where("seq = 2"))) == [("p", 0, "x"), ("p", 1, "y")]
    with pytest.raises(channels.DotReused):
        channels.once(got.unionByName(got.withColumn("v", F.lit("other"))), ("src", "seq"))
    assert rows(channels.prefix(got, ("src",), "seq")) == [("p", 1)]
    numbers = [(0, x) for x in (1, 2, 3, 7, 8, 15, 16, 17, 30)] + [(1, -3), (1, -2), (1, 0)]
    assert rows(channels.islands(spark.createDataFrame(numbers, "g long, v long"), ("g",), "v", bucket=4)) == [(0, 1, 3), (0, 7, 8), (0, 15, 17), (0, 30, 30), (1, -3, -2), (1, 0, 0)]


def test_broadcast_under_faults(spark):
    """A node that is not told because the message was lost, per schedule, all schedules in one batch."""
    sent = spark.createDataFrame([(s, "a", d, 1) for s in (0, 1, 2) for d in "abc"], "schedule int, src string, dst string, tick int")
    lost = spark.createDataFrame([(1, "a", "b", 1), (1, "a", "a", 1)], "schedule int, src string, dst string, tick int")
    down = spark.createDataFrame([(2, "c", 2)], "schedule int, node string, tick int")
    got = {(s, d) for s, _, d, t in rows(channels.deliver(sent, lost, down)) if t == 2}
    assert got == {(s, d) for s in (0, 1, 2) for d in "abc"} - {(1, "b"), (2, "c")}


def test_traces(spark):
    held = [("a", t, "x") for t in (1, 2, 3, 5)] + [("b", 2, "x"), ("b", 3, "y")]
    trace = spark.createDataFrame(held, "node string, tick long, v string")
    assert rows(traces.spans(trace)) == [("a", "x", 1, 3), ("a", "x", 5, 5), ("b", "x", 2, 2), ("b", "y", 3, 3)]
    assert rows(traces.always(trace, 1, 3)) == [("a", "x")]
    assert rows(traces.ever(trace, 2)) == [("a", "x"), ("b", "x")]
    assert rows(traces.at(trace, 3, "b")) == [("b", "y")]
    members = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert rows(traces.quorum(trace, members, ("v",))) == [("x",)]
    assert rows(traces.agree(trace.withColumn("k", F.lit(1)), ("k",), "v")) == [(1, "x", "y")]


def test_provenance(spark):
    edge = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (8, 9)], "x long, y long")
    rules = [Rule("r", ("x", "y"), (Atom("e", ("x", "y")),)), Rule("r", ("x", "z"), (Atom("r", ("x", "y")), Atom("e", ("y", "z"))))]
    steps = provenance.derivations(rules, [Relation("r", ("x", "y"))], {"e": edge})
    behind = provenance.why(steps, spark.createDataFrame([("r", '["1","3"]')], "head string, row string"))
    base = {x.premise_row for x in behind.where("premise = 'e'").collect()}
    assert base == {'["1","2"]', '["2","3"]', '["3","1"]'}
    rule = Rule("q", ("x",), (Atom("e", ("x", "y")), Guard("$y > 2"), Not((Atom("e", ("y", "x")),))))
    asked = spark.createDataFrame([(7,), (1,), (2,)], "x long")
    assert rows(provenance.why_not(rule, Relation("q", ("x",)), {"e": edge}, asked)) == [(1, 1), (2, 3), (7, 0)]


def _fits(ops) -> bool:
    """Whether some order of the operations respects time and register semantics."""
    for order in itertools.permutations(ops):
        now, fine = None, True
        for i, (kind, v, b, _) in enumerate(order):
            fine = fine and not any(later[3] < b for later in order[i + 1 :])
            if kind == "w":
                now = v
            elif now != v:
                fine = False
            if not fine:
                break
        if fine:
            return True
    return False


def test_linearizable_agrees_with_search(spark):
    r = random.Random(11)
    cases, want = [], {}
    for key in range(150):
        ops, values = [], list(range(r.randrange(1, 4)))
        times = iter(r.sample(range(100), 20))
        span = lambda: sorted((next(times), next(times)))
        ops += [("w", v, *span()) for v in values]
        ops += [("r", r.choice([*values, None]), *span()) for _ in range(r.randrange(0, 4))]
        want[key] = _fits(ops)
        cases += [(key, *op) for op in ops]
    bad = {x.key for x in linearize.violations(spark.createDataFrame(cases, "key int, kind string, v int, b long, e long"), ("key",), "kind", "v", "b", "e").collect()}
    assert {k: k not in bad for k in want} == want and 10 < len(bad) < 140


def test_bytes_and_varints(spark):
    xs = [0, 1, 127, 128, 300, 2**31, 2**63 - 1, -1, -2, -(2**63)]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    got = df.select("x", S.uvarint(F.col("x")).alias("u"), S.varint(F.col("x")).alias("z")).select("x", "u", S.uvarint_at(F.col("u"), F.lit(0)).alias("a"), S.varint_at(F.col("z"), F.lit(0)).alias("b"))
    for x in got.collect():
        n, want = x.x % 2**64, bytearray()
        while n > 127:
            want.append(n % 128 + 128)
            n //= 128
        assert bytes(x.u) == bytes([*want, n]) and x.a.value == x.x and x.a.next == len(want) + 1 and x.b.value == x.x
    bad = spark.createDataFrame([(b"\x80",), (b"\x80" * 10 + b"\x01",), (b"\xff" * 9 + b"\x02",), (b"",)], "b binary")
    assert [r[0] for r in bad.select(S.uvarint_at(F.col("b"), F.lit(0))).collect()] == [None] * 4
    one = df.limit(1)
    data = F.lit(b"\x00\x01\xff\xfe")
    assert tuple(one.select(S.int_at(data, F.lit(1), 2), S.int_at(data, F.lit(2), 2, True), S.int_at(data, F.lit(3), 2), S.int_at(data, F.lit(0), 4)).first()) == (511, -2, None, 131070)
    assert bytes(one.select(S.put_int(data, F.lit(1), F.lit(-2), 2)).first()[0]) == b"\x00\xff\xfe\xfe"
    assert one.select(S.put_int(data, F.lit(3), F.lit(1), 2)).first()[0] is None
    assert [bytes(one.select(S.int_bytes(F.lit(v), 8)).first()[0]) for v in (-1, 5)] == [b"\xff" * 8, b"\0" * 7 + b"\5"]


def test_library(spark):
    one = spark.range(1)
    v = F.array(*[F.lit(x).cast("long") for x in (1, 2, 3, 4)])
    pick = one.select(
        S.scan_while(v, F.lit(0).cast("long"), lambda a, x: F.when(a + x < 7, a + x), "bigint"), S.words(F.lit(" a b  c")), S.trim(F.lit("  x ")),
        S.map_entries(S.map_insert(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)), F.lit("b"), F.lit(3))), S.to_map(F.array(*[F.struct(F.lit("k").alias("key"), F.lit(n).alias("value")) for n in (1, 2)])),
        S.parse_u64(F.lit("-3")), S.from_utf8(F.lit(b"\xff")), S.bytes_slice(F.lit(b"abcd"), F.lit(1), F.lit(3)),
    ).first()
    assert pick[0] == [1, 3, 6] and pick[1] == ["a", "b", "c"] and pick[2] == "x"
    assert [tuple(e) for e in pick[3]] == [("a", 2), ("b", 3)] and pick[4] == {"k": 2}
    assert pick[5] is None and pick[6] is None and bytes(pick[7]) == b"bc"


def test_lines(spark, many_parts, tmp_path):
    for name, n in (("a.txt", 5), ("b.txt", 1200)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    got = lines(spark, f"file://{tmp_path}").collect()
    assert len(got) == 1205 and all(x.text == f"{x.file.rsplit('/', 1)[1]} {x.line}" for x in got)


def test_groups_that_lie_in_many_parts(spark, many_parts):
    """One key with nearly all rows: as-of joins, versions and numbers agree with plain loops across parts."""
    from tickwise.operators import joins
    from tickwise.sources import history

    r = random.Random(7)
    left = [(r.choice(["hot"] * 9 + ["x", None]), r.randrange(2000), i) for i in range(400)]
    right = [(r.choice(["hot"] * 9 + ["x", None]), r.randrange(2000), 1000 + i) for i in range(300)]
    a, b = spark.createDataFrame(left, "k string, at long, id long"), spark.createDataFrame(right, "k string, at long, v long")
    got = {x.id: x.v for x in joins.asof_join(a, b, ("k",), "at", ("v",), "").select("id", "v").collect()}
    assert got == {i: max(((t, v) for q, t, v in right if q == k and t <= at), default=(0, None))[1] for k, at, i in left}
    log = b.where("k is not null").withColumn("alive", F.col("v") % 3 > 0)
    kept = {(x.k, x.from_tick): (x.v, x.to_tick) for x in history.versions(log, ("k",), "at", F.col("alive")).collect()}
    want = {}
    for k in ("hot", "x"):
        ticks = sorted({t for q, t, _ in right if q == k})
        for t, following in zip(ticks, [*ticks[1:], None], strict=True):
            alive, v = max((v % 3 > 0, v) for q, u, v in right if (q, u) == (k, t))
            if alive:
                want[k, t] = (v, following)
    assert kept == want
