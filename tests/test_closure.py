"""Closures by classes against brute force, and that the pairs inside a class take no part in the recursion."""

import random

import pytest
from pyspark.sql import functions as F

from tickwise.operators import closure
from tickwise.plans import fixpoint
from tickwise.plans.rules import Any_, Atom, Relation, Rule
from tickwise.plans.shared import materialize

REACH = Relation("reach", ("a", "b"))
START, STEP = Rule("reach", ("x", "y"), (Atom("edge", ("x", "y")),)), ("x", "z")
SHAPES = {
    "right": [START, Rule("reach", STEP, (Atom("reach", ("x", "y")), Atom("edge", ("y", "z"))))],
    "left": [START, Rule("reach", STEP, (Atom("edge", ("x", "y")), Atom("reach", ("y", "z"))))],
    "both": [START, Rule("reach", STEP, (Atom("reach", ("y", "z")), Atom("reach", ("x", "y"))))],
    "any": [Rule("reach", STEP, (Any_(((Atom("edge", ("x", "z")),), (Atom("reach", ("x", "y")), Atom("edge", ("y", "z"))))),))],
}


def graph(seed: int) -> set:
    """Mutual and single edges, a loop, a cycle of classes, and a null vertex."""
    r = random.Random(seed)
    one = {(r.randrange(30), r.randrange(30)) for _ in range(22)}
    some = {(r.randrange(15), r.randrange(15)) for _ in range(9)}
    return one | some | {(b, a) for a, b in some} | {(40, 40), (50, 51), (51, 50), (51, 52), (52, 53), (53, 52), (53, 50), (None, 50), (54, None)}


def reached(edges: set) -> set:
    out = set(edges)
    while True:
        more = out | {(a, d) for a, b in out for c, d in edges if b == c}
        if more == out:
            return out
        out = more


def rows(frame) -> list:
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("shape", SHAPES)
def test_closure_over_classes_is_the_closure(spark, shape):
    edges = graph(len(shape))
    base = {"edge": spark.createDataFrame(list(edges), "x long, y long")}
    assert rows(fixpoint.evaluate(SHAPES[shape], [REACH], base)["reach"]) == sorted(reached(edges), key=repr)


def test_recursion_carries_classes_not_pairs(spark, monkeypatch):
    n, seen = 60, []
    ring = [(i, (i + 1) % n) for i in range(n)]
    base = {"edge": spark.createDataFrame(ring + [(b, a) for a, b in ring], "x long, y long")}
    add = fixpoint.Known.add
    monkeypatch.setattr(fixpoint.Known, "add", lambda self, df: (add(self, df), seen.append(self.rows))[0])
    assert fixpoint.evaluate(SHAPES["both"], [REACH], base)["reach"].count() == n * n
    assert max(seen) == 1


def test_other_recursions_stay_as_they_are(spark):
    base = {"edge": spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "x long, y long"), "more": spark.createDataFrame([(1, 2), (2, 1), (3, 4)], "x long, y long")}
    rules = [START, Rule("reach", STEP, (Atom("reach", ("x", "y")), Atom("more", ("y", "z"))))]
    assert rows(fixpoint.evaluate(rules, [REACH], base)["reach"]) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (2, 4)]


def test_what_is_not_reached_and_what_is_lost(spark):
    edges = {e for e in graph(3) if None not in e}
    nodes = [*range(32), 50, 51, 60]
    frame = lambda e: spark.createDataFrame(list(e), "x long, y long")
    found, all_ = closure.Closure(frame(edges)), reached(edges)
    missing = found.unreached(spark.createDataFrame([(n,) for n in nodes], "n long"))
    assert rows(missing) == sorted([(a, b) for a in nodes for b in nodes if (a, b) not in all_], key=repr)
    for gone in ((51, 50), min(edges), (52, 53)):
        kept = {e for e in edges if e[0] != gone[0]}
        assert rows(found.lost(closure.Closure(frame(kept)))) == sorted(all_ - reached(kept), key=repr)


def test_a_large_class_is_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(closure, "SHARE", 4)
    base = {"edge": spark.range(1, 30).select(F.lit(0).cast("long").alias("x"), F.col("id").alias("y"))}
    base["edge"] = base["edge"].unionByName(base["edge"].select(F.col("y").alias("x"), F.col("x").alias("y")))
    assert rows(fixpoint.evaluate(SHAPES["right"], [REACH], base)["reach"]) == sorted([(a, b) for a in range(30) for b in range(30)], key=repr)


def under(node) -> list:
    return [node, *(n for i in range(node.children().size()) for n in under(node.children().apply(i)))]


def test_exploded_rows_are_not_broadcast(spark):
    members = materialize(spark.createDataFrame([(i, i % 2) for i in range(40)], "element long, class long"))
    reach = materialize(spark.createDataFrame([(0, 0), (0, 1)], "x long, y long"))
    found = closure.expanded(reach, members)
    assert found.count() == 20 * 40
    joins = [n for n in under(found._jdf.queryExecution().sparkPlan()) if n.nodeName() == "BroadcastHashJoin"]
    sides = [n.right() if n.buildSide().toString() == "BuildRight" else n.left() for n in joins]
    assert not [n.nodeName() for side in sides for n in under(side) if n.nodeName() == "Generate"]


def test_spread_meets_blocks_of_sources_and_targets(spark, monkeypatch):
    monkeypatch.setattr(closure, "SHARE", 4)
    monkeypatch.setattr(closure, "ROW", 3)
    side = {None: [*range(7), None], 1: [*range(10, 30)], 2: [40]}
    ends = [(v, k) for k, vs in side.items() for v in vs]
    pairs = [(None, None), (None, 1), (1, None), (1, 2), (2, 1)]
    frame = spark.createDataFrame(ends, "v long, k long")
    both = spark.createDataFrame(pairs, "a long, b long").select(F.struct("a").alias("a"), F.struct("b").alias("b"))
    found = closure.spread(both, frame.select(F.col("v").alias("x"), F.struct("k").alias("a")), frame.select(F.col("v").alias("y"), F.struct("k").alias("b")))
    assert rows(found) == sorted([(x, y) for a, b in pairs for x in side[a] for y in side[b]], key=repr)
