"""Golden programs: small relations with known answers. Their rows and expected rows are fixed values."""

import pytest

from tickwise.plans.fixpoint import NotConverged, evaluate, strata
from tickwise.plans.rules import Agg, Atom, Const, Let, Not, Relation, Rule


def rel(spark, rows, cols, kind="string"):
    return spark.createDataFrame(rows, ", ".join(f"{c} {kind}" for c in cols.split()))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_same_generation(spark):
    arc = rel(spark, [(0, 7), (1, 0), (1, 6), (2, 0), (2, 1), (2, 3), (3, 1), (6, 5), (8, 3), (8, 6), (8, 7)], "x y", "long")
    rules = [
        Rule("sg", ("x", "y"), (Atom("arc", ("p", "x")), Atom("arc", ("p", "y")), Not((Atom("same", ("x", "y")),)))),
        Rule("sg", ("x", "y"), (Atom("arc", ("a", "x")), Atom("sg", ("a", "b")), Atom("arc", ("b", "y")))),
    ]
    same = arc.selectExpr("x", "x as y").union(arc.selectExpr("y", "y")).distinct()
    assert len(rows(evaluate(rules, [Relation("sg", ("x", "y"))], {"arc": arc, "same": same})["sg"])) == 28


def test_andersen_is_non_linear(spark):
    base = {
        "address_of": rel(spark, [("v3", "o0"), ("v4", "o0"), ("v4", "o1"), ("v5", "o2")], "y x"), "assign": rel(spark, [("v1", "v2"), ("v1", "v4"), ("v3", "v5")], "y x"),
        "load": rel(spark, [("v1", "v0"), ("v2", "v1"), ("v3", "v0")], "y x"), "store": rel(spark, [("v2", "v1"), ("v3", "v2"), ("v3", "v4")], "y x"),
    }
    pt = lambda a, b: Atom("pt", (a, b))
    rules = [
        Rule("pt", ("y", "x"), (Atom("address_of", ("y", "x")),)), Rule("pt", ("y", "x"), (Atom("assign", ("y", "z")), pt("z", "x"))),
        Rule("pt", ("y", "x"), (Atom("load", ("y", "v")), pt("v", "z"), pt("z", "x"))), Rule("pt", ("y", "x"), (Atom("store", ("v", "u")), pt("v", "y"), pt("u", "x"))),
    ]
    want = "o0 o0 o0 o1 o1 o0 o1 o1 o2 o0 o2 o1 v1 o0 v1 o1 v2 o0 v2 o1 v3 o0 v3 o2 v4 o0 v4 o1 v5 o2".split()
    assert rows(evaluate(rules, [Relation("pt", ("y", "x"))], base)["pt"]) == sorted(zip(want[::2], want[1::2]))


def test_mutual_recursion_of_three_relations(spark):
    base = {"assign": rel(spark, [("x0", "x3"), ("x2", "x0"), ("x3", "x1"), ("x3", "x5")], "x y"), "deref": rel(spark, [("x2", "x5"), ("x4", "x3"), ("x5", "x1")], "x y")}
    vf, ma, va = (lambda a, b, n=n: Atom(n, (a, b)) for n in ("vf", "ma", "va"))
    asg = lambda a, b: Atom("assign", (a, b))
    rules = [
        Rule("vf", ("x", "y"), (asg("x", "y"),)), Rule("vf", ("x", "y"), (asg("x", "z"), ma("z", "y"))), Rule("vf", ("x", "y"), (vf("x", "z"), vf("z", "y"))),
        Rule("vf", ("x", "x"), (asg("x", None),)), Rule("vf", ("x", "x"), (asg(None, "x"),)), Rule("ma", ("x", "x"), (asg(None, "x"),)), Rule("ma", ("x", "x"), (asg("x", None),)),
        Rule("ma", ("x", "w"), (Atom("deref", ("y", "x")), va("y", "z"), Atom("deref", ("z", "w")))),
        Rule("va", ("x", "y"), (vf("z", "x"), vf("z", "y"))), Rule("va", ("x", "y"), (vf("z", "x"), ma("z", "w"), vf("w", "y"))),
    ]
    out = evaluate(rules, [Relation(n, ("x", "y")) for n in ("vf", "ma", "va")], base)
    assert rows(out["ma"]) == [("x0", "x0"), ("x1", "x1"), ("x1", "x5"), ("x2", "x2"), ("x3", "x3"), ("x5", "x1"), ("x5", "x5")]
    assert (out["vf"].count(), out["va"].count()) == (14, 25)


def test_negation_and_lattices(spark):
    e = rel(spark, [("s", "l1"), ("l1", "l2"), ("l2", "s"), ("s", "l3")], "s d")
    base = {"e": e, "p": rel(spark, [("l1",)], "n"), "start": rel(spark, [("s",)], "n")}
    rules = [Rule("i", ("n",), (Atom("start", ("n",)),)), Rule("i", ("n",), (Atom("i", ("x",)), Atom("e", ("x", "n")), Not((Atom("p", ("n",)),))))]
    assert rows(evaluate(rules, [Relation("i", ("n",))], base)["i"]) == [("l3",), ("s",)]
    edge = rel(spark, [(1, 2, 10), (2, 3, 10), (1, 3, 30)], "a b w", "long")
    path = [Rule("path", ("a", "b", "w"), (Atom("edge", ("a", "b", "w")),)), Rule("path", ("a", "c", "u + w"), (Atom("path", ("a", "b", "u")), Atom("edge", ("b", "c", "w"))))]
    assert rows(evaluate(path, [Relation("path", ("a", "b", "w"), {"w": "min"})], {"edge": edge})["path"]) == [(1, 2, 10), (1, 3, 20), (2, 3, 10)]
    cap = rel(spark, [("a", "b", 10), ("b", "c", 5), ("a", "c", 3), ("c", "d", 8), ("b", "d", 2), ("d", "a", 4)], "a b w").selectExpr("a", "b", "cast(w as long) w")
    best = [Rule("m", ("a", "b", "w"), (Atom("cap", ("a", "b", "w")),)), Rule("m", ("a", "c", "least(u, w)"), (Atom("m", ("a", "b", "u")), Atom("cap", ("b", "c", "w"))))]
    got = rows(evaluate(best, [Relation("m", ("a", "b", "w"), {"w": "max"})], {"cap": cap})["m"])
    assert [r for r in got if r[0] == "a"] == [("a", "a", 4), ("a", "b", 10), ("a", "c", 5), ("a", "d", 5)]


def test_aggregates_see_distinct_valuations(spark):
    ints = rel(spark, [(1, 10), (5, 10), (3, 20)], "a b", "long")
    q = lambda cols, args: rows(evaluate([Rule("q", args, (Atom("ints", ("a", "b")),))], [Relation("q", tuple(cols.split()))], {"ints": ints})["q"])
    assert q("n b", (Agg("count", "a"), "b")) == [(1, 20), (2, 10)]
    assert q("m n", (Agg("max", "a"), Agg("max", "b"))) == [(5, 20)]
    assert q("p s", ("a % 2", Agg("sum", "b"))) == [(1, 40)]
    one = evaluate([Rule("q", (Agg("sum", "b"),), (Atom("ints", (None, "b")),))], [Relation("q", ("s",))], {"ints": ints})["q"]
    assert rows(one) == [(30,)]
    assert rows(evaluate([Rule("q", (Agg("count"),), (Atom("ints", (Const(99), "b")),))], [Relation("q", ("n",))], {"ints": ints})["q"]) == []


def test_limits(spark):
    n = rel(spark, [(1,)], "x", "long")
    count = [Rule("n", ("x + 1",), (Atom("n", ("x",)),))]
    with pytest.raises(NotConverged):
        evaluate(count, [Relation("n", ("x",))], {"n": n}, max_rounds=3)
    with pytest.raises(ValueError):
        strata([Rule("p", ("x",), (Atom("e", ("x",)), Not((Atom("q", ("x",)),)))), Rule("q", ("x",), (Atom("p", ("x",)),))])
    with pytest.raises(ValueError):
        evaluate([Rule("q", ("x", "y"), (Atom("n", ("x",)), Let("y", "$z")))], [Relation("q", ("x", "y"))], {"n": n})
