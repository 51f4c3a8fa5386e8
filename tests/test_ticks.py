import pytest
from pyspark.sql import functions as F

from tickwise.functions import scalar as S
from tickwise.operators import choice, joins
from tickwise.plans.ticks import InvariantViolated, KeyConflict, Table, Ticks, check
from tickwise.sources import history
from tickwise.streaming.driver import run_stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_takes_effect_next_tick_and_conflicts(spark):
    seen = []

    def step(t):
        seen.append(rows(t.tables["joe"]))
        if "put" in t.events:
            t.upsert("joe", t.events["put"])

    ticks = Ticks(spark, [Table("joe", "k long, v string", ("k",))], step)
    put = lambda *r: {"put": spark.createDataFrame(list(r), "k long, v string")}
    ticks.run([put((1, "a")), put((1, "b"))], ticks=3)
    assert seen == [[], [(1, "a")], [(1, "b")]]
    with pytest.raises(KeyConflict):
        ticks.advance(put((2000, "bush"), (2000, "gore")))


def test_insert_beats_delete_and_messages_arrive(spark):
    def step(t):
        if t.number == 0:
            t.insert("p", spark.createDataFrame([(1,), (2,)], "x long"))
        if t.number == 1:
            t.delete("p", spark.createDataFrame([(1,), (2,)], "x long"))
            t.insert("p", spark.createDataFrame([(2,)], "x long"))
            t.send("later", spark.createDataFrame([(9,)], "x long"), delay=2)
            assert rows(t.inserted("p")) == [(1,), (2,)]
        if t.number == 2:
            assert rows(t.deleted("p")) == [(1,)] and not t.events
        if t.number == 3:
            t.insert("p", t.events["later"])

    assert rows(Ticks(spark, [Table("p", "x long")], step).run([], ticks=4)["p"]) == [(2,), (9,)]
    with pytest.raises(InvariantViolated):
        check(spark.range(1), "never")


def test_choice_and_joins(spark):
    u = spark.createDataFrame([("u1", 9), ("u2", 7), ("u3", 9), ("u4", 5)], "u string, s long")
    assert rows(choice.top(u, 2, (), [F.col("s").desc()])) == [("u1", 9), ("u3", 9)]
    assert rows(choice.arg_best(u, (), F.col("s"), largest=True)) == [("u1", 9), ("u3", 9)]
    assert [r["i"] for r in choice.index(u.union(u), [F.col("s").desc()], "i").orderBy("i").collect()] == [0, 1, 2, 3]
    pts = spark.createDataFrame([(k,) for k in range(-50, 50, 7)], "x long")
    rng = spark.createDataFrame([(-20, 3), (10, 5), (0, 49), (7, 7)], "lo long, hi long")
    plain = pts.crossJoin(rng).where("x between lo and hi")
    assert rows(joins.range_join(pts, "x", rng, "lo", "hi", 6).select("x", "lo", "hi")) == rows(plain)
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z")], "k string, t long, p string")
    assert set(map(tuple, joins.asof_join(left, right, ("k",), "t", ("p",)).collect())) == {("a", 5, 5, "y"), ("a", 1, None, None), ("b", 9, None, None)}


def test_history(spark):
    log = spark.createDataFrame([(1, 0, True, "a"), (1, 2, True, "b"), (1, 4, False, "b"), (2, 1, True, "c"), (2, 1, False, "c")], "k long, t long, put boolean, v string")
    kept = history.versions(log, ("k",), "t", F.col("put")).drop("put").cache()
    at = lambda t: rows(history.as_of(kept, F.lit(t)))
    assert (at(0), at(1), at(3), at(4)) == ([(1, "a")], [(1, "a"), (2, "c")], [(1, "b"), (2, "c")], [(2, "c")])
    assert rows(history.changed(kept, F.lit(1), F.lit(4)).select("v", "change")) == [("a", -1), ("b", -1), ("b", 1)]


def test_scalars(spark):
    one = spark.createDataFrame([(-2.5, 0.0, "12", "x1", [3, 1, 2])], "a double, z double, n string, m string, v array<long>")
    r = one.select(S.round_away(F.col("a")).alias("r"), S.trunc(F.col("a")).alias("t"), S.divide(F.col("a"), F.col("z")).alias("d"), S.parse_i64(F.col("n")).alias("n"), S.parse_i64(F.col("m")).alias("m"), S.range_(F.lit(3), F.lit(2)).alias("e"), S.scan(F.col("v"), F.lit(0).cast("long"), lambda a, x: a + x, "long").alias("s"), S.u32_be_at(S.put_u32_be(F.lit(70000)), 0).alias("u"), S.ring_between(F.lit(1), F.lit(9), F.lit(3)).alias("ring")).first()
    assert tuple(r) == (-3.0, -2.0, float("-inf"), 12, None, [], [3, 4, 6], 70000, True)


def test_stream_batches_are_ticks(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "x long").write.parquet(str(tmp_path / "in"))

    def step(t):
        if "x" in t.events:
            t.insert("got", t.events["x"])

    ticks = Ticks(spark, [Table("got", "x long")], step)
    source = spark.readStream.schema("x long").parquet(str(tmp_path / "in"))
    run_stream(source, "x", ticks, str(tmp_path / "check")).awaitTermination(60)
    assert rows(ticks.state["got"]) == [(1,), (2,)]


def test_journal_survives_a_restart(spark, tmp_path):
    """A second Ticks goes on from the first one's tables, deltas, messages and last batch."""

    def step(t):
        if "ev" in t.events:
            t.insert("got", t.events["ev"])
            t.send("echo", t.events["ev"].selectExpr("x + 100 as x"), delay=2)
        if "echo" in t.events:
            t.insert("got", t.events["echo"])

    journal = f"file://{tmp_path}/journal"
    tables = [Table("got", "x long"), Table("idle", "x long")]
    first = Ticks(spark, tables, step, journal)
    assert not first.recovered
    for n in (1, 2):
        first.advance({"ev": spark.createDataFrame([(n,)], "x long")}, batch=n - 1)
    again = Ticks(spark, tables, step, journal)
    assert again.recovered and (again.number, again.batch) == (2, 1)
    assert sorted(r.x for r in again.before["got"].collect()) == [1]
    for _ in range(2):
        again.advance()
        first.advance()
    for t in (first, again):
        assert sorted(r.x for r in t.state["got"].collect()) == [1, 2, 101, 102] and t.state["idle"].isEmpty() and not t.waiting
    assert Ticks(spark, tables, step, journal).number == 4
