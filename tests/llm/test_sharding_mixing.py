import random
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tickwise.llm import mixing, numbering, sharding

DDL = "doc_id long, text string, source string, lang string, shard string, size string"


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    rows = [(i, " ".join("word" for _ in range(rnd.choice([1, 5, 60, 200]))), rnd.choice(["hot", "hot", "hot", None, "b", "é"]), rnd.choice(["en", None]), "x", "y") for i in range(n)]
    return rows + [(n, None, None, None, None, None), (n + 1, "", "b", "", None, None), (None, "null id", "b", "en", None, None), (5, "again", "hot", "en", None, None), (n + 2, "x " * 2000, "b", "en", None, None)]


def test_shards_are_even_and_slots_gapless(spark, monkeypatch):
    monkeypatch.setattr(numbering, "LEAST_ROWS", 10)
    rows = corpus()
    df = spark.createDataFrame(rows, DDL)
    for shards in (1, 7, 24):
        got = sharding.shard_documents(df, shards=shards).collect()
        assert sorted((str(r["id"]), r["size"], r["crc"]) for r in got) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
        weight, slots = defaultdict(int), defaultdict(list)
        for r in got:
            weight[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        mean, largest = sum(weight.values()) / shards, max(r["size"] for r in got)
        assert set(weight) == set(range(shards)) and all(abs(w - mean) <= 2 * largest for w in weight.values())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {(r["id"], r["crc"], r["shard"], r["slot"]) for r in sharding.shard_documents(df.repartition(5), shards=24).collect()}
    assert again == {(r["id"], r["crc"], r["shard"], r["slot"]) for r in got}


def test_equal_dimensions_and_targets(spark):
    df = spark.range(960).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"))
    got = sharding.shard_documents(df, shards=24).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [40] * 24
    assert sharding.shard_documents(df, target=17 * 100).select("shard").distinct().count() == 10
    assert sorted(r["count"] for r in sharding.shard_documents(df, shards=320).groupBy("shard").count().collect()) == [3] * 320
    assert sharding.shard_documents(df.limit(0), shards=24).count() == 0


def test_equal_rows_part_like_others(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL", 100)
    row = F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"), F.lit("x").alias("__n")
    got = sharding.shard_documents(spark.range(960).select(*row), shards=24).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert {k: sorted(v) for k, v in by.items()} == {k: list(range(40)) for k in range(24)}


def brute_tree(rows, leaves):
    """Leaf of each (keys, weight): cut along the widest key where the weight divides best, by sorting."""
    if leaves == 1 or not rows:
        return [[r[2] for r in rows]] + [[]] * (leaves - 1)
    axis = max(range(len(rows[0][0])), key=lambda i: (max(r[0][i] for r in rows) - min(r[0][i] for r in rows), -i))
    rows, half = sorted(rows, key=lambda r: r[0][axis]), leaves // 2
    goal, sums = sum(r[1] for r in rows) * half / leaves, [0]
    for r in rows:
        sums.append(sums[-1] + r[1])
    k = next(i for i, x in enumerate(sums) if x >= goal)
    k = k - 1 if k and abs(sums[k - 1] - goal) < abs(sums[k] - goal) else k
    return brute_tree(rows[:k], half) + brute_tree(rows[k:], leaves - half)


def test_the_tree_is_that_of_sorting(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(1, 400), rnd.choice([5, 5, 5, rnd.randrange(1000)]), rnd.randrange(1 << 40)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, w long, a long, b long").withColumn("tie", F.xxhash64("id"))
    for leaves in (2, 7, 24):
        got = {r["id"]: r["node"] for r in sharding.kd_shards(df, ["a", "b"], "w", "tie", shards=leaves).collect()}
        scaled = sharding._scaled([(min(r[k] for r in rows), max(r[k] for r in rows)) for k in (2, 3)], ["a", "b"])
        keys = df.select("id", "w", *[(x * (1 << 31) + F.pmod("tie", F.lit(1 << 31))).alias(f"k{i}") for i, x in enumerate(scaled)]).collect()
        want = {i: leaf for leaf, ids in enumerate(brute_tree([((r["k0"], r["k1"]), r["w"], r["id"]) for r in keys], leaves)) for i in ids}
        assert got == want


def test_mix_agrees_with_sql(spark, monkeypatch):
    monkeypatch.setattr(numbering, "LEAST_ROWS", 10)
    rows = [r for r in corpus() if r[1] != "again"]
    df = spark.createDataFrame(rows, DDL)
    first = mixing.schedule(mixing.mix(df)).where("pass is null or pass = 0")
    mixed = first.collect()
    documents = pd.DataFrame([(i, t, s) for i, t, s, *_ in rows], columns=["doc_id", "text", "source"])
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(mixing.ORACLE).fetchall()
    key = lambda r: (str(r[0]), r[1])
    got = [(r["id"], r["size"], r["source_size"], r["target"], r["taken"], r["position"], r["place"]) for r in mixed]
    assert sorted(got, key=key) == sorted(want, key=key)
    by = defaultdict(int)
    for r in mixed:
        by[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(by[r["source"]] - r["target"]) <= 1 for r in mixed)
    assert mixing.mix(df.limit(0)).count() == 0


def test_positions_follow_the_schedule(spark):
    row = spark.range(1).select(*[mixing.position(F.lit(p), F.array(*[F.lit(x) for x in ramp]), 3).alias(f"p{k}") for k, (p, ramp) in enumerate([(0.0, (2.0, 1.0, 0.5)), (1.0, (2.0, 1.0, 0.5)), (0.25, (1.0, 1.0, 1.0)), (0.5, (0.5, 1.0, 2.0))])]).first()
    assert row["p0"] == 0 and abs(row["p1"] - 1) < 1e-9 and abs(row["p2"] - 0.25) < 1e-9
    t, total = row["p3"], 0.375 + 0.75
    area = 0.375 + (t - 0.5) * (1 + (1 + (t - 0.5) * 2)) / 2
    assert abs(area - total / 2) < 1e-9
    df = spark.createDataFrame(corpus(), DDL)
    shown = mixing.training_order(mixing.mix(df), 3).collect()
    order = [r["position"] for r in shown]
    assert order == sorted(order) and [r["place"] for r in shown] == list(range(len(shown)))


def test_every_pass_has_a_place_in_the_training_order(spark):
    rows = [(i, "w " * (3 + i % 7), f"s{i % 3}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = {r["id"]: r for r in mixing.mix(df).collect()}
    shown = mixing.schedule(mixing.mix(df)).where("pass is not null").collect()
    words, at = defaultdict(int), defaultdict(list)
    for r in sorted(shown, key=lambda r: (r["id"], r["pass"])):
        words[r["id"]] += r["words"]
        at[r["id"]].append(r["position"])
    assert words == {i: r["taken"] for i, r in mixed.items() if r["taken"]}
    assert any(len(x) > 1 for x in at.values()) and all(x == sorted(set(x)) and x[0] == mixed[i]["first_position"] for i, x in at.items())
    place = {(r["id"], r["pass"]): r["position"] for r in shown}
    seen, order = defaultdict(int), []
    for r in mixing.copies(df).collect():
        order.append(place[r["doc_id"], seen[r["doc_id"]]])
        seen[r["doc_id"]] += 1
    assert order == sorted(order) and len(order) > 90
