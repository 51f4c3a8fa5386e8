import math
import random

from pyspark.sql import functions as F

from tickwise.llm import topk


def brute(rows, k):
    good = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in good:
        if q % 5:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 1000)
    monkeypatch.setattr(topk, "BLOCKS", 2)
    monkeypatch.setattr(topk, "FIRST", 2)
    monkeypatch.setattr(topk, "GROWTH", 2)
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    same = rows[7][1]
    rows += [(i, same) for i in range(150, 220)] + [(220, None), (225, [1.0, None]), (230, [float("nan")] * 8), (235, [float("inf")] + [0.0] * 7), (240, []), (245, [1.0, 2.0]), (246, [3.0, -1.0]), (250, [0.0] * 8), (None, same)]
    rows += [rows[3], rows[5], (255, [3e38] * 8), (256, [-3e38] * 8)][:2]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = {tuple(r) for r in topk.top_k(df, F.col("id") % 5 == 0, k=5).collect()}
    assert got == brute(rows, 5)


def test_huge_values_and_empty_table(spark):
    df = spark.createDataFrame([(0, [3e38, 1.0]), (1, [-3e38, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r["id"] for r in topk.top_k(df, F.col("id") == 0).orderBy("rank").collect()] == [2, 1]
    assert topk.top_k(df.limit(0), F.col("id") == 0).count() == 0


def test_exact_vectors_are_read_until_the_result_is_certain(spark, monkeypatch):
    """With fine cells a query reads its first slice and no more."""
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(16)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    read, plain = [], topk.materialize
    monkeypatch.setattr(topk, "materialize", lambda d: read.append(plain(d)) or read[-1])
    assert {tuple(r) for r in topk.top_k(df, F.col("id") % 5 == 0, k=5).collect()} == brute(rows, 5)
    asked = [d.count() for d in read if d.columns == ["qid", "vid"]]
    assert 0 < asked[0] <= 120 * topk.FIRST and sum(asked) < 120 * 60
