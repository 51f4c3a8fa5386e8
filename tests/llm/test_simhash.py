import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tickwise.llm import components, simhash


def brute(texts, n=3, tau=2):
    out = []
    for t in texts:
        w = bytes(t or "", "utf8").lower().split()
        s = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    part = list(range(len(texts)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bin(out[i] ^ out[j]).count("1") <= tau:
                a, b = sorted((root(i), root(j)))
                part[b] = a
    return {i: (out[i], root(i)) for i in range(len(texts))}


def run(spark, texts, tau=2):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    return {r["id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df, shingle=3, tau=tau).collect()}


def corpus(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t", "One", "one", "a b", "a  B\n", "mot dur é"]
    for _ in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(50, 400))]
        for _ in range(6):
            copy = base[:]
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            texts.append(" ".join(copy))
    return texts + ["long " * 30000]


def test_matches_brute_force(spark):
    texts = corpus()
    assert run(spark, texts) == brute(texts)


def test_dense_buckets_take_the_ball_points(spark, monkeypatch):
    texts = corpus(2)
    monkeypatch.setattr(simhash, "BUCKET", 2)
    assert run(spark, texts) == brute(texts)


def test_dense_buckets_with_an_odd_threshold(spark, monkeypatch):
    texts = corpus(3)[:60]
    monkeypatch.setattr(simhash, "BUCKET", 2)
    assert run(spark, texts, tau=3) == brute(texts, tau=3)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_allocation_keeps_the_sum():
    costs = np.random.default_rng(0).random((50, 3, 4)) * 10
    costs[:, :, 0] = 0
    got = simhash.allocate(costs, 0)
    assert (got.sum(axis=1) == 0).all()
    best = [min(c[0, a + 1] + c[1, b + 1] + c[2, d + 1] for a in range(-1, 3) for b in range(-1, 3) for d in range(-1, 3) if a + b + d == 0) for c in costs]
    assert np.allclose([sum(c[i, t + 1] for i, t in enumerate(row)) for c, row in zip(costs, got)], best)


def test_wide_fingerprint_deals_each_hash_once():
    text = b" ".join(b"w%d" % i for i in range(500))
    wide = simhash.fingerprint(text, 5, 16)
    assert len(wide) == 16 and len(set(wide)) == 16 and simhash.fingerprint(b"", 5, 16) == [0] * 16


def near_copies_brute(texts, n=5):
    sets = [set(simhash.shingle_set(bytes(t or "", "utf8"), n).tolist()) for t in texts]
    part = list(range(len(texts)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both * 9 >= (len(sets[i]) + len(sets[j])) * 4:
                a, b = sorted((root(i), root(j)))
                part[b] = a
    return {i: root(i) for i in range(len(texts))}


def near_corpus(seed=5):
    """Long and short texts whose copies lie on both sides of 0.8, some behind a passage that many share."""
    rnd = random.Random(seed)
    say = lambda n: [f"w{rnd.randrange(20000)}" for _ in range(n)]
    notice = say(120)
    texts = [None, "", " ", "One two", "one  TWO", "a b"]
    for k in range(24):
        base = (notice if k % 3 == 0 else []) + say(rnd.choice([25, 60, 300, 2500]))
        for share in (0, 0.012, 0.02, 0.022, 0.024, 0.03, 0.05):
            copy = base[:]
            for at in rnd.sample(range(len(copy)), round(len(copy) * share)):
                copy[at] = f"x{rnd.randrange(20000)}"
            texts.append(" ".join(copy))
    return texts


def test_near_copies_are_the_pairs_of_jaccard_four_fifths(spark):
    texts = near_corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    assert got == near_copies_brute(texts)


def test_short_texts_under_four_fifths_stay(spark):
    """29 words have 25 shingles; a word changed inside breaks five of them (20 of 30 shared), the last word one (24 of 26)."""
    texts = []
    for k in range(40):
        base = [f"k{k}w{i}" for i in range(29)]
        texts += [" ".join(base), " ".join([*base[:14], "other", *base[15:]]), " ".join([*base[:28], "other"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {r["id"] for r in simhash.near_copies(df).where("id <> component_id").collect()}
    assert gone == {3 * k + 2 for k in range(40)}


def test_rows_go_by_id_and_text(spark):
    """A unique text stays though its id belongs to a copy; of rows that repeat id and text one stays."""
    one, other, third = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, one, "x"), (5, one, "y"), (5, other, "z"), (7, third, "p"), (7, third, "q"), (7, third, "r"), (None, one, "n"), (9, None, "e"), (10, "", "f"), (10, " ", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()]
    assert sorted(got, key=str) == sorted([(1, one), (5, other), (7, third), (None, one), (9, None)], key=str)


def test_clashing_columns(spark):
    names = ["id", "md5", "ID_", "node", "keep", "same", "fp", "rep", "a", "b", "__gone"]
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(i, text, *names) for i in (2, 2, 3)], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    got = simhash.keep_one(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(2, text, *names)]


def test_fingerprints_alone_would_not_do(spark):
    """The search by fingerprints gives links of its own, and sets beyond its threshold are found all the same."""
    texts = near_corpus(6)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = simhash.materialize(simhash.shingle_sets(df))
    reps = sets.select(F.col("node").alias("rep"), "n", "set", "fp")
    quick = {(r["a"], r["b"]) for r in simhash.verified(simhash._pairs_by_fingerprint(reps, 2).distinct(), reps).collect()}
    every = {(r["a"], r["b"]) for r in simhash.jaccard_links(reps).collect()}
    assert 0 < len(quick) < len(every)


def test_small_graphs_meet_in_one_task(spark, monkeypatch):
    """Rounds over few edges leave one file, however many shuffle partitions there are; dealt out, they find the same."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(40) if k % 10 != 9], "a long, b long")
    want = {(k, k // 10 * 10) for k in range(40) if k % 10}
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        small = components.connected_components(edges)
        assert len(small.inputFiles()) == 1 and {tuple(r) for r in small.collect()} == want
        monkeypatch.setattr(components, "TASK", 0)
        assert {tuple(r) for r in components.connected_components(edges).collect()} == want
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
