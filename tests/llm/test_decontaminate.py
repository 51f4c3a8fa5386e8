import random

from tickwise.llm import decontaminate as D


def edit(a, b):
    """Least distance of a to any substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        prev, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
    return min(row)


def test_myers_is_the_edit_distance():
    rnd = random.Random(0)
    for _ in range(300):
        a = "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 90)))
        b = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 120)))
        d = edit(a, b)
        assert D.bounded_distance(a, b, 200) == d
        assert D.bounded_distance(a, b, d - 1) is None


def world(seed=3):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.choice([8, 15, 22, 45]))) for i in range(12)]
    docs = [(0, None), (1, ""), (2, say(3000))]
    for i in range(3, 75):
        text = say(60)
        if i % 3 == 0:
            t = list(rnd.choice(items)[1])
            for _ in range(rnd.randint(0, 12)):
                at = rnd.randrange(len(t))
                rnd.choice([lambda: t.__setitem__(at, "x"), lambda: t.insert(at, "y"), lambda: t.pop(at)])()
            text += "  \n" + "".join(t).upper() + " " + say(20)
        docs.append((i, text))
    return items, docs


def brute(items, docs):
    out = {}
    for i, t in docs:
        for item, text in items:
            near = [d for p in D.passages(item, text) if (d := edit(p.text, D.normal(t or ""))) <= p.edits]
            if near:
                out[i, item] = min(near)
    return out


def test_matches_brute_force(spark):
    items, docs = world()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item long")
    b = spark.createDataFrame([*items, (99, None), (98, "short"), (None, "x" * 50)], "item_id long, text string")
    want = brute(items, docs)
    assert len(want) > 10
    for size in (1 << 20, 900):
        assert {(r["id"], r["item"]): r["distance"] for r in D.contaminated(d, b, block_bytes=size).collect()} == want
        kept = {r["doc_id"] for r in D.keep_clean(d, b, block_bytes=size).collect()}
        assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert D.contaminated(d, b).count() == 0 and D.keep_clean(one, b).count() == 1
    assert D.contaminated(d, one.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_a_passage_is_found_wherever_it_starts(spark):
    rnd = random.Random(8)
    items = [(i, " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(3, 8))) for _ in range(47))) for i in range(3)]
    windows = [(i, a) for i, _ in items for a in range(47 - 20 + 1)]
    docs = [(k, "before it " + " ".join(items[i][1].split()[a : a + 20]) + " after it") for k, (i, a) in enumerate(windows)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["id"], r["item"], r["distance"]) for r in D.contaminated(d, b).collect()} == {(k, i, 0) for k, (i, _) in enumerate(windows)}
    assert D.keep_clean(d, b).count() == 0
