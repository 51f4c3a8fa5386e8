import random

from tickwise.llm import quality, toxicity


def texts(n=500, seed=3):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7))) for _ in range(500)]
    bad = ["grmblfix", "grmblfax", "zorkpudding"]
    rows, labels = [], []
    for i in range(n):
        toxic, good = int(i % 4 == 0), int(i % 5 != 0)
        words = [rnd.choice(vocab) for _ in range(rnd.randint(20, 120))]
        if toxic:
            for k in range(0, len(words), 15):
                words[k] = rnd.choice(bad) if i < n * 0.7 else "grmblf" + rnd.choice("ou") + "x"
        text = " ".join(words).capitalize() + "."
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), "x"))
        labels.append((i, good, toxic))
    return rows, labels


def frames(spark):
    rows, labels = texts()
    docs = spark.createDataFrame(rows + [(None, None, None), (9000, "", "x"), (9001, None, "x"), (9002, "word " * 50000, "x"), (3, rows[3][1], "x")], "doc_id long, text string, score string")
    known = spark.createDataFrame(labels + [(None, 1, 1), (7, None, None), (8, 5, 5)], "doc_id long, quality int, toxic int")
    return docs, known, {i: (q, t) for i, q, t in labels}


def check(spark, module, at, label):
    docs, labels, want = frames(spark)
    learn = ~module.held_out("id")
    model = module.train(docs, labels, learn=learn)
    found = module.score(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert [r["score"] for r in found if r["id"] == 9000] == [r["score"] for r in found if r["id"] == 9001]
    held = {r["doc_id"] for r in docs.where(module.held_out("doc_id")).collect()}
    tested = [r for r in found if r["id"] in held and r["id"] in want]
    assert len(tested) > 50
    assert sum((r["score"] >= 0.5) == want[r["id"]][at] for r in tested) >= 0.95 * len(tested)
    again = module.score(docs, module.train(docs.repartition(3), labels, learn=learn)).collect()
    assert sorted((str(r["id"]), r["score"]) for r in again) == sorted((str(r["id"]), r["score"]) for r in found)
    empty = module.train(docs.limit(0), labels.limit(0))
    assert module.score(docs.limit(0), empty).count() == 0
    one = labels.where(f"{label} = 1")
    assert module.score(docs, module.train(docs, one)).count() == docs.count()


def test_quality_held_out(spark):
    check(spark, quality, 0, "quality")
    docs, labels, want = frames(spark)
    kept = {r["doc_id"] for r in quality.keep_good(docs, quality.train(docs, labels)).collect()}
    assert quality.keep_good(docs, quality.train(docs, labels)).columns == docs.columns
    assert sum((i in kept) == q for i, (q, _) in want.items()) >= 0.97 * len(want)


def test_every_labelled_text_teaches_quality_however_long(spark, monkeypatch):
    docs = [(i, "plain words of a page. " * 3) for i in range(40)] + [(100 + i, "BUY!! NOW!! " * 40_000) for i in range(3)]
    labels = [(i, int(i < 100)) for i, _ in docs]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for few, many, at_once in ((64, 1024, 10_000), (1, 4, 5)):
        for name, v in (("FEW", few), ("MANY", many), ("AT_ONCE", at_once)):
            monkeypatch.setattr(quality, name, v)
        model = quality.train(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r["id"] for r in quality.score(frame, model).collect() if r["score"] < 0.5} == {100, 101, 102}


def test_toxicity_held_out_with_unseen_spellings(spark):
    check(spark, toxicity, 1, "toxic")


def test_long_words_pass_in_pieces(monkeypatch):
    word = bytes(97 + k * k % 23 for k in range(300))
    whole = sorted(set(toxicity.subwords(word)))
    monkeypatch.setattr(toxicity, "LONG_WORD", 7)
    assert toxicity.subwords(word) == whole
    monkeypatch.setattr(toxicity, "LONG_WORD", 10_000)
    assert len(toxicity.subwords(bytes(97 + k * k % 23 for k in range(50_000)))) <= toxicity.BUCKETS
