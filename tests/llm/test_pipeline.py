import random

import corpus_pipeline
from tickwise.llm import simhash

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def world(tmp_path, spark):
    rnd = random.Random(8)
    vocab = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(30)) for i in range(5)]
    docs, bad, copies, leaks = [], set(), {}, set()
    for i in range(240):
        text, kind = say(rnd.randint(60, 200)), i % 6
        if kind == 1:
            bad.add(i)
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind == 2 and i > 60:
            of = i - 62 - (i - 62) % 6
            copies[i] = of
            words = docs[of][1].split()
            words[rnd.randrange(len(words))] = "changed"
            text = " ".join(words) if i % 4 else docs[of][1]
        elif kind == 3:
            leaks.add(i)
            text += " " + rnd.choice(items)[1] + " " + say(10)
        docs.append((i, text, "en", "src%d" % (i % 3), len(text)))
    d = str(tmp_path)
    spark.createDataFrame(docs, DDL).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, {i: t for i, t, *_ in docs}, bad, copies, leaks


def jaccard(a, b, n=5):
    s, t = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a.split(), b.split()))
    return len(s & t) / len(s | t)


def test_stages_do_what_they_say(spark, tmp_path):
    d, texts, bad, copies, leaks = world(tmp_path, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, d)
    assert ids(good) == set(texts) - bad and good.columns == docs.columns
    one = stages["near_dedup"](spark, good, d)
    near = {i for i, of in copies.items() if jaccard(texts[i], texts[of]) >= 0.8}
    assert len(near) > 20 and ids(one) == ids(good) - near and one.columns == docs.columns
    clean = stages["decontaminate"](spark, one, d)
    assert ids(clean) == ids(one) - leaks and clean.columns == docs.columns
    mix = stages["mix"](spark, clean, d)
    words = lambda df: sum(len(r["text"].split()) for r in df.collect())
    assert mix.columns == docs.columns and ids(mix) <= ids(clean) and abs(words(mix) - 1.5 * words(clean)) < 0.1 * words(clean)
    out = stages["shard"](spark, mix, d)
    assert out.count() == mix.count() and out.select("shard").distinct().count() == 24
    assert corpus_pipeline.run(spark, d).count() == out.count()


def test_dense_groups_and_odd_texts(spark):
    base = " ".join(f"w{k}" for k in range(300))
    rows = [(i, base.replace("w7 ", f"x{i} "), "en", "s", 1) for i in range(150)] + [(200, None, None, None, None), (201, "", "en", "s", 1), (202, "one", "en", "s", 1), (203, "one", "en", "s", 1), (None, "kept", "en", "s", 1), (204, "long " * 30000, "en", "s", 1)]
    df = spark.createDataFrame(rows, DDL)
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(df).collect()) == sorted(["0", "200", "202", "204", "None"])
    assert simhash.keep_one(df.limit(0)).count() == 0


def hostile(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns that operators use as names of their own."""
    names = ["id", "md5", "node", "position", "__id", "__times", "__copy", "__gone", "__block", "t", "size", "shard"]
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 6) for _ in range(n))
    rows = [(i, text(80), "en", f"s{i % 2}", 1) for i in range(40)] + [(None, text(50), None, None, None), (41, None, None, "s1", 0), (42, "", "en", None, 0), (43, "long " * 60_000, "en", "s0", 1)]
    rows += [rows[3]] * 5 + [(7, text(60), "de", "s1", 1)]
    return spark.createDataFrame([(*r, *names) for r in rows], ", ".join([DDL, *(f"`{n}` string" for n in names)])), len(rows)


def test_every_stage_takes_hostile_and_empty_tables(spark, tmp_path):
    docs, n = hostile(spark)
    d = str(tmp_path)
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(30)] + [(None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, None), (None, "x"), (1, ""), (2, "nothing of this is in any of the texts at all, nor near")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        rows, none = out.count(), stage(spark, docs.limit(0), d)
        assert none.count() == 0 and none.columns == out.columns
        if name != "shard":
            assert out.columns == docs.columns
        if name in ("decontaminate", "shard"):
            assert rows == n
        if name == "near_dedup":
            assert rows == n - 6  # five repeats, and one of the two texts without words
    docs.write.parquet(f"{d}/documents.parquet")
    assert corpus_pipeline.run(spark, d).count() > 0
