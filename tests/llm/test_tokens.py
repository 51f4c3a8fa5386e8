import os
import random

from pyspark.sql import functions as F

from tickwise.llm import tokens

VOCABULARY = os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def tokenizer():
    with open(VOCABULARY) as f:
        return tokens.Tokenizer(tokens.Tokenizer.ranks(f.read().split("\n")))


def text(rnd, n):
    parts = ["word", " the", "  ", "\n\n", "don't", "'ll", "12", " 3.5", "é", "ß", "!!", " ", "\t", "'", "re", "😀", "x"]
    return "".join(rnd.choice(parts) for _ in range(n))


def test_edits_equal_encoding_anew(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 4)
    monkeypatch.setattr(tokens, "GROWN", 12)
    tok, rnd = tokenizer(), random.Random(6)
    for _ in range(150):
        now = text(rnd, rnd.randint(0, 120))
        tree = tokens.Tree(now, tok)
        for _ in range(12):
            at, drop, put = rnd.randint(0, len(now) + 3), rnd.choice([0, 0, 1, 2, 5, 40]), text(rnd, rnd.choice([0, 1, 2, 20]))
            tree.edit(at, drop, put)
            at = min(at, len(now))
            now = now[:at] + put + now[at + drop :]
            assert tree.text() == now
            assert tree.total == len(tok.encode(now))
            assert [n for b in tree.blocks for n in b[1]] == list(map(len, tok.split(now)))


def test_query_over_documents(spark):
    rnd = random.Random(7)
    rows = [(i, text(rnd, rnd.randint(0, 400)), "z") for i in range(40)] + [(40, None, "z"), (41, "", "z"), (42, "long " * 40000, "z"), (42, "long " * 40000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, at string")
    tok = tokenizer()
    edits = tokens.sample_edits()
    want = sorted((r["doc_id"], len(tok.encode(r["text"] or "")), [tuple(e) for e in r["e"]], r["text"] or "") for r in df.withColumn("e", edits).collect())
    got = sorted(tokens.count_edits(df, edits, VOCABULARY, keep_text=True).collect())
    assert len(got) == len(want)
    for g, (i, n, es, t) in zip(got, want):
        for at, drop, put in es:
            at = min(at, len(t))
            t = t[:at] + put + t[at + drop :]
        assert (g["id"], g["n_tokens"], g["text"], g["n_tokens_after"], g["n_chars_after"]) == (i, n, t, len(tok.encode(t)), len(t))
        assert g["encoded_chars"] <= 1500
    assert tokens.count_edits(df.limit(0), edits, VOCABULARY).count() == 0
    nothing = tokens.count_edits(df, F.lit(None).cast("array<struct<at:long,drop:long,put:string>>"), VOCABULARY)
    assert nothing.where("n_tokens <> n_tokens_after").count() == 0
